"""What keeps a task small and a path worked out once, on rows built here."""

import datetime

from pyspark.sql import functions as F

from arrears.catalog import python_code
from arrears.catalog.base import Tables
from arrears.operators import dependencies, history, store
from arrears.operators.common import spread

DAY = datetime.datetime(2025, 1, 1)
TASKS = 4   # the session's shuffle partitions; a few rows would be merged into one task


def _recent(spark, n=6):
    return spark.createDataFrame(
        [(f"r{i % 2}", i, DAY + datetime.timedelta(i), 1.0, 2.0, i + 1) for i in range(n)],
        "repo_id string, scan_id long, created_at timestamp, total_cost_usd double, debt_score double, position long")


def test_spread_rows_stay_in_as_many_tasks_as_the_session_has(spark):
    rows = spark.range(20).selectExpr("id % 5 AS k", "id")
    dealt = spread(rows, "k")
    assert dealt.rdd.getNumPartitions() == TASKS
    assert rows.repartition("k").rdd.getNumPartitions() < TASKS
    assert sorted(dealt.collect()) == sorted(rows.collect())


def test_changed_paths_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "./a//b.py"), (2, ""), (3, None), (4, "vendor/x.py"), (5, ".github/x")], "seq long, end string")
    commits = rows.select("seq", F.concat(F.lit("./"), "end").alias("new_path"), F.lit(None).cast("string").alias("old_path"))
    changed = history.changed_files(commits)
    assert sorted(tuple(r) for r in changed.select("seq", "path").collect()) == [(1, "a/b.py"), (2, ""), (5, "github/x")]
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(./") <= 2   # an empty path and any other


def test_paths_fall_back_to_the_old_one_and_missing_ones_go(spark):
    rows = [(1, "a.py", "b.py"), (2, "", "b.py"), (3, None, "c.py"), (4, None, ""), (5, None, None)]
    commits = spark.createDataFrame(rows, "seq long, new_path string, old_path string")
    assert sorted(tuple(r) for r in history.changed_files(commits).select("seq", "path").collect()) == [
        (1, "a.py"), (2, "b.py"), (3, "c.py")]


def test_module_points_are_dealt_by_scan(spark):
    modules = spark.createDataFrame([(i, "m", i, 1.0, "low") for i in range(6)] + [(99, "m", 1, 1.0, "low")],
                                    "scan_id long, module string, finding_count long, total_cost_usd double, max_severity string")
    points = store.module_trend(_recent(spark), modules.repartition(2).hint("merge"))
    assert points.rdd.getNumPartitions() == TASKS
    assert sorted(r.scan_id for r in points.collect()) == list(range(6))


def test_rich_trend_is_dealt_by_scan_and_counts_zero_where_nothing_is(spark):
    findings = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c")], "scan_id long, module string")
    plan = spark.createDataFrame([(1, "quick_wins"), (1, "next_up"), (2, "strategic")], "scan_id long, bucket string")
    found = store.rich_trend(_recent(spark), findings, findings.distinct(), plan)
    assert found.rdd.getNumPartitions() == TASKS
    counts = {r.scan_id: (r.finding_count, r.module_count, r.quick_wins, r.strategic_items) for r in found.collect()}
    assert counts == {0: (0, 0, 0, 0), 1: (2, 2, 1, 0), 2: (0, 0, 0, 1), 3: (0,) * 4, 4: (0,) * 4, 5: (0,) * 4}


def test_a_popular_package_meets_its_advisories_in_blocks(spark):
    packages = spark.createDataFrame(
        [(f"r{i}", "hot", "1") for i in range(30)] + [("r0", "hot", "1"), ("r1", "rare", "2"), ("r2", None, "1"), ("r3", "none", "1")],
        "repo_id string, package string, version string")
    facts = spark.createDataFrame(
        [("hot", "1", float(i), f"CVE-{i}") for i in range(20)] + [("hot", "1", 0.0, "CVE-0"), ("hot", "1", None, None),
                                                                   ("rare", "2", 1.0, "CVE-9"), (None, "1", 1.0, "CVE-8"), ("other", "1", 1.0, "CVE-7")],
        "package string, version string, cvss_score double, cve_id string")
    plain = dependencies.vulnerable_packages(packages, facts)
    cut = dependencies.vulnerable_packages(packages, facts, block=4)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))
    hot = cut.filter("package = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == 31 * 22


def test_tasks_that_parse_grow_with_the_files(spark, tmp_path):
    n = python_code.FILES_A_TASK * (spark.sparkContext.defaultParallelism + 2)
    spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    files = python_code.source_files(Tables(spark, str(tmp_path)))
    assert files.select("repo_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism + 2
    assert files.count() == n
