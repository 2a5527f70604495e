"""Readers and the scan store on files."""

import datetime
import json
import os
import time
from decimal import Decimal

from pyspark.sql import functions as F

from arrears.operators import dependencies, store
from arrears.operators.common import DROP_SHUFFLES
from arrears.sources import readers, scan_store, schemas


def test_source_tree(spark, tmp_path):
    for path, text in {"one/app/a.py": "x = 1\n", "one/node_modules/b.js": "no",
                       "two/yarn.lock": "no", "two/README.md": "hé"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    (tmp_path / "two" / "bad.py").write_bytes(b"a = 1 \xff\n")
    rows = {(r["repo_id"], r["path"]): r["text"]
            for r in readers.source_tree(spark, str(tmp_path)).collect()}
    assert rows == {("one", "app/a.py"): "x = 1\n", ("two", "README.md"): "hé", ("two", "bad.py"): "a = 1 \n"}


def test_landed_feeds(spark, tmp_path):
    advisory = {"package": "flask", "version": "1.0", "aliases": ["GHSA-1", "CVE-2024-1"],
                "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}, {"type": "X", "score": "9.1"}],
                "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}]}]}
    (tmp_path / "osv.json").write_text(json.dumps(advisory))
    facts = dependencies.vulnerability_facts(readers.advisories(spark, str(tmp_path / "osv.json"))).first()
    assert (facts["cvss_score"], facts["cve_id"], facts["fixed_version"]) == (9.1, "CVE-2024-1", "1.2")
    files = spark.createDataFrame([("r", "requirements.txt", "Flask==1.0\nother\n")], schemas.SOURCE_FILES)
    item = dependencies.vulnerabilities(files, readers.advisories(spark, str(tmp_path / "osv.json"))).first()
    assert item["severity"] == "critical" and item["fixed_cost"] == Decimal("1540.44")
    (tmp_path / "rules.json").write_text(json.dumps({"key": "k", "defaultRemFn": "2h"}))
    assert readers.remediation_rules(spark, str(tmp_path / "rules.json")).first()["fixed_effort"] == "2h"
    (tmp_path / "survey.csv").write_text("seq,country,compensation,years\n1,\"US\",10.5,3\n")
    row = readers.survey(spark, str(tmp_path / "survey.csv"),
                         "seq long, country string, compensation double, years double").first()
    assert tuple(row) == (1, "US", 10.5, 3.0)


def test_store_round_trip_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    scans = spark.createDataFrame(
        [(f"r{i % 5}", f"s{i}", datetime.datetime(2025, 1, 1 + i), "complete", Decimal(i)) for i in range(20)],
        "repo_id string, scan_id string, created_at timestamp, status string, total_cost_usd decimal(18,2)")
    for _ in range(2):  # a rerun of the same batch replaces it
        scan_store.write_batch(scans, root, "scans", "b1")
    scan_store.write_batch(scans.withColumn("scan_id", F.concat("scan_id", F.lit("x"))), root, "scans", "b2")
    assert scan_store.read_table(spark, root, "scans").count() == 40
    one = scan_store.read_table(spark, root, "scans", "r3")
    assert one.count() == 8
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_id,r3)" in plan
    scan_store.write_batch(scans.filter("repo_id = 'r1'"), root, "scans", "b1")   # a smaller rerun leaves nothing behind
    assert scan_store.read_table(spark, root, "scans").count() == 24
    scan_store.write_batch(scans, root, "scans", "b1")
    assert store.latest_scans(scan_store.read_table(spark, root, "scans")).count() == 5


def test_store_limits_keep_the_leading_rows(spark):
    rows = spark.range(300).select(
        F.lit("r").alias("repo_id"), F.lit("s").alias("scan_id"), F.lit("high").alias("severity"),
        F.col("id").cast("decimal(18,2)").alias("cost_usd"), F.lit(0.5).alias("confidence"),
        F.concat(F.lit("f"), "id").alias("file_path"), F.col("id").alias("seq"))
    kept = scan_store.stored_findings(rows, 250, ("seq",))
    assert kept.count() == 250 and kept.agg(F.min("cost_usd")).first()[0] == 50
    assert scan_store.stored_findings(rows).count() == 300


def test_repository_payloads(spark):
    docs = spark.createDataFrame(
        [('{"id": 1, "full_name": "o/Engine", "language": "Go", "owner": {"login": "o"}}',), ("oops",)],
        "payload string")
    rows = readers.repository_payloads(docs)
    assert rows.filter(readers.matches_search(" ENGINE ")).first()["owner_login"] == "o"


DAY = datetime.datetime


def _scans(spark, rows):
    return spark.createDataFrame([(r, s, u, DAY(2025, 1, d), "complete", Decimal(c)) for r, s, u, d, c in rows],
                                 "repo_id string, scan_id string, user_id string, created_at timestamp, status string, total_cost_usd decimal(18,2)")


def _findings(spark, scans):
    rows = [(r["repo_id"], r["scan_id"], f"k{i}", "high", Decimal(i)) for r in scans.collect() for i in range(3)]
    return spark.createDataFrame(rows, "repo_id string, scan_id string, finding_key string, severity string, cost_usd decimal(18,2)").selectExpr(
        "*", "'f' AS file_path", "'c' AS category", "'s' AS subcategory", "0.5 AS confidence", "finding_key AS id", "1 AS step", "'open' AS status",
        "CAST(NULL AS INT) AS line_start", "'' AS symbol_name")


def _save(spark, root, batch, rows, repositories=None):
    scans = _scans(spark, rows)
    found = _findings(spark, scans)
    empty = {t: spark.createDataFrame([], schemas.STORE[t]) for t in ("debt_items", "module_summaries", "roadmap_items")}
    seen = None if repositories is None else spark.createDataFrame(repositories, "repo_id string, github_url string, user_id string, last_scanned_at timestamp")
    scan_store.save_scan(root, batch, scans, empty["debt_items"], found, empty["module_summaries"], empty["roadmap_items"], seen)


def test_two_saves_of_a_repository_give_one_row(spark, tmp_path):
    root = str(tmp_path / "store")
    _save(spark, root, "b1", [("r", "s1", "u1", 1, 5)], [("r", "https://github.com/o/r", "u1", DAY(2025, 1, 1)), ("q", None, None, None)])
    _save(spark, root, "b2", [("r", "s2", "u2", 2, 7)], [("r", "github.com/o/r/", "u2", DAY(2025, 1, 2))])
    repos, scans = (scan_store.read_table(spark, root, t) for t in ("repositories", "scans"))
    rows = {r.repo_id: r for r in repos.collect()}
    assert len(rows) == repos.count() == 2 and rows["r"].user_id == "u1" and rows["r"].last_scanned_at == DAY(2025, 1, 2)
    assert store.scans_with_keys(scans, repos).count() == 2
    listed = {r.repo_id: r for r in store.repository_list(repos, scans).collect()}
    assert listed["r"].total_scans == 2 and listed["r"].latest_cost == 7 and listed["q"].total_scans == 0
    assert store.portfolio(scans, repos, scan_store.read_table(spark, root, "findings")).count() == 2     # one row a user


def test_a_lost_job_leaves_the_answer_before_it(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    _save(spark, root, "b1", [("r", "s1", "u1", 1, 5), ("q", "s2", "u1", 1, 6)])
    seen = {t: sorted(map(str, scan_store.read_table(spark, root, t).collect())) for t in ("scans", "findings")}
    plain, landed = scan_store._land, []

    def lost(df, root, table):
        if landed:
            raise RuntimeError("lost")
        landed.append(table)
        return plain(df, root, table)

    monkeypatch.setattr(scan_store, "_land", lost)
    try:
        _save(spark, root, "b1", [("r", "s9", "u1", 1, 5)])
    except RuntimeError:
        pass
    monkeypatch.setattr(scan_store, "_land", plain)
    assert landed and seen == {t: sorted(map(str, scan_store.read_table(spark, root, t).collect())) for t in seen}
    _save(spark, root, "b1", [("r", "s9", "u1", 1, 5)])    # a rerun replaces all tables at once
    assert [r.scan_id for r in scan_store.read_table(spark, root, "scans").collect()] == ["s9"]
    assert {r.scan_id for r in scan_store.read_table(spark, root, "findings").collect()} == {"s9"}


def test_removal_of_a_repository(spark, tmp_path):
    root = str(tmp_path / "store")
    _save(spark, root, "b1", [("r", "s1", "u1", 1, 5), ("r", "s2", "u2", 1, 6), ("q", "s3", "u1", 1, 7)], [("r", "https://github.com/o/r", "u1", DAY(2025, 1, 1))])
    _save(spark, root, "b2", [("r", "s4", "u1", 2, 8)])
    assert scan_store.remove_repository(spark, root, "u1", "r", DAY(2025, 1, 3)) == 2
    assert scan_store.remove_repository(spark, root, "u1", "r", DAY(2025, 1, 3)) == 0
    _save(spark, root, "b3", [("r", "s5", "u1", 4, 9)])    # scanned again after it was removed

    def answers():
        return [sorted((r.scan_id, r.repo_id) for r in scan_store.read_table(spark, root, t).collect()) for t in ("scans", "findings")]

    left = answers()
    assert left[0] == [("s2", "r"), ("s3", "q"), ("s5", "r")] and {s for s, _ in left[1]} == {"s2", "s3", "s5"} and len(left[1]) == 9
    assert scan_store.purge(spark, root) == 2 and answers() == left and scan_store.purge(spark, root) == 0
    folders = scan_store._folders(spark, root)
    stored = [r.scan_id for (t, _), f in folders.items() if t == "scans" for r in spark.read.parquet(f).collect()]
    assert sorted(stored) == ["s2", "s3", "s5"]
    assert scan_store.read_table(spark, root, "repositories").count() == 1


def test_a_mistyped_store_is_an_error(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        scan_store.read_table(spark, str(tmp_path / "nowhere"), "findings")
    _save(spark, str(tmp_path / "store"), "b1", [("r", "s1", "u1", 1, 5)])
    assert scan_store.read_table(spark, str(tmp_path / "store"), "feedback").count() == 0
    assert scan_store.read_table(spark, str(tmp_path / "store"), "repositories").count() == 0


def test_pages_and_trends_of_a_saved_scan(spark, tmp_path):
    root = str(tmp_path / "store")
    _save(spark, root, "b1", [("r", f"s{i}", "u1", i + 1, 5) for i in range(4)])
    found, rollups, scans = (scan_store.read_table(spark, root, t) for t in ("findings", "finding_rollups", "scans"))
    first = store.next_page(found, "s2", limit=2).collect()
    rest = store.next_page(found, "s2", first[-1].seq, limit=2).collect()
    assert [r.finding_key for r in first + rest] == ["k2", "k1", "k0"]
    assert "GreaterThan(seq" in store.next_page(found, "s2", 5)._jdf.queryExecution().executedPlan().toString()
    trend = store.rolled_up_category_trend(store.history(scans, 2), rollups)
    assert sorted((r.scan_id, r.findings, r.cost_usd) for r in trend.collect()) == [("s2", 3, 3), ("s3", 3, 3)]
    assert "findings" not in {f.split("/version=")[0].rsplit("/", 1)[-1] for f in trend.inputFiles()}
    scan_store.append_events(scan_store.suppression_event(spark, "r", "s3", "k2", "noise", "me", DAY(2025, 2, 1)), root, "suppressions")
    events = [scan_store.read_table(spark, root, e) for e in ("suppressions", "feedback")]
    active = store.rolled_up_active_trend(store.history(scans, 2), rollups, found, *events)
    assert sorted((r.scan_id, r.active_finding_count, r.active_cost_usd) for r in active.collect()) == [("s2", 3, 3), ("s3", 2, 1)]


def test_advisories_of_one_package_are_counted_before_the_join(spark):
    """As many packages as advisories of one name: the counted rows grow with the packages, the sums are those of all pairs."""
    from arrears.operators import findings
    from arrears.operators.items import price_items
    from arrears.sources import schemas

    files = spark.createDataFrame([(f"r{i}", "requirements.txt", "Lib\nlib==1.0\n# x\nother") for i in range(20)], schemas.SOURCE_FILES)
    score = lambda s: [{"type": "N", "score": s}]
    records = spark.createDataFrame(
        [("lib", "unknown", ["CVE-%d" % i], score("9.5" if i % 2 else "n/a"), None) for i in range(30)]
        + [("lib", "1.0", None, score("5"), None), (None, "1.0", None, None, None)], schemas.ADVISORIES)
    every = price_items(dependencies.vulnerabilities(files, records))
    counted = price_items(dependencies.counted_vulnerabilities(files, records))
    assert (every.count(), counted.count()) == (20 * 31, 20 * 3)
    assert sorted(findings.category_costs(every).collect()) == sorted(findings.category_costs(counted).collect())


def test_findings_in_order_are_not_moved_again(spark, tmp_path, capsys):
    """Ranges of the finding order start with the repository: they are written as they are, each file in order."""
    rows = spark.range(40).selectExpr(
        "'r' || (id % 3) AS repo_id", "'s' || (id % 6) AS scan_id", "'k' || id AS id", "'f' || (id % 7) AS file_path", "'high' AS severity",
        "CAST(id AS DECIMAL(18,2)) AS cost_usd", "CAST(1 AS DECIMAL(18,2)) AS confidence", "1 AS step", "1 AS line_start", "'' AS symbol_name",
        "'' AS subcategory")
    ordered = scan_store.in_finding_order(rows)
    scan_store._layout(ordered, "findings", True).explain()
    assert "REBALANCE" not in capsys.readouterr().out.upper()
    scan_store.publish(str(tmp_path), "b", {"findings": ordered}, placed=("findings",))
    found = scan_store.read_table(spark, str(tmp_path), "findings")
    by_file = {}
    for r in found.select("repo_id", "scan_id", "seq", F.input_file_name().alias("file")).collect():
        by_file.setdefault(r["file"], []).append((r["repo_id"], r["scan_id"], r["seq"]))
    assert sum(map(len, by_file.values())) == 40 and all(part == sorted(part) for part in by_file.values())


def test_landed_tables_leave_no_shuffle(spark, tmp_path):
    """Files of a shuffle go with the table that needed it, not when the driver happens to collect its garbage."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def kept():
        return {n for top in folders for _, _, names in os.walk(top) for n in names if n.startswith("shuffle")}

    before = kept()
    rows = spark.range(300_000).selectExpr("CAST(id % 7 AS STRING) AS repo_id", "uuid() AS scan_id", "'a.py' AS file")
    scan_store.write_batch(rows, str(tmp_path), "debt_items", "one")
    for _ in range(50):   # executors delete in the background
        left = kept() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert scan_store.read_table(spark, str(tmp_path), "debt_items").count() == 300_000
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"
