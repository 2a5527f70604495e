"""Operators against brute force on small random input, hot groups included."""

import itertools
import random

from pyspark.sql import functions as F

from arrears.operators import architecture, history, rates, testgap
from arrears.operators.common import keep_last, top_per_group


def test_bus_factor_matches_ranking(spark):
    rng = random.Random(1)
    rows = [(f"k{k}", f"a{a}", rng.choice([1, 1, 1, 2, 3, 50]))
            for k in range(60) for a in range(rng.randint(1, 15))]
    rows += [("hot", f"a{a}", 1 + a % 3) for a in range(400)]
    df = spark.createDataFrame(rows, "repo_id string, author string, changes long")
    got = {r["repo_id"]: r["bus_factor"] for r in history.concentration(df, ["repo_id"]).collect()}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        counts = sorted((r[2] for r in group), reverse=True)
        total, run, need = sum(counts), 0, 0
        for count in counts:
            run, need = run + count, need + 1
            if run / total >= 0.8:
                break
        assert got[key] == need, key


def covered(stem, tests):
    names = [f"test_{stem}.py", f"{stem}_test.py"] + [
        f"{stem}.{kind}.{ext}" for kind in ("test", "spec") for ext in ("ts", "tsx", "js")]
    return any(t.lower().endswith(n) or f"/{stem}/" in t.lower() for t in tests for n in names)


def test_test_gap_rewrite_matches_suffix_rule(spark):
    rng = random.Random(2)
    words = ["a", "b", "ab", "test", "test_a", "_a", "b_test", "spec", "x.y"]
    tests = [rng.choice(["", "src/", "tests/", "a/b/", "spec/ab/"]) + rng.choice(
        ["test_{}.py", "{}_test.py", "{}.test.ts", "{}.spec.js", "{}.test.tsx", "{}.py", "x{}_test.py",
         "my_test_{}.py"]).format(rng.choice(words)) for _ in range(80)]
    stems = [w.lower() for w in words] + ["y", "t", "e_a", "zz"]
    for chunk in range(0, 80, 10):
        part = tests[chunk:chunk + 10]
        df = spark.createDataFrame([("r", p) for p in part], "repo_id string, path string")
        got = {r["stem"] for r in testgap.tested_stems(df).collect()}
        assert {s for s in stems if covered(s, part)} == {s for s in stems if s in got}, part


def components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    out = set()
    for n in nodes:
        group = {m for m in nodes if m in reach[n] and n in reach[m]}
        if len(group) > 1 or (n, n) in edges:
            out.add((min(group), n))
    return out


def test_import_cycles_match_reachability(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for g in range(12):
        n = rng.randint(2, 9)
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))}
        rows += [(f"g{g}", a, b) for a, b in edges]
        want |= {(f"g{g}", c, m) for c, m in components(edges)}
    df = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    got = {tuple(r) for r in architecture.import_cycles(df).select(
        "repo_id", "component", "module").collect()}
    assert got == want


def test_no_cycles_to_find(spark):
    empty = spark.createDataFrame([], "repo_id string, src string, dst string")
    assert architecture.import_cycles(empty).count() == 0
    line = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "c")],
                                 "repo_id string, src string, dst string")
    assert [r["module"] for r in architecture.import_cycles(line).collect()] == ["c"]


def test_cycles_of_long_chains(spark):
    ring = [("r", f"n{i:02d}", f"n{(i + 1) % 20:02d}") for i in range(20)]
    chain = [("r", f"z{i:02d}", f"z{i + 1:02d}") for i in range(20)] + [("r", "n03", "z00")]
    df = spark.createDataFrame(ring + chain, "repo_id string, src string, dst string")
    assert {r["module"] for r in architecture.import_cycles(df).collect()} == {
        f"n{i:02d}" for i in range(20)}


def test_a_longer_ring_is_one_cycle(spark):
    ring = spark.range(60).selectExpr("'r' AS repo_id", "'n' || id AS src", "'n' || ((id + 1) % 60) AS dst")
    found = architecture.import_cycles(ring)
    assert found.count() == 60 and found.select("component").distinct().count() == 1


def test_a_ring_of_thousands_ends_in_few_rounds(spark):
    """A ring of 2,000, one with a chord and branches, and a long chain that leads out of it."""
    n = 2000
    ring = [("r", f"n{i}", f"n{(i + 1) % n}") for i in range(n)]
    chord = [("q", f"n{i}", f"n{(i + 1) % n}") for i in range(n)] + [("q", "n5", "n900"), ("q", "n7", "n300"), ("q", "n1", "z0")]
    chord += [("q", f"z{i}", f"z{i + 1}") for i in range(300)] + [("q", "z300", "y0"), ("q", "y0", "y1"), ("q", "y1", "y0")]
    found = architecture.import_cycles(spark.createDataFrame(ring + chord, "repo_id string, src string, dst string"))
    got = {}
    for r in found.collect():
        got.setdefault((r.repo_id, r.component), set()).add(r.module)
    assert got == {("r", "n0"): {f"n{i}" for i in range(n)}, ("q", "n0"): {f"n{i}" for i in range(n)}, ("q", "y0"): {"y0", "y1"}}


def test_chains_between_branching_modules(spark):
    """Random graphs of long chains, where every component holds modules of degree one."""
    rng, rows, want = random.Random(8), [], set()
    for g in range(8):
        edges, number = set(), itertools.count()
        hubs = [f"h{i}" for i in range(rng.randint(1, 5))]
        for _ in range(rng.randint(1, 8)):
            path = [rng.choice(hubs), *[f"c{next(number):03d}" for _ in range(rng.choice([0, 1, 1, 2, 5]))], rng.choice(hubs)]
            edges |= set(zip(path, path[1:]))
        rows += [(f"g{g}", a, b) for a, b in edges]
        want |= {(f"g{g}", c, m) for c, m in components(edges)}
    df = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    assert {tuple(r) for r in architecture.import_cycles(df).collect()} == want


def test_upper_median(spark):
    rng = random.Random(4)
    rows = [(f"k{k}", round(rng.uniform(0, 5000), 2)) for k in range(20)
            for _ in range(rng.randint(1, 40))] + [("hot", float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: r["median"] for r in rates.upper_median(df, ["k"]).collect()}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        values = [v for _, v in group]
        assert got[key] == values[len(values) // 2]


def test_top_per_group_splits_hot_groups(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 20011).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    rows = [tuple(r) for r in df.collect()]
    groups = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        groups.setdefault(k, []).append(i)
    for limit in (1, 5, 1500, None):
        got = top_per_group(df, ["k"], order, limit)
        assert sorted((r["k"], r["position"], r["id"]) for r in got.collect()) == sorted(
            (k, n, i) for k, ids in groups.items() for n, i in enumerate(ids[:limit], 1))
    assert "WindowGroupLimit" in top_per_group(df, ["k"], order, 5)._jdf.queryExecution().executedPlan().toString()
    dense = top_per_group(df.withColumn("v", F.col("v") % 100), ["k"], [F.col("v")], 3, rank="dense_rank")
    least = {}
    for k, v, i in rows:
        least.setdefault(k, set()).add(v % 100)
    assert sorted(r["id"] for r in dense.collect()) == sorted(i for k, v, i in rows if v % 100 in sorted(least[k])[:3])


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, s int, v string")
    assert sorted(r["v"] for r in keep_last(df, ["k"], "s").collect()) == ["y", "z"]


def test_upper_median_of_many_different_values(spark):
    """A key with most of the rows, all different; null keys and values; keys with one value."""
    rng = random.Random(6)
    rows = [("hot", float(v)) for v in rng.sample(range(10**6), 20_001)] + [("one", 5.0), (None, 2.0), (None, 1.0), ("none", None)]
    rows += [("twice", v) for v in (1.0, 1.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    got = {r["k"]: (r["median"], r["sample_size"]) for r in rates.upper_median(df, ["k"]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (hot[10_000], 20_001), "one": (5.0, 1), None: (2.0, 2), "twice": (3.0, 4)}
    # Bounds that miss cost time, not the answer.
    keep = rates.MARGIN
    for rates.MARGIN in (0.0, -0.2):
        try:
            assert {r["k"]: r["median"] for r in rates.upper_median(df, ["k"]).collect()}["hot"] == hot[10_000]
        finally:
            rates.MARGIN = keep


def test_positions_of_all_rows(spark):
    """A group with a third of all rows lies in many tasks; nulls are a group; no window is over a whole group."""
    rng = random.Random(7)
    rows = [("hot", rng.randrange(500), i) for i in range(3000)] + [(rng.choice(["a", "b", None]), rng.randrange(5), i) for i in range(3000, 9000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = top_per_group(df, ["k"], [F.col("v").desc(), F.col("i")], None)
        got = [(r.k, r.v, r.i, r.position) for r in ranked.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want += [(*r, n) for n, r in enumerate(group, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "row_number" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert top_per_group(df.limit(0), ["k"], [F.col("v")], None).count() == 0
    assert [r.position for r in top_per_group(df, [], [F.col("i")], None).orderBy("i").collect()] == list(range(1, 9001))
