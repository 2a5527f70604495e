"""Hand-checked cases: small trees, histories and stores with known answers."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arrears.functions import scoring
from arrears.operators import (
    architecture, dependencies, findings, history, risk, smells, store, testgap,
)
from arrears.operators.facts import python_facts
from arrears.operators.items import price_items
from arrears.plans.estimate import Inputs, estimate, save
from arrears.sources import scan_store


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def types(df):
    return sorted(r["type"] for r in df.select("type").collect())


def test_scores(spark):
    score = scoring.debt_score(F.lit(2165.0), F.lit(10), F.lit(433.0))
    assert value(spark, score) == Decimal("5.00")
    assert value(spark, scoring.debt_score(F.lit(10.0), F.lit(0), F.lit(433.0))) == 0
    assert value(spark, scoring.price(F.lit(2.0), F.lit(100.0), F.lit("high"), F.lit(0.1))) == 60
    assert value(spark, scoring.complexity_severity(F.lit(0))) == "critical"
    assert value(spark, scoring.effort_minutes(F.lit("1.5d"))) == 720


def test_ownership_of_three_commits(commits):
    log = commits([(1, "A@x", "./app/service.py"), (2, "a@x ", "app/service.py"),
                   (3, "b@x", "app/service.py"), (4, "", "app/service.py")])
    row = history.file_ownership(log).first()
    assert (row["owner_count"], row["total_changes"], row["bus_factor"]) == (2, 3, 2)
    assert row["top_contributor_share"] == Decimal("0.67") and row["ownership_risk"] == "high"
    spots = log.select("repo_id", F.lit("app/service.py").alias("path")).distinct()
    total = history.ownership_summary(log, history.file_ownership(log), spots, "2025-01-10").first()
    assert total["commit_sample_size"] == 4 and total["unique_contributors"] == 2


def test_hotspots_use_oldest_commits_and_last_change(commits):
    log = commits([(i, "a", "m.py") for i in range(1, 61)] + [(61, "b", "new.py")])
    whole = {r["path"]: r["change_count"] for r in history.hotspots(log).collect()}
    assert whole == {"m.py": 60, "new.py": 1}
    rows = history.hotspots(log, 50).collect()
    assert [(r["path"], r["change_count"]) for r in rows] == [("m.py", 50)]
    assert rows[0]["last_changed"] == datetime.datetime(2025, 2, 20)


def test_team_defaults(spark, commits):
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    team = history.default_team(repos, history.team_profile(commits([(1, "a", "x.py")]), "2025-02-01"))
    rows = {r["repo_id"]: r for r in team.collect()}
    assert rows["empty"]["repo_age_days"] == 365 and rows["empty"]["total_commits"] == 0
    assert rows["r"]["active_contributors"] == 1 and rows["r"]["is_solo"]


def test_test_gaps(tree):
    files = tree({"app/service.py": "", "tests/test_other.py": "", "app/other.py": ""})
    spot = files.filter("path = 'app/service.py'")
    rows = testgap.test_gaps(files, spot).collect()
    assert [(r["file"], r["detail"]) for r in rows] == [("app/service.py", "hotspot_without_tests")]


def test_oversized_module(tree):
    body = "".join(f"def f{i}():\n" + "    x = 1\n" * 36 for i in range(12))
    assert types(architecture.oversized_modules(python_facts(tree({"big.py": body})))) == [
        "oversized_module"]


def test_duplicate_logic(tree):
    text = "def {}(a):\n    b = a + 1\n    return b\n"
    facts = python_facts(tree({"a.py": text.format("one"), "b.py": text.format("two")}))
    rows = smells.duplicate_logic(facts).collect()
    assert len(rows) == 2 and {float(r["remediation_hours"]) for r in rows} == {1.5}
    same_file = python_facts(tree({"a.py": text.format("one") + text.format("two")}))
    assert smells.duplicate_logic(same_file).count() == 0


def test_loose_versions(tree):
    files = tree({"requirements.txt": "requests>=2.0\nflask\n# no\n-e .\nok==1.0\nbad==1.*\n",
                  "package.json": '{"dependencies": {"a": "^1", "b": "latest", "c": "1.0"}}',
                  "sub/requirements.txt": "ignored\n"})
    found = dependencies.dependency_hygiene(files)
    assert types(found) == ["range_pinned_version", "range_pinned_version", "unbounded_version",
                            "wildcard_version", "wildcard_version"]
    assert dependencies.npm_dependencies(tree({"package.json": "{broken"})).count() == 0


def test_reliability_performance_dead_code(tree):
    facts = python_facts(tree({"x.py": (
        "def f(a=[]):\n    try:\n        return a\n    except:\n        pass\n\n"
        "def g(rows):\n    for r in rows:\n        for c in r:\n            pass\n\n"
        "def _helper():\n    return 1\n    print(2)\n")}))
    assert types(smells.reliability_smells(facts)) == [
        "bare_except", "mutable_default_argument", "silent_exception_handler"]
    assert types(smells.performance_smells(facts)) == ["nested_loop"]
    assert types(smells.dead_code(facts)) == ["unreachable_code", "unused_private_function"]


def test_complexity_counts(tree):
    text = ("def f(a, b):\n    if a and b or a:\n        return [x for x in a if x]\n"
            "    for y in a:\n        pass\n    else:\n        pass\n    assert b\n"
            "    def inner():\n        if a:\n            pass\n    return 1 if a else 2\n"
            "class K:\n    def m(self):\n        while True:\n            pass\n"
            "if True:\n    def nested():\n        pass\n")
    rows = {r["function"]: r["complexity"] for r in
            smells.measured_functions(python_facts(tree({"x.py": text}))).collect()}
    # f: if 1, boolean 2, comprehension 2, for-else 2, assert 1, conditional 1
    assert rows == {"f": 10, "m": 2}


def test_broken_and_skipped_files(tree):
    facts = python_facts(tree({"a.py": "def (:", "venv/b.py": "x = 1", "c_pb2.py": "def f(): pass",
                               "deep.py": "x = " + "(" * 150 + "1" + ")" * 150}))
    assert {r["path"] for r in facts.filter("kind = 'file'").collect()} == {"c_pb2.py", "deep.py"}
    assert {r["path"] for r in facts.filter("kind = 'parse_error'").collect()} == {"a.py"}
    assert smells.missing_docstrings(facts).count() == 0


def test_deep_nesting_keeps_every_fact(tree):
    total = " + ".join(["1"] * 3000)
    text = "import os\ntry:\n    pass\nexcept:\n    pass\n\ndef {}():\n    x = 0\n    return %s\n" % total
    facts = python_facts(tree({"a.py": text.format("f"), "b.py": text.format("g"), "none.py": None}))
    kinds = {r["path"]: r["n"] for r in facts.groupBy("path").agg(F.countDistinct("kind").alias("n")).collect()}
    assert kinds == {"a.py": 5, "b.py": 5, "none.py": 1}   # words, import, handler, function, file; or parse_error
    assert facts.filter("kind = 'function'").select("text").distinct().count() == 1
    assert smells.duplicate_logic(facts).count() == 2


def test_one_module_name_two_files(tree):
    names = [f"m{i}" for i in range(12)]
    half = lambda part: "".join(f"import {n}\n" for n in part)
    files = tree({**{f"{n}.py": "x = 1\n" for n in names}, "a/b.py": half(names[:6]), "a/b/__init__.py": half(names[6:]), "c.py": half(names)})
    facts = python_facts(files)
    edges = architecture.local_imports(architecture.import_rows(facts), architecture.known_modules(files))
    assert [r["file"] for r in architecture.high_fanout(edges).collect()] == ["c.py"]


def test_findings_modules_and_roadmap(spark):
    items = spark.createDataFrame(
        [("r", 1, "app/service.py", "code_quality", "high", "complexity_hotspot", "run", 10, 3.0, 0.8,
          "high", 210.0), ("r", 8, "app/api.py", "documentation", "low", "missing_docstring", "get", 4,
                           0.3, 0.65, "low", 10.0)],
        "repo_id string, step int, file string, category string, severity string, type string, "
        "function string, line int, remediation_hours double, confidence double, "
        "business_impact string, cost_usd double")
    for name in ("complexity", "change_count", "issue_text", "doc_type", "package"):
        items = items.withColumn(name, F.lit(None).cast("string"))
    items = items.withColumn("used_fallback", F.lit(False))
    owners = spark.createDataFrame([("r", "app/service.py", 2, 0.75, "high")],
                                   "repo_id string, path string, owner_count long, "
                                   "top_contributor_share double, ownership_risk string")
    found = findings.normalize_findings(findings.with_file_owners(items, owners))
    rows = found.orderBy(*findings.finding_order(*findings.FINDING_TIES)).collect()
    assert [r["symbol_name"] for r in rows] == ["run", "get"]
    assert rows[0]["owner_count"] == 2 and rows[1]["owner_count"] is None
    assert rows[0]["evidence"][0]["summary"] == "2 contributors, top contributor share 75%"
    module = findings.summarize_modules(found).first()
    assert module["module"] == "app" and module["total_cost_usd"] == 220
    assert {r["bucket"] for r in findings.roadmap(found).collect()} == {"quick_wins", "next_up"}


def stored(spark, rows):
    return spark.createDataFrame(rows, (
        "scan_id string, finding_key string, module string, category string, severity string, "
        "cost_usd decimal(18,2), confidence double, status string, file_path string, seq long"))


def scans(spark):
    t = datetime.datetime
    return spark.createDataFrame(
        [("r", "s1", t(2025, 1, 1), "complete", Decimal(1000), Decimal("4.0"), Decimal(10), "u"),
         ("r", "s2", t(2025, 2, 1), "complete", Decimal(1300), Decimal("4.8"), Decimal(12), "u"),
         ("r", "s3", t(2025, 3, 1), "failed", Decimal(1), Decimal("1"), Decimal(1), "u")],
        "repo_id string, scan_id string, created_at timestamp, status string, "
        "total_cost_usd decimal(18,2), debt_score decimal(18,2), total_hours decimal(18,2), "
        "user_id string")


def test_comparison_and_changes(spark):
    found = stored(spark, [
        ("s1", "a", "m", "security", "medium", Decimal(1), 0.9, "open", "a.py", 1),
        ("s1", "b", "m", "security", "low", Decimal(2), 0.9, "open", "b.py", 2),
        ("s2", "b", "m", "security", "high", Decimal(3), 0.9, "open", "b.py", 1),
        ("s2", "c", "m", "security", "low", Decimal(4), 0.9, "open", "c.py", 2),
        ("s2", "c", "m", "security", "low", Decimal(9), 0.9, "open", "c2.py", 3)])
    pairs = store.scan_pairs(scans(spark))
    changes = store.compare(pairs, found)
    assert {(r["finding_key"], r["change"], r["severity_change"]) for r in changes.collect()} == {
        ("a", "removed", None), ("b", "common", "worsened"), ("c", "added", None)}
    assert changes.filter("finding_key = 'c'").first()["latest_cost_usd"] == 9
    counts = found.groupBy("scan_id").agg(F.count("*").alias("findings"))
    total = store.compare_summary(pairs, counts).first()
    assert total["cost_delta_usd"] == 300 and total["debt_score_delta"] == Decimal("0.80")
    assert {r["state"]: r["findings"] for r in store.change_rollup(changes).collect()} == {
        "new": 1, "existing": 1, "resolved": 1}


def test_triage(spark):
    found = stored(spark, [("s2", k, "m", "security", "high", Decimal(c), 0.9, s, "a.py", i)
                           for i, (k, c, s) in enumerate([("a", 520, "open"), ("b", 5, "open"), ("c", 7, "open")])])
    now = datetime.datetime(2025, 3, 1)
    muted = scan_store.suppression_event(spark, "r", "s2", "b", "noise", "me", now)
    notes = scan_store.feedback_event(spark, "r", "s2", "c", "accepted_risk", now)
    rows = store.with_triage(found, muted, notes)
    assert scan_store.find_finding(found, "s2", "b").first()["cost_usd"] == 5
    assert store.scan_by_id(scans(spark), "s1", "u").count() == 1
    assert store.scan_by_id(scans(spark), "s1", "other").count() == 0
    stats = store.triage_stats(rows, ["scan_id"]).first()
    assert tuple(stats)[1:5] == (3, 1, 1, 1) and stats["suppression_rate"] == Decimal("33.3")
    assert [r["finding_key"] for r in store.top_unresolved(rows, ["scan_id"]).collect()] == ["a"]
    trend = store.active_trend(store.history(scans(spark), 20), rows)
    assert {r["scan_id"]: (r["active_finding_count"], r["active_cost_usd"]) for r in trend.collect()} \
        == {"s1": (0, 0), "s2": (1, 520)}
    later = scan_store.feedback_event(spark, "r", "s2", "b", "false_positive",
                                      now + datetime.timedelta(1))
    state = store.derived_status(found, muted, later).filter("finding_key = 'b'").first()
    assert state["status"] == "reviewed"


def test_trend_and_query(spark):
    trend = store.debt_trend(scans(spark)).first()
    assert trend["direction"] == "up" and trend["change_pct"] == 30 and trend["total_scans"] == 2
    found = stored(spark, [
        ("s1", "f-1", "m", "code_quality", "high", Decimal(9), 0.9, "open", "a", 1),
        ("s1", "f-2", "m", "code_quality", "medium", Decimal(9), 0.9, "open", "a", 2),
        ("s1", "f-3", "m", "security", "critical", Decimal(9), 0.9, "open", "a", 3)])
    kept = store.query_findings(found, category="code_quality", severity="HIGH")
    assert kept.count() == 1
    assert store.page(kept, findings.finding_order("seq"), 1).first()["finding_key"] == "f-1"


def test_rules_defaults(spark):
    rules = spark.createDataFrame([("k", "MAJOR", None, "20min", None)],
                                  "rule_key string, severity string, type string, "
                                  "base_effort string, fixed_effort string")
    rows = {r[0]: r[1] for r in risk.minutes_by_complexity(risk.parsed_rules(rules)).collect()}
    assert rows == {"low": 10.0, "medium": 20.0, "high": 60.0, "critical": 120.0}


def test_repo_totals_price_import_cycles(spark, tree, commits, monkeypatch):
    """The totals of a repository hold all of the estimate: its import cycles are counted and priced."""
    from arrears.catalog import composites

    files = tree({"app/a.py": "import app.b\ndef one(a):\n    return a\n", "app/b.py": "import app.a\ndef two(a):\n    return a\n"})
    rules = spark.createDataFrame([], "rule_key string, minutes int, severity string, type string")
    log = commits([(1, "a@x", "app/a.py")])
    monkeypatch.setattr(composites, "inputs", lambda t: Inputs(files, log, rules))
    row = composites.full_totals(None).first()
    items = [r for r in estimate(Inputs(files, log, rules)).items.collect()]
    assert [r["type"] for r in items].count("cyclic_dependency") == 1
    assert row["issues_found"] == len(items)
    assert row["total_hours"] >= 10
    assert float(row["cost_per_function"]) == pytest.approx(float(row["total_cost_usd"]) / 2, abs=0.01)


def test_full_estimate(spark, tree, commits, tmp_path):
    dup = "def {}(a):\n    b = a + 1\n    return b\n"
    files = tree({"app/a.py": "import app.b\n" + dup.format("one"),
                  "app/b.py": "import app.a\n" + dup.format("two"), "requirements.txt": "flask\n"})
    rules = spark.createDataFrame([], "rule_key string, minutes int, severity string, type string")
    settings = spark.createDataFrame([("r", 100.0, 100.0, 50.0, 2.0, 433.0)],
                                     "repo_id string, base_rate double, security_rate double, "
                                     "documentation_rate double, multiplier double, benchmark double")
    scanner = spark.createDataFrame([("r", "./app/a.py", 1, "x", "HIGH", "LOW", "B1", "CWE-79")],
                                    "repo_id string, filename string, line_number int, "
                                    "issue_text string, issue_severity string, "
                                    "issue_confidence string, test_id string, cwe_id string")
    log = commits([(1, "a@x", "app/a.py"), (2, "b@x", "app/a.py")])
    result = estimate(Inputs(files, log, rules, settings, scanner))
    kinds = {r["type"]: r["n"] for r in
             result.items.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"complexity_hotspot": 1, "cyclic_dependency": 1, "duplicate_logic": 2,
                     "missing_docstring": 2, "missing_tests": 2, "unbounded_version": 1,
                     "security_hotspot": 1}
    cost = result.items.filter("type = 'cyclic_dependency'").first()["cost_usd"]
    assert cost == Decimal("1008.00")  # 10 h * 120 * 1.2 * 0.7
    assert result.items.filter("type = 'security_hotspot'").first()["cost_usd"] == 800
    assert result.findings.filter("file_path = 'app/a.py'").first()["owner_count"] == 2
    totals = result.totals.first()
    items = sum(r["cost_usd"] for r in result.items.select("cost_usd").collect())
    base = Decimal("12.60")  # 2 functions * 0.2 h * 100 * 0.9 * 0.35
    assert totals["total_cost_usd"] == (items + base) * 2
    quality = result.categories.filter("category = 'code_quality'").first()
    assert quality["item_count"] == 3
    assert price_items(smells.missing_docstrings(result.facts)).count() == 2
    for _ in range(2):
        save(result, str(tmp_path), "batch-1", "2025-03-01")
    saved = {t: scan_store.read_table(spark, str(tmp_path), t) for t in
             ("scans", "debt_items", "findings", "module_summaries", "roadmap_items")}
    assert {t: df.count() for t, df in saved.items()} == {
        "scans": 1, "debt_items": 10, "findings": 10, "module_summaries": 2, "roadmap_items": 10}
    assert store.latest_scans(saved["scans"]).first()["total_cost_usd"] == totals["total_cost_usd"]
    # What was saved answers the questions of the store.
    scan = saved["scans"].first()
    assert '"code_quality"' in scan_store.lean_payload(saved["scans"]).first()["cost_by_category"]
    event = scan_store.feedback_event(spark, "r", scan["scan_id"], saved["findings"].first()["finding_key"], "accepted_risk",
                                      datetime.datetime(2025, 3, 2))
    scan_store.append_events(event, str(tmp_path), "feedback")
    events = [scan_store.read_table(spark, str(tmp_path), e) for e in ("suppressions", "feedback")]
    rows = store.with_triage(saved["findings"], *events)
    stats = store.triage_stats(rows, ["scan_id"]).first()
    assert (stats["total_findings"], stats["active_findings"], stats["reviewed_findings"]) == (10, 9, 1)
    assert store.top_unresolved(rows, ["scan_id"]).count() == 9
    assert store.compare(store.scan_pairs(saved["scans"]), saved["findings"]).filter("change = 'added'").count() == 10
    categories = saved["findings"].groupBy("scan_id", "category").agg(F.sum("cost_usd").alias("cost_usd"))
    repos = scan_store.read_table(spark, str(tmp_path), "repositories")
    assert store.portfolio(saved["scans"], repos, categories).first()["repo_key"] == "r"
    assert store.scan_summary(saved["scans"]).count() == 1
    # Every lean field of the saved scan is the estimate's own.
    lean = scan_store.lean_payload(saved["scans"]).first()
    document = {k: json.loads(lean[k]) for k in scan_store.LEAN if k != "executive_summary"}
    assert lean["executive_summary"].startswith("The repository carries about $") and "core module" not in lean["executive_summary"]
    summary = {r["category"]: r for r in result.categories.collect()}
    assert {k: (v["cost_usd"], v["item_count"]) for k, v in document["cost_by_category"].items()} == {
        k: (float(r["cost_usd"]), r["item_count"]) for k, r in summary.items()}
    owners = result.ownership_summary.first()
    assert all(float(document["ownership_summary"][k]) == float(owners[k]) for k in ("unique_contributors", "commit_sample_size", "bus_factor"))
    assert document["hourly_rates"]["blended_rate"] == 100.0 and document["hourly_rates"]["sources_used"] == ["BLS fallback"]
    assert len(document["priority_actions"]) == 3 and [a["rank"] for a in document["priority_actions"]] == [1, 2, 3]
    assert document["roi_analysis"]["total_fix_cost"] == float(totals["total_cost_usd"]) and document["sanity_check"]["assessment"]
    assert float(lean["total_cost_usd"]) == float(totals["total_cost_usd"]) and document["llm_insights"] == {} and document["data_sources_used"] == []
    told = store.scan_summary(saved["scans"]).first()
    assert json.loads(told["summary"])["functions_analyzed"] == 2
