"""Whole jobs: the full estimate, profile, narrative texts and report, ticket and message rows."""

from pyspark.sql import functions as F

from arrears import constants as C
from arrears.catalog import python_code as pc
from arrears.catalog import stored as st
from arrears.catalog import texts as tx
from arrears.catalog.base import CATEGORY_OF_PART, D, NAME, R, RANK, SEQ, TITLE, query
from arrears.catalog.histories import CONCENTRATION, MINUTES, landed_rules
from arrears.catalog.rating import BLENDED, blended_table
from arrears.catalog.scalars import IMPACT_SQL, PRICE_SQL
from arrears.operators import findings as fops
from arrears.operators import reports, store
from arrears.operators.risk import parsed_rules
from arrears.plans import estimate as est
from arrears.plans.profile import profile
from arrears.sources import schemas

# --- full estimate over the Python files -----------------------------------------------------------

# What the profile and the rates say of the repositories below: all are Python without a framework.
BASE, DOC = "(SELECT base FROM step0)", "(SELECT doc FROM step0)"
STEP0 = f"""{BLENDED}, step0 AS (SELECT max(mid_rate) AS base, max(junior_rate) AS doc FROM blended WHERE technology =
'Py'), team_commits AS (SELECT repo_id, commit_seq, 'dev' || (commit_seq % 4) AS author, day FROM changes),
team_counts AS (SELECT repo_id, author, count(*) AS n FROM team_commits GROUP BY ALL), team AS (SELECT repo_id, {R('''CAST(CASE
WHEN age < 180 THEN 0.8 ELSE 1 END AS DOUBLE) * CAST(CASE WHEN bus_factor = 1 THEN 2.0 WHEN bus_factor = 2 THEN 1.5
WHEN bus_factor <= 4 THEN 1.2 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN team_size = 1 THEN 1.5 WHEN team_size <= 3
THEN 1.2 ELSE 1.0 END AS DOUBLE)''')} AS multiplier FROM (SELECT repo_id, count(DISTINCT author) AS team_size,
arg_max(day, commit_seq) - arg_min(day, commit_seq) AS age FROM team_commits GROUP BY repo_id) JOIN
{CONCENTRATION('team_counts', 'repo_id')} c USING (repo_id))"""


def inputs(t):
    sources = pc.source_files(t)
    commits = pc.code_changes(t).selectExpr(
        "repo_id", "commit_seq", "'c' || commit_seq AS commit_id",
        "'dev' || (commit_seq % 4) AS author_email", "author_date", "new_path", "old_path",
        "added_lines")
    return est.Inputs(sources, commits, parsed_rules(landed_rules(t)), as_of="2020-02-01", blended=blended_table(t),
                      benchmark=t.spark.range(1).selectExpr("433.0D AS cost_per_function_usd"))


ALL_ITEMS = f"""{pc.FILES}, {MINUTES}, {pc.MEASURED}, {pc.DOCS}, {pc.BODIES}, {pc.EDGES}, {pc.SUSPECTS}, {STEP0},
spots AS (SELECT repo_id, new_path AS path, count(*) AS n FROM changes WHERE NOT
  regexp_matches(new_path, '(^|/)vendor/') GROUP BY ALL),
per_file AS (SELECT repo_id, path, {NAME(f'''max({RANK("CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 15 THEN 'high' ELSE 'critical' END")})''')}
  AS severity FROM measured GROUP BY repo_id, path),
with_spots AS (SELECT repo_id, path, severity, minutes, CAST(CASE WHEN n >= 20 THEN 3.0 WHEN n >= 11 THEN 2.2 WHEN n >= 6 THEN
  1.7 WHEN n >= 3 THEN 1.3 ELSE 1.0 END AS DOUBLE)
  AS churn, n FROM per_file JOIN spots USING (repo_id, path) JOIN minutes USING (severity)),
risky AS (SELECT repo_id, path, ROUND(CAST({PRICE_SQL('minutes * churn / 60', '84.55',
  IMPACT_SQL('severity', 'churn', 'n'), '0.8')} * CASE WHEN probability > 0.3 THEN 1.5::DOUBLE ELSE 1 END AS
  DECIMAL(38,8)), 2) AS cost, ROUND(CAST(minutes * churn / 60 AS DECIMAL(38,8)), 6) AS hours FROM with_spots
  LEFT JOIN suspects USING (repo_id, path)),
groups AS (SELECT repo_id, body, count(*) AS n FROM bodies GROUP BY ALL HAVING count(DISTINCT path) >= 2),
hits AS (
SELECT repo_id, 3 AS step, 'duplicate_logic' AS type, {D('least(8, 1.5 + (n - 2) * 1.25)')} AS h, {BASE} AS
  rate, 'medium' AS i, 0.7 AS c FROM bodies JOIN groups USING (repo_id, body)
UNION ALL SELECT repo_id, 2, 'oversized_module', 8, {BASE}::DOUBLE * 1.2::DOUBLE, 'high', 0.7 FROM files WHERE
  live AND tpl = 9 AND s >= 25
UNION ALL SELECT repo_id, 2, 'high_fanout_module', 5, {BASE}::DOUBLE * 1.2::DOUBLE, 'medium', 0.7 FROM edges
  GROUP BY repo_id, src HAVING count(*) >= 10
UNION ALL SELECT repo_id, 4, unnest(['bare_except', 'silent_exception_handler']), 2, {BASE}, unnest(['medium',
  'high']), 0.7 FROM files WHERE plain AND tpl = 0
UNION ALL SELECT repo_id, 4, unnest(['broad_exception', 'mutable_default_argument']), unnest([1.5, 1.25]),
  {BASE}, 'medium', 0.7 FROM files WHERE plain AND tpl = 1
UNION ALL SELECT repo_id, 5, unnest(['accumulation_in_loop', 'nested_loop', 'accumulation_in_loop']),
  unnest([1.25, 1.5, 1.25]), {BASE}, 'medium', 0.7 FROM files WHERE plain AND tpl = 2
UNION ALL SELECT repo_id, 5, unnest(['accumulation_in_loop', 'append_on_expression_in_loop']),
  unnest([1.25, 1.0]), {BASE}, unnest(['medium', 'low']), 0.7 FROM files WHERE plain AND tpl = 3
UNION ALL SELECT repo_id, 6, unnest(['unreachable_code', 'unreachable_code', 'unused_private_function']),
  unnest([0.5, 0.5, 0.75]), {BASE}, 'low', 0.7 FROM files WHERE plain AND tpl = 4
UNION ALL SELECT repo_id, 8, 'missing_docstring', 0.166667, {DOC}, 'low', 0.65 FROM docs
UNION ALL SELECT f.repo_id, 9, 'missing_tests', CASE WHEN r.path IS NULL THEN 2 ELSE 4 END, 84.55, CASE WHEN
  r.path IS NULL THEN 'medium' ELSE 'high' END, 0.7 FROM files f LEFT JOIN risky r USING (repo_id, path) WHERE
  live),
all_items AS (SELECT repo_id, 1 AS step, 'complexity_hotspot' AS type, cost, hours FROM risky UNION ALL SELECT
  repo_id, step, type, CAST({PRICE_SQL('h', 'rate', 'i', 'c')} AS DECIMAL(18,2)), CAST(h AS DECIMAL(18,6))
  FROM hits)"""


@query("cmp7_items_by_rule", "CMP7 SET1 JON4 SRC2 PRJ5",
       f"""WITH {ALL_ITEMS} SELECT repo_id, step, type, count(*) AS items, {D('sum(cost)')} AS cost_usd,
           {D('sum(hours)')} AS hours FROM all_items GROUP BY ALL""")
def items_by_rule(t):
    result = est.estimate(inputs(t), cycles=False)
    return result.items.groupBy("repo_id", "step", "type").agg(
        F.count("*").alias("items"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("remediation_hours").alias("hours"))


CYCLES = """reach AS (SELECT repo_id, src, dst FROM edges WHERE dst % 10 = 8 UNION SELECT r.repo_id, r.src,
e.dst FROM reach r JOIN edges e ON e.repo_id = r.repo_id AND e.src = r.dst WHERE e.dst % 10 = 8),
cycles AS (SELECT repo_id, count(DISTINCT component) AS n FROM (SELECT a.repo_id, min(b.src) AS component, a.src
FROM reach a JOIN reach b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src GROUP BY a.repo_id,
a.src) GROUP BY repo_id)"""


@query("cmp7_repo_totals", "CMP7 AGG9 AGG10 PRJ19 PRJ20",
       f"""WITH RECURSIVE {ALL_ITEMS}, {CYCLES}, fns AS (SELECT repo_id, count(*) AS n FROM measured GROUP BY repo_id),
           priced AS (SELECT repo_id, 1 AS k, cost, hours FROM all_items UNION ALL SELECT repo_id, n, n *
           {PRICE_SQL('10', f'{BASE}::DOUBLE * 1.2::DOUBLE', "'high'", '0.7')}, n * 10 FROM cycles), sums AS (
           SELECT repo_id, CAST(sum(k) AS BIGINT) AS items, sum(cost)::DOUBLE AS c, sum(hours)::DOUBLE AS h FROM priced
           GROUP BY repo_id), x AS (SELECT repo_id, items, n, (c + {R(f'''n::DOUBLE * 0.2::DOUBLE *
           {BASE}::DOUBLE * 0.9::DOUBLE * 0.35::DOUBLE''')}) * multiplier::DOUBLE AS cost, h + n::DOUBLE *
           0.2::DOUBLE * multiplier::DOUBLE AS hours FROM sums JOIN fns USING (repo_id) JOIN team USING (repo_id))
           SELECT repo_id, n AS functions_analyzed, items AS issues_found, {R('cost')} AS total_cost_usd,
           {R('hours')} AS total_hours, {R('hours / 80')} AS total_sprints,
           {R('least(10::DOUBLE, cost / n::DOUBLE / 433.0::DOUBLE * 10)')} AS debt_score, {R('cost / n::DOUBLE')} AS
           cost_per_function, {R('(cost / n::DOUBLE - 433.0::DOUBLE) / 433.0::DOUBLE * 100::DOUBLE')} AS variance_pct,
           cost / n::DOUBLE <= 433 OR (cost / n::DOUBLE - 433.0::DOUBLE) / 433.0::DOUBLE * 100 < 150 AS is_reasonable,
           CASE WHEN cost / n::DOUBLE < 433 * 0.5 THEN 'Lower than industry average - code may be well-maintained'
           WHEN cost / n::DOUBLE < 433 THEN 'Slightly below industry average - reasonable condition'
           WHEN cost / n::DOUBLE < 433 * 1.5 THEN 'Slightly above industry average - some technical debt present'
           WHEN cost / n::DOUBLE < 433 * 2 THEN 'Above industry average - significant technical debt'
           ELSE 'Significantly above industry average - high technical debt' END AS assessment FROM x""")
def full_totals(t):
    """Totals of the complete estimate, import cycles included, and their check against the benchmark."""
    return est.estimate(inputs(t)).totals.select(
        "repo_id", "functions_analyzed", "issues_found", "total_cost_usd", "total_hours",
        "total_sprints", "debt_score", "cost_per_function", "variance_pct", "is_reasonable", "assessment")


FOUND = ("security_hotspot", "vulnerability", "unbounded_version", "wildcard_version", "range_pinned_version")


@query("cmp7_scanner_and_advisories", "CMP7 CMP4 CMP6 CMP3 SET1 FLT3",
       f"""WITH {tx.PACKAGES}, {tx.ADVISORIES}, {tx.HYGIENE}, all_items AS (
           SELECT 'm' || (p_partkey // 20) AS repo_id, 'security_hotspot' AS type, {R("""CASE s WHEN 'HIGH' THEN 8 ELSE 4 END * 84.55::DOUBLE""")} AS cost
           FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS s, p_partkey % 3 AS c FROM part)
           WHERE s = 'HIGH' OR (s = 'MEDIUM' AND c < 2)
           UNION ALL SELECT repo_id, 'vulnerability', {R("""CASE WHEN cvss_score IS NULL THEN 2 WHEN cvss_score >= 9 THEN 12 WHEN cvss_score >= 7 THEN 6
           WHEN cvss_score >= 4 THEN 3 ELSE 1 END::DOUBLE * 128.37::DOUBLE""")} FROM packages JOIN advisories USING (package, version)
           UNION ALL SELECT repo_id, type, {PRICE_SQL("CASE WHEN type = 'wildcard_version' THEN 1.5 ELSE 0.75 END::DOUBLE", '84.55', "'medium'", '0.85')} FROM issues
           WHERE type IS NOT NULL) SELECT repo_id, type, count(*) AS items, {D('sum(cost)')} AS cost_usd FROM all_items GROUP BY ALL""")
def scanner_and_advisories(t):
    """The whole estimate of repositories of manifests, with scanner results and advisories among its inputs."""
    files = tx.manifests(t)
    results = t.read("part").selectExpr(
        "'m' || (p_partkey div 20) AS repo_id", "'src/' || p_partkey AS filename", "CAST(p_partkey AS INT) AS line_number",
        "p_name AS issue_text", "CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS issue_severity",
        "CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS issue_confidence", "'B1' AS test_id", "'CWE-UNKNOWN' AS cwe_id")
    settings = files.select("repo_id").distinct().selectExpr(
        "repo_id", "84.55D AS base_rate", "84.55D AS security_rate", "55.1D AS documentation_rate", "1.0D AS multiplier", "433.0D AS benchmark")
    history = t.spark.createDataFrame([], schemas.COMMIT_FILES)
    result = est.estimate(est.Inputs(files, history, parsed_rules(landed_rules(t)), settings, results, tx.advisories(t), as_of="2020-02-01"), cycles=False)
    return result.counted_items.filter(F.col("type").isin(*FOUND)).groupBy("repo_id", "type").agg(
        F.sum("copies").alias("items"), F.sum(F.col("cost_usd") * F.col("copies")).alias("cost_usd"))


@query("cmp8_estimate_roadmap", "CMP8 CMP9 CMP12 GRF1 JON2")
def estimate_roadmap(t):
    """Roadmap of the complete estimate, import cycles included (checked in the unit tests)."""
    return est.estimate(inputs(t)).roadmap.select("repo_id", "bucket", "position", "title", "cost_usd")


@query("cmp8_estimate_findings", "CMP8 CMP7 GRF1 SET1 PRJ8",
       f"""WITH RECURSIVE {ALL_ITEMS}, {CYCLES} SELECT repo_id, type AS subcategory, count(*) AS findings,
           {D('sum(cost)')} AS cost_usd FROM all_items GROUP BY ALL UNION ALL SELECT repo_id,
           'cyclic_dependency', n, n * {PRICE_SQL('10', f'{BASE}::DOUBLE * 1.2::DOUBLE', "'high'", '0.7')} FROM
           cycles""")
def estimate_findings(t):
    return est.estimate(inputs(t)).findings.groupBy("repo_id", "subcategory").agg(
        F.count("*").alias("findings"), F.sum("cost_usd").alias("cost_usd"))


@query("cmp13_repository_profile", "CMP13 AGG14 AGG12 AGG32 PRJ16",
       f"""WITH {pc.FILES}, {pc.SUSPECTS}, {BLENDED}, commits AS (SELECT repo_id, commit_seq, 'dev' ||
           (commit_seq % 4) AS author, day FROM changes), counts AS (SELECT repo_id, author, count(*) AS n FROM
           commits GROUP BY ALL), found AS (SELECT repo_id, count(*) AS n FROM suspects WHERE probability > 0.3
           GROUP BY repo_id), team AS (SELECT repo_id, count(DISTINCT author) AS team_size, arg_max(day,
           commit_seq) - arg_min(day, commit_seq) AS age FROM commits GROUP BY repo_id)
           SELECT repo_id, 'py' AS primary_language, team_size, bus_factor, {R('''CAST(CASE WHEN age < 180 THEN
           0.8 ELSE 1 END AS DOUBLE) * CAST(CASE WHEN bus_factor = 1 THEN 2.0 WHEN bus_factor = 2 THEN 1.5 WHEN
           bus_factor <= 4 THEN 1.2 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN team_size = 1 THEN 1.5 WHEN
           team_size <= 3 THEN 1.2 ELSE 1.0 END AS DOUBLE)''')} AS combined_multiplier, (SELECT mid_rate FROM
           blended WHERE technology = 'Py') AS base_rate, coalesce(n, 0) AS total_suspected, CASE WHEN n IS NULL
           THEN 'No obvious AI-generated code patterns' WHEN n > 20 THEN 'High AI usage detected - consider code
review' ELSE 'Review suspected files for quality issues' END AS recommendation FROM team JOIN
           {CONCENTRATION('counts', 'repo_id')} c USING (repo_id) LEFT JOIN found USING (repo_id)"""
       .replace("consider code\nreview", "consider code review"))
def repository_profile(t):
    """One row per repository from stack, team, rates and generated-code results."""
    given = inputs(t)
    found = profile(given.source_files, given.commit_files, pc.facts(t), blended_table(t), "2020-02-01")
    return found.select("repo_id", "primary_language", "team_size", "bus_factor",
                        "combined_multiplier", "base_rate", "total_suspected", "recommendation")


# --- narrative rows --------------------------------------------------------------------------------

TOP = f"""(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {st.ORDER}, seq) AS position FROM
findings)"""
HINT = """CASE category WHEN 'architecture' THEN 'Split responsibilities or break module coupling' WHEN
'test_debt' THEN 'Add focused behavior tests around the hotspot' WHEN 'security' THEN 'Patch the vulnerable
code path and add a regression test' WHEN 'dependency' THEN 'Pin and upgrade the dependency safely' ELSE
'Refactor the hotspot and simplify the code path' END""".replace("\n", " ")


def _triage(t):
    return reports.triage_rows(t.findings, ["scan_id"], fops.finding_order("seq"))


@query("prj24_triage", "PRJ24 SRT11",
       f"""SELECT scan_id, position, finding_key AS finding_id, category AS debt_type, CASE WHEN category =
           'architecture' THEN 'module' ELSE 'file' END AS remediation_scope, {HINT} AS action_hint FROM
           {TOP} WHERE position <= 5""", ("findings",))
def triage(t):
    return _triage(t).select("scan_id", "position", "finding_id", "debt_type", "remediation_scope",
                             "action_hint")


@query("cmp10_priority_actions", "CMP10 JON12 SRT11",
       f"""WITH top AS {TOP}, hints AS (SELECT scan_id, finding_key, arg_max({HINT}, position) AS hint FROM top
           WHERE position <= 5 GROUP BY ALL)
           SELECT scan_id, position AS rank, 'Remediate ' || replace(category, '_', ' ') || ' in ' || module
           AS title, module AS file_or_module, coalesce(hint, '{C.DEFAULT_WHY}') AS why,
           {R('effort_hours', 1)} AS estimated_hours, {D('cost_usd')} AS estimated_cost,
           {R('cost_usd::DOUBLE * 0.015::DOUBLE')} AS saves_per_month, 'Sprint ' || position AS sprint FROM top
           LEFT JOIN hints USING (scan_id, finding_key) WHERE position <= 3""", ("findings",))
def priority_actions(t):
    return reports.priority_actions(t.findings, _triage(t), ["scan_id"], fops.finding_order("seq"))


LEAD = f"""{st.MODULES}, lead AS (SELECT scan_id, arg_min(module, p) AS module FROM (SELECT *, row_number()
OVER (PARTITION BY scan_id ORDER BY {RANK('max_severity')} DESC, total_cost_usd DESC, module) AS p FROM
modules) GROUP BY scan_id)"""
REVIEW = ("'Architecture risk is concentrated in ' || module || ' and related structural hotspots.'")


def _reviews(t):
    return reports.architecture_reviews(t.scans, st.modules(t), t.findings, ["scan_id"],
                                        fops.module_order())


@query("prj25_architecture_review", "PRJ25",
       f"""WITH {LEAD} SELECT scan_id, coalesce({REVIEW}, '') AS summary, CASE WHEN module IS NULL THEN '' ELSE
           '{C.ARCHITECTURE_BOUNDARY}' END AS recommended_boundary FROM scans LEFT JOIN lead USING (scan_id)""",
       ("scans", "findings"))
def architecture_review(t):
    return _reviews(t)


@query("prj25_test_gap_review", "PRJ25",
       f"""WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {st.ORDER},
           seq) AS position FROM findings WHERE category = 'test_debt') WHERE position = 1)
           SELECT scan_id, coalesce('Test coverage is weakest around ' || file_path || ', which raises change
risk for hotspot code.', '') AS summary, coalesce(file_path, '') AS focus_area FROM scans LEFT JOIN top
           USING (scan_id)""".replace("change\nrisk", "change risk"), ("scans", "findings"))
def test_gap_review(t):
    return reports.test_gap_reviews(t.scans, t.findings, ["scan_id"],
                                    fops.finding_order("seq")).drop("suggested_test_style")


test_gap_review.__test__ = False


@query("prj26_executive_summary", "PRJ26 STR18",
       f"""WITH {LEAD} SELECT scan_id, 'The repository carries about $' || format('{{:,}}',
           CAST(ROUND(total_cost_usd, 0) AS BIGINT)) || ' in estimated technical debt with a debt score of ' ||
           CAST(ROUND(debt_score, 1) AS DECIMAL(18,1)) || '/10 and roughly ' || CAST(ROUND(total_hours, 0) AS
           BIGINT) || ' remediation hours. The highest concentration of risk is in ' || coalesce(module,
           'the core module') || '. ' || coalesce({REVIEW}, '{C.SUMMARY_CLOSING}') AS executive_summary FROM
           scans LEFT JOIN lead USING (scan_id)""", ("scans", "findings"))
def executive_summary(t):
    lead = store.top_modules(st.modules(t), ["scan_id"], 1)
    return reports.executive_summaries(t.scans, lead, _reviews(t), ["scan_id"])


@query("win11_roi_projection", "WIN11 PRJ21",
       f"""SELECT scan_id, CAST(m AS INTEGER) AS month, {R('savings::DOUBLE / 12 * m', 0)} AS savings,
           {D('total_cost_usd')} AS fix_cost FROM (SELECT *, ROUND(CAST(total_cost_usd::DOUBLE * 0.4::DOUBLE AS
           DECIMAL(38,8)), 2) AS savings FROM scans), range(1, 13) r(m)""", ("scans",))
def roi_projection(t):
    return reports.roi_projection(t.scans)


def _scan_figures(t):
    return t.scans.selectExpr(
        "*", "CASE WHEN scan_id % 3 = 0 THEN NULL ELSE CAST(60 + scan_id % 90 AS DECIMAL(18,2)) END AS "
        "hourly_rate", "CASE WHEN scan_id % 3 <> 0 THEN 'medium' END AS rate_confidence",
        "CAST(scan_id % 900 AS DECIMAL(18,2)) AS cost_per_function",
        "CAST(scan_id % 300 - 150 AS DECIMAL(18,2)) / 2 AS variance_pct", "'fine' AS assessment",
        "CAST(1 + scan_id % 3 AS DECIMAL(18,2)) / 2 AS combined_multiplier",
        "CAST(scan_id % 9 AS INT) AS team_size", "CAST(scan_id % 4 AS INT) AS bus_factor",
        "CAST(scan_id % 4000 AS INT) AS repo_age_days",
        "'https://github.com/org/' || repo_id AS github_url",
        "'' || repeat('A long summary of the scan. ', CAST(scan_id % 14 AS INT)) AS executive_summary")


@query("prj32_metric_rows", "PRJ32 EXP1",
       """SELECT scan_id, p::INTEGER AS position, CASE p WHEN 0 THEN 'Hourly Rate Used' WHEN 1 THEN
          'Cost per Function' WHEN 2 THEN 'Variance vs Industry' WHEN 3 THEN 'Combined Multiplier' WHEN 4 THEN
          'Team Size' WHEN 5 THEN 'Bus Factor' ELSE 'Repo Age' END AS metric, CASE p WHEN 0 THEN CASE WHEN
          scan_id % 3 = 0 THEN '$84.55/hr' ELSE '$' || (60 + scan_id % 90) || '.00/hr' END WHEN 1 THEN '$' ||
          (scan_id % 900) WHEN 2 THEN CASE WHEN scan_id % 300 >= 150 THEN '+' ELSE '' END || CAST(CAST((scan_id
          % 300 - 150) / 2.0 AS DECIMAL(18,1)) AS VARCHAR) || '%' WHEN 3 THEN CAST(CAST((1 + scan_id % 3) / 2.0
          AS DECIMAL(18,2)) AS VARCHAR) || 'x' WHEN 4 THEN (scan_id % 9)::VARCHAR WHEN 5 THEN (scan_id %
          4)::VARCHAR ELSE (scan_id % 4000 // 365) || ' years' END AS value FROM scans, range(7) r(p)""",
       ("scans",))
def metric_rows(t):
    return reports.metric_rows(_scan_figures(t)).select("scan_id", "position", "metric", "value")


@query("exp1_profile_rows", "EXP1",
       """SELECT c_custkey AS repo_id, p::INTEGER AS position, CASE p WHEN 0 THEN 'py' WHEN 1 THEN CASE WHEN
          c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN
          'django, flask' ELSE 'N/A' END WHEN 3 THEN 'No' WHEN 4 THEN 'None' WHEN 5 THEN 'None' WHEN 6 THEN '~'
          || (c_custkey % 9) || ' engineers' WHEN 7 THEN '2' WHEN 8 THEN (c_custkey // 365) || ' years' ELSE
          '1.50x' END AS value FROM customer, range(10) r(p)""")
def profile_rows(t):
    empty = F.array().cast("array<string>")
    rows = t.read("customer").select(
        F.col("c_custkey").alias("repo_id"), F.lit("py").alias("primary_language"),
        (F.col("c_custkey") % 2 == 0).alias("has_tests"), F.lit(None).cast("boolean").alias("has_ci_cd"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("django"), F.lit("flask"))).otherwise(empty)
        .alias("frameworks"), empty.alias("databases"), empty.alias("ai_ml"),
        (F.col("c_custkey") % 9).alias("team_size"), F.lit(2).alias("bus_factor"),
        F.col("c_custkey").alias("repo_age_days"), F.lit(1.5).alias("combined_multiplier"))
    return reports.profile_rows(rows).select("repo_id", "position", "value")


def _report_items(t):
    return t.read("lineitem").selectExpr(
        "CASE WHEN l_suppkey % 3 = 0 THEN 'hub' ELSE 'r' || (l_suppkey % 12) END AS repo_id",
        "'/tmp/repos/job/src/mod_' || (l_partkey % 15) || '/some_longer_file_name_' || l_partkey || '.py:' "
        "|| l_linenumber AS file", f"{CATEGORY_OF_PART} AS category",
        "CASE WHEN l_quantity <= 15 THEN 'low' WHEN l_quantity <= 30 THEN 'Medium' WHEN l_quantity <= 42 "
        "THEN 'high' WHEN l_quantity <= 45 THEN 'strange' ELSE 'critical' END AS severity",
        "CASE WHEN l_partkey % 3 = 0 THEN repeat('fn_', CAST(l_quantity * 2 AS INT)) || l_suppkey END AS "
        "function", "CAST(l_extendedprice AS DECIMAL(18,2)) AS cost_usd",
        "CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity * 6 AS DECIMAL(18,2)) END AS adjusted_minutes",
        "CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS INT) END AS complexity", f"{SEQ} AS seq")


_FILE = "'src/mod_' || (l_partkey % 15) || '/some_longer_file_name_' || l_partkey || '.py'"
REPORT = f"""report AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'hub' ELSE 'r' || (l_suppkey % 12) END AS
repo_id, {_FILE} AS file, {CATEGORY_OF_PART} AS category, CASE WHEN l_quantity <= 15 THEN 'low' WHEN
l_quantity <= 30 THEN 'medium' WHEN l_quantity <= 42 THEN 'high' WHEN l_quantity <= 45 THEN 'strange' ELSE
'critical' END AS severity, CASE WHEN l_partkey % 3 = 0 THEN repeat('fn_', CAST(l_quantity * 2 AS INT)) ||
l_suppkey ELSE '' END AS fn, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost_usd, CASE WHEN l_partkey % 2 = 0
THEN l_quantity * 6 ELSE 0 END / 60 AS hours, {SEQ} AS seq FROM lineitem)"""


@query("exp1_top_items", "EXP1 SRT11 STR6",
       f"""WITH {REPORT} SELECT repo_id, position, CASE WHEN length(file) > 45 THEN file[1:45] || '...' ELSE file
           END AS file, {TITLE('category')} AS category, upper(severity[1:3]) AS severity, '$' ||
           format('{{:,}}', CAST(ROUND(cost_usd, 0) AS BIGINT)) AS cost,
           CAST(CAST(ROUND(CAST(hours AS DECIMAL(38,8)), 1) AS DECIMAL(18,1)) AS VARCHAR) || 'h' AS hours
           FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY cost_usd DESC, seq) AS position
           FROM report) WHERE position <= 20""")
def top_items(t):
    return reports.top_items(_report_items(t), ["repo_id"])


@query("exp3_tickets", "EXP3 FLT6 PRJ27 STR16 SRT11",
       f"""WITH {REPORT}, s AS (SELECT *, '[' || {TITLE('category')} || '] ' || file || CASE WHEN fn <> '' THEN
           ' — ' || fn ELSE '' END AS full_text FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY
           cost_usd DESC, seq) AS position FROM report WHERE {RANK('severity')} >= 2) WHERE position <= 10)
           SELECT repo_id, position, CASE WHEN length(full_text) > 255 THEN full_text[1:252] || '...' ELSE
           full_text END AS summary, CASE severity WHEN 'critical' THEN 'Highest' WHEN 'high' THEN 'High' WHEN
           'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS priority, CASE category WHEN
           'code_quality' THEN 'tech-debt-code' WHEN 'security' THEN 'tech-debt-security' WHEN 'documentation'
           THEN 'tech-debt-docs' WHEN 'dependency' THEN 'tech-debt-deps' WHEN 'test_debt' THEN 'tech-debt-tests'
           ELSE 'tech-debt' END || ',tech-debt,automated' AS labels FROM s""")
def tickets(t):
    return reports.tickets(_report_items(t), ["repo_id"]).drop("description")


@query("exp4_epics", "EXP4",
       """SELECT scan_id, '[Tech Debt] ' || repo_id || ' — $' || format('{:,}', CAST(ROUND(total_cost_usd, 0) AS
          BIGINT)) || ' total debt (score: ' || CAST(ROUND(debt_score, 1) AS DECIMAL(18,1)) || '/10)' AS summary
          FROM scans""", ("scans",))
def epics(t):
    return reports.epics(_scan_figures(t))


@query("exp2_messages", "EXP2 PRJ28 SRT11",
       f"""WITH {st.CATS}, top AS (SELECT scan_id, string_agg('  -  ' || {TITLE('category')} || ': *$' ||
           format('{{:,}}', CAST(ROUND(cost_usd, 0) AS BIGINT)) || '*', chr(10) ORDER BY p) AS categories FROM
           (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY cost_usd DESC, category) AS p FROM cats)
           WHERE p <= 3 GROUP BY scan_id), x AS (SELECT *, repeat('A long summary of the scan. ', CAST(scan_id %
           14 AS INT)) AS full_text, ROUND(CAST(total_cost_usd::DOUBLE * 0.4::DOUBLE AS DECIMAL(38,8)), 2) AS
           savings FROM scans)
           SELECT scan_id, CASE WHEN debt_score <= 3 THEN '🟢' WHEN debt_score <= 6 THEN '🟡' ELSE '🔴' END AS
           emoji, repo_id AS repo_name, coalesce(categories, '') AS categories, '*ROI:* Fix costs $' ||
           format('{{:,}}', CAST(ROUND(total_cost_usd, 0) AS BIGINT)) || ' → saves $' || format('{{:,}}',
           CAST(ROUND(savings, 0) AS BIGINT)) || '/yr -  Payback in 30 months' AS roi, CASE WHEN
           length(full_text) > 300 THEN full_text[1:297] || '...' ELSE full_text END AS summary FROM x LEFT JOIN
           top USING (scan_id)""", ("scans",))
def messages(t):
    actions = reports.priority_actions(t.findings, _triage(t), ["scan_id"], fops.finding_order("seq"))
    return reports.messages(_scan_figures(t), st.scan_categories(t), actions).drop(
        "actions", "fallback_text")


@query("snk2_lean_payload", "SNK2 QRY17",
       f"""SELECT scan_id, job_id, status, {D('debt_score')} AS debt_score, {D('total_cost_usd')} AS
           total_cost_usd, CASE WHEN scan_id % 2 = 0 THEN 'text ' || scan_id ELSE '' END AS executive_summary
           FROM scans""", ("scans",))
def lean_payload(t):
    from arrears.sources.scan_store import lean_payload as run

    payload = F.when(F.col("scan_id") % 2 == 0, F.to_json(F.struct(
        F.concat(F.lit("text "), "scan_id").alias("executive_summary")))).otherwise("{}")
    return run(t.scans.withColumn("payload", payload)).select(
        "scan_id", "job_id", "status", "debt_score", "total_cost_usd", "executive_summary")


