"""Change history: hotspots, ownership, team profile, risky files."""

from pyspark.sql import functions as F

from arrears.catalog.base import AS_OF, D, R, RANK, NAME, query
from arrears.catalog.scalars import IMPACT_SQL, PRICE_SQL
from arrears.operators import findings as findings_ops
from arrears.operators import history, risk, testgap
from arrears.operators.common import stage, top_per_group

SKIP = ("venv|node_modules|\\.git|__pycache__|dist|build|\\.next|__generated__|vendor|\\.tox|eggs|"
        "\\.eggs|\\.venv|env|\\.env")


def FIRST(n):
    return f"""SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY repo_id ORDER BY commit_seq)
    AS commit_rank FROM commit_files) WHERE commit_rank <= {n}"""


CHANGED = f"""SELECT *, regexp_replace(regexp_replace(raw, '/(?:\\.?/)+', '/', 'g'), '^[./]+', '') AS path
FROM (SELECT *, coalesce(nullif(new_path, ''), nullif(old_path, '')) AS raw FROM {{src}})
WHERE raw IS NOT NULL AND NOT regexp_matches(raw, '(?:^|/)(?:{SKIP})(?:/|$)')"""
SPOTS = """hotspots AS (SELECT repo_id, path, count(*) AS change_count,
  count(DISTINCT author_email) AS unique_authors, arg_max(author_date, commit_seq) AS last_changed
  FROM changed GROUP BY ALL)"""
HOTSPOTS = f"changed AS ({CHANGED.format(src='commit_files')}), {SPOTS}"
MODULE = ("CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '.' "
          "ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END")


def CONCENTRATION(counts, keys):
    """Plain definition: rank contributors, first rank whose running share reaches 0.8."""
    return f"""(SELECT {keys}, count(*) AS owner_count, CAST(sum(n) AS BIGINT) AS total_changes,
      min(CASE WHEN running * 5 >= total * 4 THEN pos END) AS bus_factor,
      {R('max(n)::DOUBLE / sum(n)::DOUBLE')} AS top_contributor_share
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, author) AS pos,
        sum(n) OVER (PARTITION BY {keys} ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS running,
        sum(n) OVER (PARTITION BY {keys}) AS total FROM {counts}) GROUP BY {keys})"""


RISK_SQL = """CASE WHEN total_changes <= 1 THEN 'low' WHEN owner_count <= 1 AND total_changes >= 3
THEN 'critical' WHEN top_contributor_share >= 0.85 THEN 'critical' WHEN owner_count <= 2 OR
top_contributor_share >= 0.7 THEN 'high' WHEN owner_count <= 3 OR top_contributor_share >= 0.55
THEN 'medium' ELSE 'low' END"""
OWNED = f"""named AS (SELECT *, lower(trim(author_email)) AS author FROM commit_files),
owned AS ({CHANGED.format(src="(SELECT * FROM named WHERE author <> '')")}),
file_counts AS (SELECT repo_id, path, author, count(*) AS n FROM owned GROUP BY ALL),
files AS (SELECT f.*, {RISK_SQL} AS ownership_risk, l.last_changed FROM
  {CONCENTRATION('file_counts', 'repo_id, path')} f JOIN (SELECT repo_id, path,
  arg_max(author_date, commit_seq) AS last_changed FROM owned GROUP BY ALL) l
  USING (repo_id, path)),
module_counts AS (SELECT repo_id, {MODULE} AS module, author, count(*) AS n FROM (SELECT DISTINCT
  repo_id, commit_seq, path, author FROM owned) GROUP BY ALL),
modules AS (SELECT *, {RISK_SQL} AS ownership_risk FROM
  {CONCENTRATION('module_counts', 'repo_id, module')})"""


def _date(column):
    return F.date_format(column, "yyyy-MM-dd")


@query("agg1_hotspots", "AGG1 STR1 FLT1b",
       f"""WITH {HOTSPOTS} SELECT repo_id, path, change_count, unique_authors,
           strftime(last_changed, '%Y-%m-%d') AS last_changed FROM hotspots""", ("commit_files",))
def hotspots(t):
    return history.hotspots(t.commit_files).withColumn("last_changed", _date("last_changed"))


@query("src3_first_commits", "SRC3",
       f"""WITH first50 AS ({FIRST(50)}), changed AS ({CHANGED.format(src='first50')}), {SPOTS} SELECT repo_id,
           path, change_count, unique_authors FROM hotspots""", ("commit_files",))
def hotspots_of_first_commits(t):
    """A stated number of commits, for repositories whose early history is the question."""
    return history.hotspots(t.commit_files, 50).drop("last_changed")


@query("srt4_top_hotspots", "SRT4",
       f"""WITH {HOTSPOTS} SELECT repo_id, path, change_count, row_number() OVER (PARTITION BY repo_id ORDER BY
           change_count DESC, path) AS position FROM hotspots""", ("commit_files",))
def top_hotspots(t):
    return top_per_group(history.hotspots(t.commit_files), ["repo_id"],
                         [F.col("change_count").desc(), F.col("path")], None).select(
        "repo_id", "path", "change_count", "position")


@query("agg3_complexity_hotspots", "AGG3",
       """SELECT repo_id, path, count(*) * 2 AS change_count, CAST(sum(complexity) AS BIGINT) AS
          complexity_score, max(complexity) AS max_complexity FROM functions GROUP BY ALL""",
       ("functions",))
def complexity_hotspots(t):
    return history.complexity_hotspots(t.functions).select(
        "repo_id", "path", "change_count", "complexity_score", "max_complexity")


@query("agg2_complexity_summary", "AGG2",
       f"""SELECT repo_id, count(*) AS total_functions, {R('sum(complexity)::DOUBLE / count(*)')} AS
           avg_complexity, count(*) FILTER (severity = 'low') AS low_functions,
           count(*) FILTER (severity = 'medium') AS medium_functions,
           count(*) FILTER (severity = 'high') AS high_functions,
           count(*) FILTER (severity = 'critical') AS critical_functions FROM functions GROUP BY ALL""",
       ("functions",))
def complexity_summary(t):
    from arrears.operators.smells import complexity_summary as run

    return run(t.functions)


@query("srt3_worst_files", "SRT3 AGG2",
       """SELECT repo_id, path, max_complexity, position FROM (SELECT *, row_number() OVER (PARTITION
          BY repo_id ORDER BY max_complexity DESC, path) AS position FROM (SELECT repo_id, path,
          max(complexity) AS max_complexity FROM functions GROUP BY ALL)) WHERE position <= 5""",
       ("functions",))
def worst_files(t):
    from arrears.operators.smells import file_complexity

    return top_per_group(file_complexity(t.functions), ["repo_id"],
                         [F.col("max_complexity").desc(), F.col("path")], 5)


@query("agg4_max_severity", "AGG4",
       f"""SELECT repo_id, path, {NAME(f'max({RANK("severity")})')} AS severity, max(complexity) AS
           max_complexity, count(*) AS function_count FROM functions GROUP BY repo_id, path""",
       ("functions",))
def max_severity(t):
    return risk.functions_per_file(t.functions)


@query("agg5_file_ownership", "AGG5 AGG6 WIN1 PRJ13",
       f"""WITH {OWNED} SELECT repo_id, path, owner_count, total_changes, bus_factor,
           top_contributor_share, ownership_risk, strftime(last_changed, '%Y-%m-%d') AS last_changed
           FROM files""", ("commit_files",))
def file_ownership(t):
    return history.file_ownership(t.commit_files).withColumn("last_changed", _date("last_changed"))


@query("agg5_module_ownership", "AGG5 AGG6 WIN1 PRJ10",
       f"""WITH {OWNED} SELECT repo_id, module, owner_count, total_changes, bus_factor,
           top_contributor_share, ownership_risk FROM modules""", ("commit_files",))
def module_ownership(t):
    return history.module_ownership(t.commit_files)


@query("win1_bus_factor", "WIN1 AGG6",
       f"""SELECT * FROM {CONCENTRATION('''(SELECT l_partkey AS repo_id, l_suppkey AS author,
           CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL)''', 'repo_id')}""")
def bus_factor(t):
    counts = t.read("lineitem").groupBy(
        F.col("l_partkey").alias("repo_id"), F.col("l_suppkey").alias("author")).agg(
        F.sum("l_quantity").cast("long").alias("changes"))
    return history.concentration(counts, ["repo_id"])


@query("srt7_ownership_hotspots", "SRT7 JON17 SRT11",
       f"""WITH {HOTSPOTS}, {OWNED} SELECT repo_id, path, ownership_risk, position FROM (SELECT *,
           row_number() OVER (PARTITION BY repo_id ORDER BY ownership_risk = 'critical' DESC,
           ownership_risk = 'high' DESC, top_contributor_share DESC, total_changes DESC, path)
           AS position FROM files SEMI JOIN hotspots USING (repo_id, path)) WHERE position <= 20""",
       ("commit_files",))
def ownership_hotspots(t):
    changes = stage(history.author_changes(t.commit_files))
    files = history.ownership_hotspots(history.file_ownership(None, by_author=changes), history.hotspots(None, by_author=changes))
    return top_per_group(files, ["repo_id"], history.hotspot_order(), 20).select("repo_id", "path", "ownership_risk", "position")


@query("agg7_ownership_summary", "AGG7 CMP12 DTE1",
       f"""WITH {HOTSPOTS}, {OWNED},
        commits AS (SELECT repo_id, commit_seq, max(author) AS author, max(author_date) AS author_date
          FROM named GROUP BY ALL),
        counts AS (SELECT repo_id, author, count(*) AS n FROM commits WHERE author <> '' GROUP BY ALL),
        spots AS (SELECT repo_id, count(*) FILTER (owner_count <= 1 OR top_contributor_share >= 0.8)
          AS siloed, count(*) FILTER (owner_count >= 4) AS handoff FROM files SEMI JOIN hotspots
          USING (repo_id, path) GROUP BY ALL)
        SELECT s.repo_id, commit_sample_size, unique_contributors, active_contributors_90d,
          coalesce(bus_factor, 0) AS bus_factor,
          coalesce(top_contributor_share, 0) AS top_contributor_share,
          coalesce(siloed, 0) AS siloed_hotspots, coalesce(handoff, 0) AS handoff_hotspots
        FROM (SELECT repo_id, count(*) AS commit_sample_size, count(DISTINCT nullif(author, ''))
          AS unique_contributors, count(DISTINCT CASE WHEN author_date > TIMESTAMP '{AS_OF}' -
          INTERVAL 90 DAYS THEN nullif(author, '') END) AS active_contributors_90d FROM commits
          GROUP BY ALL) s LEFT JOIN {CONCENTRATION('counts', 'repo_id')} c USING (repo_id)
          LEFT JOIN spots USING (repo_id)""", ("commit_files",))
def ownership_summary(t):
    changes = stage(history.author_changes(t.commit_files))
    files = history.file_ownership(None, by_author=changes)
    return history.ownership_summary(t.commit_files, files, changes, AS_OF)


@query("agg12_team_profile", "AGG12 WIN13 PRJ16 DTE4",
       f"""WITH commits AS (SELECT repo_id, commit_seq, max(author_email) AS author, max(author_date)
          AS d FROM commit_files GROUP BY ALL),
        counts AS (SELECT repo_id, author, count(*) AS n FROM commits GROUP BY ALL),
        base AS (SELECT repo_id, count(DISTINCT nullif(author, '')) AS team_size,
          count(DISTINCT CASE WHEN d > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS THEN nullif(author, '')
          END) AS active_contributors, count(*) AS total_commits, CAST(floor((epoch(arg_max(d,
          commit_seq)) - epoch(arg_min(d, commit_seq))) / 86400) AS BIGINT) AS repo_age_days
          FROM commits GROUP BY ALL)
        SELECT repo_id, team_size, active_contributors, total_commits, repo_age_days, bus_factor,
          bus_factor = 1 AS is_solo,
          {R("total_commits / greatest(repo_age_days / 7.0::DOUBLE, 1::DOUBLE)", 1)}
          AS commit_frequency, {R('''CAST(CASE WHEN repo_age_days > 3650 THEN 1.4 WHEN repo_age_days
          > 2000 THEN 1.3 WHEN repo_age_days > 1000 THEN 1.1 WHEN repo_age_days < 180 THEN 0.8 ELSE
          1.0 END AS DOUBLE) * CAST(CASE WHEN bus_factor = 1 THEN 2.0 WHEN bus_factor = 2 THEN 1.5
          WHEN bus_factor <= 4 THEN 1.2 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN team_size = 1 THEN
          1.5 WHEN team_size <= 3 THEN 1.2 WHEN team_size <= 10 THEN 1.0 ELSE 0.9 END AS DOUBLE)''')}
          AS combined_multiplier
        FROM base JOIN {CONCENTRATION('counts', 'repo_id')} c USING (repo_id)""", ("commit_files",))
def team_profile(t):
    team = history.with_multipliers(history.team_profile(t.commit_files, AS_OF))
    return team.drop("repo_age_multiplier", "bus_factor_multiplier", "team_size_multiplier")


@query("jon1_functions_with_hotspots", "JON1",
       f"""WITH {HOTSPOTS} SELECT repo_id, path, "function", complexity, change_count
           FROM functions JOIN hotspots USING (repo_id, path)""", ("commit_files", "functions"))
def functions_with_hotspots(t):
    spots = history.hotspots(t.commit_files)
    return t.functions.join(spots, ["repo_id", "path"]).select(
        "repo_id", "path", "function", "complexity", "change_count")


RULES = """SELECT 'rule:' || p_partkey AS rule_key, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size
WHEN 1 THEN p_size * 60 WHEN 2 THEN 720 ELSE 30 END AS INTEGER) AS minutes,
CASE p_partkey % 4 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' WHEN 2 THEN 'CRITICAL' ELSE 'INFO' END
AS severity, CASE WHEN p_partkey % 3 = 0 THEN 'BUG' ELSE 'CODE_SMELL' END AS type FROM part"""
MINUTES = f"""rules AS ({RULES}), minutes AS (SELECT s AS severity, coalesce(m, d::DOUBLE) AS minutes
FROM (VALUES ('low', 'MINOR', 10), ('medium', 'MAJOR', 30), ('high', 'CRITICAL', 60),
('critical', 'BLOCKER', 120)) g(s, r, d) LEFT JOIN (SELECT severity, sum(minutes)::DOUBLE / count(*)
AS m FROM rules WHERE type = 'CODE_SMELL' GROUP BY ALL) ON severity = r)"""


def landed_rules(t):
    return t.read("part").selectExpr(
        "'rule:' || p_partkey AS rule_key",
        "CASE p_partkey % 5 WHEN 0 THEN p_size || 'min' WHEN 1 THEN p_size || 'h' END AS base_effort",
        "CASE p_partkey % 5 WHEN 2 THEN '1.5d' END AS fixed_effort",
        "CASE p_partkey % 4 WHEN 0 THEN 'MINOR' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'INFO' END "
        "AS severity", "CASE WHEN p_partkey % 3 = 0 THEN 'BUG' END AS type")


@query("agg22_rule_minutes", "AGG22 PRJ18 SRC8",
       f"WITH {MINUTES} SELECT severity AS complexity_severity, minutes FROM minutes")
def rule_minutes(t):
    return risk.minutes_by_complexity(risk.parsed_rules(landed_rules(t)))


@query("rat7_minutes_by_rule", "RAT7",
       f"""WITH rules AS ({RULES}) SELECT o_orderkey, coalesce(minutes, 30)::DOUBLE AS minutes
           FROM orders LEFT JOIN rules ON rule_key = 'rule:' || o_custkey""")
def minutes_by_rule(t):
    keys = t.read("orders").selectExpr("o_orderkey", "'rule:' || o_custkey AS rule_key")
    return risk.minutes_for_keys(keys, risk.parsed_rules(landed_rules(t))).select(
        "o_orderkey", "minutes")


RISKY = f"""{HOTSPOTS}, {MINUTES},
per_file AS (SELECT repo_id, path, {NAME(f'max({RANK("severity")})')} AS severity,
  max(complexity) AS max_complexity FROM functions GROUP BY repo_id, path),
risky AS (SELECT *, {IMPACT_SQL('severity', 'churn', 'change_count')} AS business_impact,
  minutes * churn / 60 AS raw_hours FROM (SELECT *, CAST(CASE WHEN change_count >= 20 THEN 3.0
  WHEN change_count >= 11 THEN 2.2 WHEN change_count >= 6 THEN 1.7 WHEN change_count >= 3 THEN 1.3
  ELSE 1.0 END AS DOUBLE) AS churn FROM per_file JOIN hotspots USING (repo_id, path)
  JOIN minutes USING (severity)))"""


@query("cmp1_risky_files", "CMP1 JON1 AGG4 PRJ3 PRJ4 PRJ5 PRJ6 PRJ7",
       f"""WITH {RISKY} SELECT repo_id, path AS file, severity, max_complexity AS complexity,
           change_count, churn AS churn_multiplier, {R('minutes * churn')} AS adjusted_minutes,
           {R('raw_hours', 6)} AS remediation_hours, business_impact,
           {PRICE_SQL('raw_hours', '84.55', 'business_impact', '0.8')} AS cost_usd FROM risky""",
       ("commit_files", "functions"))
def risky_files(t):
    from arrears.operators.items import price_items

    minutes = risk.minutes_by_complexity(risk.parsed_rules(landed_rules(t)))
    items = risk.risky_files(t.functions, history.hotspots(t.commit_files), minutes)
    return price_items(items).select(
        "repo_id", "file", "severity", "complexity", "change_count", "churn_multiplier",
        "adjusted_minutes", "remediation_hours", "business_impact", "cost_usd")


@query("agg11_risk_by_owner_and_module", "AGG11 JON2 JON3 SRT2",
       f"""WITH {RISKY}, {OWNED},
        priced AS (SELECT r.repo_id, r.path, {MODULE.replace('path', 'r.path')} AS module, r.severity,
          {PRICE_SQL('raw_hours', '84.55', 'business_impact', '0.8')}::DECIMAL(18,2) AS cost
          FROM risky r)
        SELECT p.repo_id, p.module, finding_count, total_cost_usd, max_severity,
          coalesce(m.owner_count, 0) AS owner_count, coalesce(m.ownership_risk, 'none')
          AS ownership_risk FROM (SELECT repo_id, module, count(*) AS finding_count,
          {D('sum(cost)')} AS total_cost_usd, {NAME(f'max({RANK("severity")})')} AS max_severity
          FROM priced GROUP BY repo_id, module) p LEFT JOIN modules m USING (repo_id, module)""",
       ("commit_files", "functions"))
def flagship(t):
    """Which folders are risky, what do they cost, and who owns them."""
    from arrears.operators.items import price_items

    minutes = risk.minutes_by_complexity(risk.parsed_rules(landed_rules(t)))
    changes = stage(history.author_changes(t.commit_files))
    items = price_items(risk.risky_files(t.functions, history.hotspots(None, by_author=changes), minutes))
    owned = findings_ops.with_file_owners(items, history.file_ownership(None, by_author=changes))
    found = findings_ops.normalize_findings(owned)
    modules = findings_ops.with_module_owners(
        findings_ops.summarize_modules(found), history.module_ownership(t.commit_files))
    return modules.select(
        "repo_id", "module", "finding_count", "total_cost_usd", "max_severity",
        F.coalesce("owner_count", F.lit(0)).alias("owner_count"),
        F.coalesce("ownership_risk", F.lit("none")).alias("ownership_risk"))


# --- test gaps ------------------------------------------------------------------------------------

FILES = """SELECT CASE WHEN i % 3 = 0 THEN 'hub' ELSE 'repo_' || (i % 10) END AS repo_id,
CASE k
 WHEN 0 THEN 'src/mod_' || i || '.py' WHEN 1 THEN 'tests/test_mod_' || i || '.py'
 WHEN 2 THEN 'web/View' || i || '.tsx' WHEN 3 THEN 'web/view' || i || '.test.tsx'
 WHEN 4 THEN 'lib/part_' || i || '/core.js' WHEN 5 THEN 'spec/core/check_' || i || '.js'
 WHEN 6 THEN 'lib/job_' || i || '.ts' ELSE 'lib/my_job_' || i || '_test.py' END AS path
FROM (SELECT p_partkey % 8 AS k, CASE WHEN p_partkey % 2 = 1 THEN p_partkey {div} 8 * 3 {div} 2
ELSE p_partkey {div} 8 END AS i FROM part)"""


def tree_files(t):
    t.read("part").createOrReplaceTempView("arrears_part")
    sql = FILES.format(div="div").replace("FROM part", "FROM arrears_part")
    return t.spark.sql(sql).distinct()


TEST_FILES = f"""files AS (SELECT DISTINCT * FROM ({FILES.format(div='//')})),
flags AS (SELECT *, regexp_matches(lower(path), '(?:^|/)(?:tests|test|__tests__|spec)(?:/|$)') OR
  regexp_matches(regexp_extract(lower(path), '([^/]*)$', 1), 'test_|_test\\.|\\.test\\.|\\.spec\\.')
  AS is_test, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem
  FROM files),
gaps AS (SELECT s.repo_id, s.path FROM flags s WHERE NOT s.is_test AND NOT EXISTS (SELECT 1 FROM flags x
  WHERE x.is_test AND x.repo_id = s.repo_id AND (
  suffix(lower(x.path), 'test_' || s.stem || '.py') OR suffix(lower(x.path), s.stem || '_test.py') OR
  suffix(lower(x.path), s.stem || '.test.ts') OR suffix(lower(x.path), s.stem || '.test.tsx') OR
  suffix(lower(x.path), s.stem || '.test.js') OR suffix(lower(x.path), s.stem || '.spec.ts') OR
  suffix(lower(x.path), s.stem || '.spec.tsx') OR suffix(lower(x.path), s.stem || '.spec.js') OR
  contains(lower(x.path), '/' || s.stem || '/'))))"""


@query("jon5_test_gaps", "JON5 STR15", f"WITH {TEST_FILES} SELECT repo_id, path FROM gaps")
def untested(t):
    return testgap.untested_sources(tree_files(t))


@query("cmp2_test_debt", "CMP2 JON17 SRT6",
       f"""WITH {TEST_FILES} SELECT repo_id, path AS file, CASE WHEN hot THEN 'high' ELSE 'medium' END
           AS severity, CASE WHEN hot THEN 4.0 ELSE 2.0 END::DOUBLE AS remediation_hours,
           CASE WHEN hot THEN {R('4 * 84.55::DOUBLE * 1.2::DOUBLE * 0.7::DOUBLE')} ELSE
           {R('2 * 84.55::DOUBLE * 0.7::DOUBLE')} END AS cost_usd, CASE WHEN hot THEN
           'hotspot_without_tests' ELSE 'source_without_tests' END AS test_gap_type
           FROM (SELECT *, regexp_matches(path, '[02468]\\.[a-z]+$') AS hot FROM gaps)""")
def test_debt(t):
    from arrears.operators.items import price_items

    files = tree_files(t)
    spots = files.filter(F.col("path").rlike(r"[02468]\.[a-z]+$"))
    return price_items(testgap.test_gaps(files, spots)).select(
        "repo_id", "file", "severity", "remediation_hours", "cost_usd",
        F.col("detail").alias("test_gap_type"))
