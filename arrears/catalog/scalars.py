"""Row-local rules: severity, confidence, price, bands, paths, addresses, version specs."""

from pyspark.sql import functions as F

from arrears import constants as C
from arrears.catalog.base import CATEGORY_OF_PART, R, RANK, SEQ, TITLE, query
from arrears.functions import numeric, paths, scoring, text

# A severity text per order, with mixed case, an unknown word and nulls.
SEVERITY = ("CASE o_orderkey % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' "
            "WHEN 3 THEN 'critical' WHEN 4 THEN 'unknown' WHEN 5 THEN 'medium' END")
CHANGES = "CAST(o_custkey % 25 AS INT)"
CHURN_SQL = ("(CASE WHEN changes >= 20 THEN 3.0 WHEN changes >= 11 THEN 2.2 WHEN changes >= 6 "
             "THEN 1.7 WHEN changes >= 3 THEN 1.3 ELSE 1.0 END)")
CONFIDENCE_SQL = ("(CASE {c} WHEN 'static_analysis' THEN 0.7 WHEN 'git_history' THEN 0.8 "
                  "WHEN 'fallback' THEN 0.45 WHEN 'security_scan' THEN 0.8 WHEN 'documentation' "
                  "THEN 0.65 WHEN 'dependency' THEN 0.85 WHEN 'test_debt' THEN 0.7 ELSE 0.7 END)")
WEIGHT_SQL = ("(CASE lower({i}) WHEN 'low' THEN 0.9::DOUBLE WHEN 'medium' THEN 1.0::DOUBLE "
              "WHEN 'high' THEN 1.2::DOUBLE WHEN 'critical' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)")


def IMPACT_SQL(severity, churn="1.0", changes="0"):
    rank = RANK(severity)
    return (f"(CASE WHEN {rank} >= 4 OR {churn} >= 2.2 THEN 'critical' "
            f"WHEN {rank} >= 3 OR {changes} >= 6 THEN 'high' "
            f"WHEN {rank} >= 2 OR {changes} >= 3 THEN 'medium' ELSE 'low' END)")


def PRICE_SQL(hours, rate, impact, conf):
    return R(f"CAST({hours} AS DOUBLE) * CAST({rate} AS DOUBLE) * {WEIGHT_SQL.format(i=impact)} "
             f"* greatest(CAST(0.25 AS DOUBLE), least(CAST({conf} AS DOUBLE), CAST(1 AS DOUBLE)))")


@query("prj1_complexity_severity", "PRJ1",
       """SELECT p_partkey, CAST(p_size * 3 - 6 AS INTEGER) AS complexity,
          CASE WHEN p_size * 3 - 6 BETWEEN 1 AND 5 THEN 'low' WHEN p_size * 3 - 6 BETWEEN 6 AND 10
          THEN 'medium' WHEN p_size * 3 - 6 BETWEEN 11 AND 15 THEN 'high' ELSE 'critical' END
          AS severity FROM part""")
def complexity_severity(t):
    complexity = F.col("p_size") * 3 - 6
    return t.read("part").select("p_partkey", complexity.alias("complexity"),
                                 scoring.complexity_severity(complexity).alias("severity"))


@query("prj2_severity_rank", "PRJ2",
       f"SELECT o_orderkey, coalesce({RANK('(' + SEVERITY + ')')}, 0) AS severity_rank FROM orders")
def severity_rank(t):
    return t.read("orders").select(
        "o_orderkey", scoring.severity_rank(F.expr(SEVERITY)).alias("severity_rank"))


@query("prj3_confidence", "PRJ3 MTH1",
       "SELECT l_orderkey, seq, CAST(CASE WHEN used_fallback OR seq % 10 = 0 THEN 0.45 ELSE "
       + CONFIDENCE_SQL.format(c="category") + " END AS DOUBLE) AS confidence FROM (SELECT "
       "l_orderkey, (CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 10000000 + l_suppkey "
       "AS seq, l_partkey % 16 = 0 AS used_fallback, CASE l_partkey % 8 WHEN 0 THEN 'code_quality' "
       "WHEN 1 THEN 'architecture' WHEN 2 THEN 'security' WHEN 3 THEN 'documentation' WHEN 4 THEN "
       "'dependency' WHEN 5 THEN 'test_debt' WHEN 6 THEN 'reliability' ELSE 'performance' END AS "
       "category FROM lineitem)")
def confidence(t):
    rows = t.read("lineitem").selectExpr("l_orderkey", f"{SEQ} AS seq",
                                         "l_partkey % 16 = 0 AS used_fallback",
                                         f"{CATEGORY_OF_PART} AS category")
    return rows.select("l_orderkey", "seq", scoring.confidence(
        F.col("category"), F.col("used_fallback"), F.col("seq") % 10 != 0).alias("confidence"))


@query("prj4_business_impact", "PRJ4 PRJ7",
       f"""SELECT o_orderkey, CAST({CHURN_SQL} AS DOUBLE) AS churn_multiplier,
           {IMPACT_SQL('severity', CHURN_SQL, 'changes')} AS business_impact
           FROM (SELECT o_orderkey, {SEVERITY} AS severity, {CHANGES} AS changes FROM orders)""")
def business_impact(t):
    rows = t.read("orders").selectExpr("o_orderkey", f"{SEVERITY} AS severity",
                                       f"{CHANGES} AS changes")
    churn = scoring.churn_multiplier(F.col("changes"))
    return rows.select("o_orderkey", churn.alias("churn_multiplier"), scoring.business_impact(
        F.col("severity"), churn, F.col("changes")).alias("business_impact"))


@query("prj5_calculate_cost", "PRJ5 MTH2",
       "SELECT scan_id, seq, " + PRICE_SQL("effort_hours", "84.55", "business_impact",
                                           "confidence - 0.2") + " AS cost_usd FROM findings",
       ("findings",))
def calculate_cost(t):
    return t.findings.select("scan_id", "seq", scoring.price(
        F.col("effort_hours"), F.lit(84.55), F.col("business_impact"),
        F.col("confidence") - F.lit(0.2).cast("decimal(2,1)")).alias("cost_usd"))


@query("prj13_ownership_risk", "PRJ13",
       """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE WHEN changes <= 1 THEN 'low' WHEN owners <= 1 AND changes >= 3 THEN 'critical'
          WHEN share >= 0.85 THEN 'critical' WHEN owners <= 2 OR share >= 0.7 THEN 'high'
          WHEN owners <= 3 OR share >= 0.55 THEN 'medium' ELSE 'low' END AS ownership_risk
          FROM (SELECT *, l_suppkey % 6 AS owners, l_linenumber AS changes,
          CAST(l_quantity / 50 AS DECIMAL(18,2)) AS share FROM lineitem)""")
def ownership_risk(t):
    share = (F.col("l_quantity") / 50).cast("decimal(18,2)")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        scoring.ownership_risk(F.col("l_suppkey") % 6, share, F.col("l_linenumber"))
        .alias("ownership_risk"))


@query("prj14_risk_and_score_bands", "PRJ14 PRJ15",
       """SELECT scan_id, CASE WHEN debt_score >= 7 THEN 'critical' WHEN debt_score >= 5 THEN 'high'
          WHEN debt_score >= 3 THEN 'medium' ELSE 'low' END AS risk_level,
          CASE WHEN debt_score <= 3 THEN 'low' WHEN debt_score <= 6 THEN 'moderate' ELSE 'high' END
          AS score_band FROM scans""", ("scans",))
def score_bands(t):
    score = F.col("debt_score")
    return t.scans.select("scan_id", scoring.risk_level(score).alias("risk_level"),
                          scoring.score_band(score).alias("score_band"))


MULT = "SELECT c_custkey, c_custkey % 5000 AS age, c_custkey % 7 + 1 AS bus, c_custkey % 13 + 1 AS team FROM customer"


@query("prj16_multipliers", "PRJ16",
       f"""SELECT c_custkey, age_mult, bus_mult, team_mult,
           {R('age_mult * bus_mult * team_mult')} AS combined FROM (SELECT c_custkey,
           CAST(CASE WHEN age > 3650 THEN 1.4 WHEN age > 2000 THEN 1.3 WHEN age > 1000 THEN 1.1
           WHEN age < 180 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS age_mult,
           CAST(CASE WHEN bus = 1 THEN 2.0 WHEN bus = 2 THEN 1.5 WHEN bus <= 4 THEN 1.2 ELSE 1.0 END
           AS DOUBLE) AS bus_mult,
           CAST(CASE WHEN team = 1 THEN 1.5 WHEN team <= 3 THEN 1.2 WHEN team <= 10 THEN 1.0
           ELSE 0.9 END AS DOUBLE) AS team_mult FROM ({MULT}))""")
def multipliers(t):
    key = F.col("c_custkey")
    cols = scoring.repo_multipliers(key % 5000, key % 7 + 1, key % 13 + 1)
    names = ("age_mult", "bus_mult", "team_mult", "combined")
    return t.read("customer").select(
        "c_custkey", *[c.alias(n) for c, n in zip(cols.values(), names)])


@query("prj17_cvss_severity", "PRJ17",
       """SELECT p_partkey, severity, CAST(CASE severity WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 6
          WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 2 END AS DOUBLE) AS hours FROM (
          SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'UNKNOWN' WHEN p_size / 5.0 >= 9 THEN
          'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM'
          ELSE 'LOW' END AS severity FROM part)""")
def cvss(t):
    score = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 5)
    severity = scoring.cvss_severity(score)
    return t.read("part").select("p_partkey", severity.alias("severity"),
                                 scoring.vulnerability_hours(severity).alias("hours"))


EFFORT = ("CASE p_partkey % 6 WHEN 0 THEN p_size || 'min' WHEN 1 THEN ' ' || p_size || ' H' "
          "WHEN 2 THEN '1.5d' WHEN 3 THEN '0.25h' WHEN 4 THEN 'soon' END")


@query("prj18_parse_effort", "PRJ18",
       """SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60
          WHEN 2 THEN 720 WHEN 3 THEN 15 ELSE 30 END AS INTEGER) AS minutes FROM part""")
def parse_effort(t):
    return t.read("part").select("p_partkey",
                                 scoring.effort_minutes(F.expr(EFFORT)).alias("minutes"))


@query("prj19_sanity_check", "PRJ19 PRJ20",
       f"""SELECT scan_id, {R('per_fn')} AS cost_per_function,
           {R('(per_fn - 433.0::DOUBLE) / 433.0::DOUBLE * 100::DOUBLE')} AS variance_pct,
           per_fn <= 433 OR (per_fn - 433.0::DOUBLE) / 433.0::DOUBLE * 100 < 150 AS is_reasonable,
           CASE WHEN per_fn < 433 * 0.5 THEN
             'Lower than industry average - code may be well-maintained'
           WHEN per_fn < 433 THEN 'Slightly below industry average - reasonable condition'
           WHEN per_fn < 433 * 1.5 THEN
             'Slightly above industry average - some technical debt present'
           WHEN per_fn < 433 * 2 THEN 'Above industry average - significant technical debt'
           ELSE 'Significantly above industry average - high technical debt' END AS assessment,
           CASE WHEN fns = 0 THEN CAST(0 AS DOUBLE) ELSE
             {R('least(10::DOUBLE, per_fn / 433.0::DOUBLE * 10::DOUBLE)')} END AS debt_score
           FROM (SELECT scan_id, scan_id % 700 AS fns, CAST(total_cost_usd AS DOUBLE)
           / CAST(greatest(scan_id % 700, 1) AS DOUBLE) AS per_fn FROM scans)""", ("scans",))
def sanity_check(t):
    fns, bench = F.col("scan_id") % 700, F.lit(433.0)
    cols = scoring.sanity_columns(F.col("total_cost_usd"), fns, bench)
    return t.scans.select(
        "scan_id", *[cols[n].alias(n) for n in
                     ("cost_per_function", "variance_pct", "is_reasonable", "assessment")],
        scoring.debt_score(F.col("total_cost_usd"), fns,
                           bench).alias("debt_score"))


@query("prj21_roi", "PRJ21",
       f"""SELECT scan_id, {R('cost')} AS total_fix_cost, CAST(savings AS DOUBLE) AS savings,
           CAST(ROUND(CAST(cost / CAST(savings AS DOUBLE) * 12 AS DECIMAL(28,8)), 0) AS INTEGER)
           AS payback_months,
           CAST(ROUND(CAST((CAST(savings AS DOUBLE) * 3 - cost) / cost * 100 AS DECIMAL(28,8)), 0)
           AS INTEGER) AS roi_pct, {R('cost / 4')} AS budget,
           CASE WHEN ROUND(CAST((CAST(savings AS DOUBLE) * 3 - cost) / cost * 100
           AS DECIMAL(28,8)), 0) > 0 THEN '{C.ROI_POSITIVE}' ELSE '{C.ROI_OTHER}' END AS advice
           FROM (SELECT scan_id, CAST(total_cost_usd AS DOUBLE) AS cost,
           ROUND(CAST(CAST(total_cost_usd AS DOUBLE) * 0.4::DOUBLE AS DECIMAL(38,8)), 2) AS savings
           FROM scans)""", ("scans",))
def roi(t):
    cols = scoring.roi_columns(F.col("total_cost_usd"))
    names = ("total_fix_cost", "savings", "payback_months", "roi_pct", "budget", "advice")
    return t.scans.select("scan_id", *[c.alias(n) for c, n in zip(cols.values(), names)])


CWE = ("CASE p_partkey % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 2 THEN 'CWE-502' "
       "WHEN 3 THEN 'CWE-287' ELSE 'CWE-UNKNOWN' END")


@query("prj23_security_cost", "PRJ23 PRJ23b",
       f"""SELECT p_partkey, {R('fix')} AS fix_cost, {R('expected')} AS expected_breach_value,
           {R('fix + expected')} AS total_security_cost FROM (SELECT p_partkey,
           CAST(p_size AS DOUBLE) * 84.55::DOUBLE AS fix,
           CASE WHEN p_size / 5.0 >= 9 THEN 0.046::DOUBLE * 0.5::DOUBLE * (4880000.0::DOUBLE *
           CAST(CASE p_partkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 WHEN 2 THEN 0.9 WHEN 3 THEN 1.4
           ELSE 1.0 END AS DOUBLE)) * 0.01::DOUBLE ELSE 0::DOUBLE END AS expected FROM part)""")
def security_cost(t):
    cols = scoring.security_cost_columns(
        F.expr(CWE), F.col("p_size") / 5, F.col("p_size"), F.lit(84.55), F.lit(C.BREACH_COST),
        F.lit(C.BREACH_PROBABILITY))
    return t.read("part").select("p_partkey", *[cols[n].alias(n) for n in (
        "fix_cost", "expected_breach_value", "total_security_cost")])


@query("prj31_payback_months", "PRJ31",
       """SELECT p_partkey, coalesce(CAST(CASE WHEN p_size % 5 > 0 THEN
          ceil(p_retailprice / CAST(p_size % 5 AS DOUBLE)) END AS BIGINT), -1) AS months FROM part""")
def payback(t):
    from arrears.operators.reports import payback_months

    return t.read("part").select("p_partkey", F.coalesce(
        payback_months(F.col("p_retailprice"), F.col("p_size") % 5), F.lit(-1)).alias("months"))


@query("mth4_role_factors", "MTH4 MTH3",
       f"""SELECT p_partkey, {R('p_retailprice * 0.7::DOUBLE')} AS junior, {R('p_retailprice')}
           AS mid, {R('p_retailprice * 1.5::DOUBLE')} AS senior,
           least(8::DOUBLE, 1.5::DOUBLE + (p_size - 2) * 1.25::DOUBLE) AS copy_hours FROM part""")
def role_factors(t):
    from arrears.operators.smells import duplication_effort

    return t.read("part").select(
        "p_partkey", *[numeric.cents(F.col("p_retailprice") * factor).alias(role)
                       for role, factor in C.WAGE_ROLE_FACTORS.items()],
        duplication_effort(F.col("p_size")).alias("copy_hours"))


# --- paths ----------------------------------------------------------------------------------------

ODD_PATH = ("CASE p_partkey % 9 WHEN 0 THEN './src/app_' || p_size || '.py' "
            "WHEN 1 THEN '.github/workflows/ci_' || p_size || '.yml' "
            "WHEN 2 THEN 'pkg/__init__.py' WHEN 3 THEN 'a//b/./c_' || p_size || '.min.js' "
            "WHEN 4 THEN 'node_modules/x_' || p_size || '/index.ts' WHEN 5 THEN 'README' "
            "WHEN 6 THEN 'lib/environment/conf_' || p_size || '.tar.GZ' "
            "WHEN 7 THEN 'web/tests/test_view_' || p_size || '.py' "
            "ELSE 'core/build/package-lock.json' END")
_DIRS = ("venv|node_modules|\\.git|__pycache__|dist|build|\\.next|__generated__|vendor|\\.tox|eggs|"
         "\\.eggs|\\.venv|env|\\.env")


@query("str1_paths", "STR1 STR2 STR8 PRJ10",
       f"""SELECT p_partkey, norm, CASE WHEN regexp_extract(norm, '^(.*)/[^/]*$', 1) = '' THEN '.'
           ELSE regexp_extract(norm, '^(.*)/[^/]*$', 1) END AS module,
           regexp_replace(replace(regexp_replace(norm, '([^/])\\.[^./]*$', '\\1'), '/', '.'),
             '\\.__init__$', '') AS python_module,
           CASE WHEN contains(regexp_extract(norm, '([^/]*)$', 1), '.') THEN
             lower(regexp_extract(norm, '([^.]*)$', 1)) ELSE '' END AS extension
           FROM (SELECT p_partkey, regexp_replace(regexp_replace({ODD_PATH}, '/(?:\\.?/)+', '/', 'g'),
           '^[./]+', '') AS norm FROM part)""")
def path_forms(t):
    norm = paths.normalize_repo_path(F.expr(ODD_PATH))
    return t.read("part").select(
        "p_partkey", norm.alias("norm"), paths.module_of(norm).alias("module"),
        paths.python_module(norm).alias("python_module"),
        F.coalesce(paths.extension(norm), F.lit("")).alias("extension"))


@query("flt1_skip_rules", "FLT1 FLT1b FLT1c FLT2 STR15 SRC1",
       f"""SELECT p_partkey, regexp_matches(p, '(?:^|/)(?:{_DIRS})/') AS under_skip_dir,
           regexp_matches(p, '(?:^|/)(?:{_DIRS})(?:/|$)') AS has_skip_part,
           regexp_matches(p, '{_DIRS}') AS mentions_skip_name,
           regexp_matches(b, '\\.min\\.js$|\\.bundle\\.js$|_pb2\\.py$|\\.lock$|\\.sum$|\\.map$') OR
             contains(b, 'package-lock.json') OR contains(b, 'yarn.lock') OR
             contains(b, 'poetry.lock') AS skipped_file,
           regexp_matches(p, '(?:^|/)(?:tests|test|__tests__|spec)(?:/|$)') OR
             regexp_matches(b, 'test_|_test\\.|\\.test\\.|\\.spec\\.') AS is_test
           FROM (SELECT p_partkey, {ODD_PATH} AS p, regexp_extract({ODD_PATH}, '([^/]*)$', 1) AS b
           FROM part)""")
def skip_rules(t):
    path = F.expr(ODD_PATH)
    return t.read("part").select(
        "p_partkey", paths.under_skip_dir(path).alias("under_skip_dir"),
        paths.has_skip_part(path).alias("has_skip_part"),
        paths.mentions_skip_name(path).alias("mentions_skip_name"),
        paths.is_skipped_file(path).alias("skipped_file"), paths.is_test_path(path).alias("is_test"))


_BARE = "regexp_replace(trim(github_url), '/+$', '')"
_NORMAL = (f"CASE WHEN {_BARE} LIKE 'https://github.com/%' THEN {_BARE} "
           f"WHEN {_BARE} LIKE 'http://github.com/%' THEN replace({_BARE}, 'http://', 'https://') "
           f"WHEN {_BARE} LIKE 'github.com/%' THEN 'https://' || {_BARE} "
           f"WHEN {_BARE} NOT LIKE 'http%' THEN 'https://github.com/' || {_BARE} ELSE {_BARE} END")


@query("str3_repository_urls", "STR3 STR4 STR5",
       f"""SELECT repo_id, url, string_split(url, '/')[-2] AS owner, string_split(url, '/')[-1] AS name,
           CASE WHEN contains(short, '/') THEN string_split(short, '/')[1] || '/' ||
           string_split(short, '/')[2] ELSE short END AS repo_key FROM (SELECT repo_id, {_NORMAL} AS url,
           regexp_replace({_BARE}, '^(?:https://|http://|)github\\.com/', '') AS short
           FROM repositories)""", ("repositories",))
def repository_urls(t):
    url = F.col("github_url")
    return t.repositories.select(
        "repo_id", paths.normalize_url(url).alias("url"), paths.url_owner(url).alias("owner"),
        paths.url_name(url).alias("name"), paths.repo_key(url).alias("repo_key"))


@query("str3_page_urls", "STR3 STR5",
       """SELECT page_id, regexp_replace(url, '/+$', '') AS normalized,
          string_split(regexp_replace(url, '/+$', ''), '/')[1] || '/' ||
          string_split(regexp_replace(url, '/+$', ''), '/')[2] AS repo_key FROM pages""")
def page_urls(t):
    return t.read("pages").select("page_id", paths.normalize_url(F.col("url")).alias("normalized"),
                                  paths.repo_key(F.col("url")).alias("repo_key"))


SHOWN = ("CASE p_partkey % 4 WHEN 0 THEN '/tmp/repos/job' || p_size || '/src/a_' || p_partkey || "
         "'.py:' || p_size WHEN 1 THEN 'src/b.py:?' WHEN 2 THEN "
         "'very/long/path/that/needs/more/than/the/shown/width_' || p_partkey || '.py' "
         "ELSE 'c_' || p_partkey || '.py' END")


@query("str6_clean_path", "STR6 STR7 STR16",
       f"""SELECT p_partkey, CASE WHEN length(clean) > 45 THEN clean[1:45] || '...' ELSE clean END
           AS shown, {TITLE("lower(replace(p_name, ' ', '_'))")} AS label
           FROM (SELECT *, regexp_replace(regexp_replace({SHOWN}, '^/tmp/repos/[^/]+/', ''),
           ':\\?$|:\\d+$', '') AS clean FROM part)""")
def shown_paths(t):
    name = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return t.read("part").select(
        "p_partkey", paths.truncate(paths.clean_path(F.expr(SHOWN)), 45, 45).alias("shown"),
        paths.title_label(name).alias("label"))


@query("str18_formatting", "STR18 DTE2",
       """SELECT scan_id, '$' || format('{:,}', CAST(ROUND(total_cost_usd, 0) AS BIGINT)) AS money,
          CAST(CAST(ROUND(debt_score, 1) AS DECIMAL(18,1)) AS VARCHAR) AS score,
          CAST(CAST(ROUND(debt_score * 10, 0) AS BIGINT) AS VARCHAR) || '%' AS pct,
          strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso_date, strftime(created_at, '%b %d')
          AS shown_date, strftime(created_at, '%b %d, %Y') AS long_date FROM scans""", ("scans",))
def formatting(t):
    at = F.col("created_at")
    return t.scans.select(
        "scan_id", text.money_text(F.col("total_cost_usd")).alias("money"),
        text.fixed_text(F.col("debt_score"), 1).alias("score"),
        text.percent_text(F.col("debt_score") / 10).alias("pct"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_date"),
        F.date_format(at, "MMM dd").alias("shown_date"),
        F.date_format(at, "MMM dd, yyyy").alias("long_date"))


@query("flt8_repository_search", "FLT8 PRJ30",
       """SELECT c_custkey AS id, 'org/' || c_name AS full_name, 'login' || (c_custkey % 10) AS
          owner_login, c_custkey % 2 = 0 AS private, c_mktsegment AS language FROM customer
          WHERE contains(lower('org/' || c_name || ' ' || 'Segment ' || c_mktsegment || ' ' ||
          c_mktsegment), 'mach')""")
def repository_search(t):
    from arrears.sources.readers import matches_search, repository_payloads

    documents = t.read("customer").select(F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.concat(F.lit("org/"), "c_name").alias("full_name"),
        (F.col("c_custkey") % 2 == 0).alias("private"),
        F.concat(F.lit("Segment "), "c_mktsegment").alias("description"),
        F.col("c_mktsegment").alias("language"),
        F.struct(F.concat(F.lit("login"), F.col("c_custkey") % 10).alias("login")).alias("owner"),
    )).alias("payload"))
    return repository_payloads(documents).filter(matches_search(" MACH ")).select(
        "id", "full_name", "owner_login", "private", "language")


@query("flt3_security_filter", "FLT3 CMP4",
       f"""SELECT p_partkey, severity, hours, {R('hours * 84.55::DOUBLE')} AS cost_usd,
           {IMPACT_SQL('severity')} AS business_impact FROM (SELECT p_partkey, lower(s) AS severity,
           CAST(CASE s WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 4 ELSE 1.5 END AS DOUBLE) AS hours
           FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW'
           END AS s, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS c
           FROM part) WHERE s = 'HIGH' OR (s = 'MEDIUM' AND c IN ('MEDIUM', 'HIGH')))""")
def security_filter(t):
    from arrears.operators.items import price_items
    from arrears.operators.security import security_items

    results = t.read("part").selectExpr(
        "'hub' AS repo_id", "'src/' || p_partkey AS filename", "CAST(p_partkey AS INT) AS line_number",
        "p_name AS issue_text", "CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' "
        "END AS issue_severity", "CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE "
        "'LOW' END AS issue_confidence", "'B1' AS test_id", "'CWE-UNKNOWN' AS cwe_id")
    return price_items(security_items(results)).select(
        F.col("line").cast("long").alias("p_partkey"), "severity",
        F.col("remediation_hours").alias("hours"), "cost_usd", "business_impact")


@query("dte1_activity_and_freshness", "DTE1 DTE3 DTE4",
       """SELECT o_orderkey, o_orderdate > TIMESTAMP '2001-06-01' - INTERVAL 90 DAYS AS active,
          CAST(ROUND(CAST(CAST(o_custkey AS DOUBLE) / greatest(date_diff('day', o_orderdate,
          TIMESTAMP '2002-01-01') / 7.0::DOUBLE, 1::DOUBLE) AS DECIMAL(38,8)), 1) AS DOUBLE)
          AS per_week FROM orders WHERE
          (epoch(TIMESTAMP '2001-06-01') - epoch(o_orderdate)) / 3600.0 < 24 * 365""")
def activity(t):
    from arrears.operators.rates import fresh

    snapshots = t.read("orders").withColumn("fetched_at", F.col("o_orderdate"))
    days = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate"))
    return fresh(snapshots, "2001-06-01", F.lit(24 * 365)).select(
        "o_orderkey", (F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp")
                       - F.expr("INTERVAL 90 DAYS")).alias("active"),
        numeric.places(F.col("o_custkey").cast("double") / F.greatest(days / 7, F.lit(1.0)), 1)
        .alias("per_week"))


