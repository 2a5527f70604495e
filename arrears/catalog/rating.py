"""Rate, survey and benchmark jobs on observations derived from the given tables."""

from pyspark.sql import functions as F

from arrears.catalog.base import R, query
from arrears.operators import rates

SNIPPET = """CASE o_orderkey % 6
 WHEN 0 THEN 'Average pay is $' || (15 + o_orderkey % 150) || '.50 per hour in 2025'
 WHEN 1 THEN 'Up to $' || (o_orderkey % 200 + 40) || 'K per year and $' || (100 + o_orderkey % 50) ||
   ',000 annual, or $' || (o_orderkey % 90) || '/hr'
 WHEN 2 THEN 'Debt is ' || (o_orderkey % 60) || '.5 days, about ' || (o_orderkey % 70) || '% of cost'
 WHEN 3 THEN 'Breach cost $' || (o_orderkey % 25) || '.' || (o_orderkey % 9) || ' million'
 WHEN 4 THEN 'Poor quality costs $' || (o_orderkey % 13) || ',500 or $' || (o_orderkey % 99) || ' each'
 ELSE 'no figure at all' END"""
TECH = "CASE o_custkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' WHEN 2 THEN 'Rust' ELSE 'Go' END"
SNIPPETS = f"""snippets AS (SELECT o_orderkey, {TECH} AS technology, CASE o_custkey % 3 WHEN 0 THEN 'py'
WHEN 1 THEN 'go' ELSE 'ts' END AS language, {SNIPPET} AS body FROM orders)"""


def snippets(t):
    return t.read("orders").selectExpr(
        "o_orderkey", f"{TECH} AS technology",
        "CASE o_custkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'ts' END AS language",
        f"{SNIPPET} AS body")


def _all(pattern):
    return (f"list_transform(regexp_extract_all(body, '{pattern}', 1), "
            "lambda v: try_cast(replace(v, ',', '') AS DOUBLE))")


HOURLY = (f"list_filter(list_concat(list_concat({_all('(?i)\\$(\\d+(?:\\.\\d+)?)\\s*(?:per hour|/hr|hourly)')},"
          f"list_transform({_all('(?i)\\$(\\d+(?:,\\d+)?(?:\\.\\d+)?)[kK]\\s*(?:per year|annual|/yr)')}, "
          "lambda v: CASE WHEN v < 1000 THEN v * 1000 ELSE v END / 2080)),"
          f"list_transform({_all('(?i)\\$(\\d+(?:,\\d+)+)\\s*(?:per year|annual)')}, "
          "lambda v: v / 2080)), lambda v: v >= 20 AND v <= 300)")


def MEDIAN(source, key):
    """Element n // 2 of the sorted values, by plain ranking."""
    return f"""(SELECT {key}, value AS median, n AS sample_size FROM (SELECT {key}, value, row_number() OVER
    (PARTITION BY {key} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source})
    WHERE i = n // 2)"""


SALARIES = """salaries AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Python Engineer' WHEN 1 THEN
'Java Developer' WHEN 2 THEN 'Analyst' WHEN 3 THEN 'PYTHON and Java lead' ELSE 'Designer' END AS title,
'Company ' || CASE WHEN o_custkey % 11 = 0 THEN 'pythonic' ELSE 'x' END AS company,
CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END AS total_compensation FROM orders)"""


def salaries(t):
    t.read("orders").createOrReplaceTempView("arrears_orders")
    return t.spark.sql(SALARIES[len("salaries AS ("):-1].replace("FROM orders", "FROM arrears_orders"))


ROLES = "(VALUES ('junior', 55.10::DOUBLE, 0.8::DOUBLE), ('mid', 84.55::DOUBLE, 1.0::DOUBLE), ('senior', 128.37::DOUBLE, 1.3::DOUBLE)) roles(role, fallback, factor)"
ASKED = "(VALUES ('Python'), ('Java'), ('Rust')) asked(technology)"
HITS = f"""hits AS (SELECT technology, total_compensation AS value FROM salaries JOIN {ASKED} ON
contains(lower(title), lower(technology)) OR contains(lower(company), lower(technology)) WHERE
total_compensation > 0)"""
OFFERS = f"""{SALARIES}, {HITS}, offers AS (SELECT technology, role, CASE WHEN median IS NOT NULL THEN median
/ 2080 * factor ELSE fallback * 1.05::DOUBLE END AS rate, median IS NOT NULL AS live, coalesce(sample_size,
0) AS sample_size FROM {ASKED} CROSS JOIN {ROLES} LEFT JOIN {MEDIAN('hits', 'technology')} USING
(technology))"""


@query("agg23_upper_median", "AGG23",
       f"SELECT o_custkey, median, sample_size FROM {MEDIAN('(SELECT o_custkey, o_totalprice AS value FROM orders)', 'o_custkey')}")
def upper_median(t):
    values = t.read("orders").select("o_custkey", F.col("o_totalprice").alias("value"))
    return rates.upper_median(values, ["o_custkey"])


@query("rat2_offer_rates", "RAT2 AGG23 STR17 MTH4 SRC8",
       f"WITH {OFFERS} SELECT technology, role, {R('rate', 6)} AS rate, live, sample_size FROM offers")
def offer_rates(t):
    return rates.offer_rates(salaries(t), ["Python", "Java", "Rust"]).withColumn(
        "rate", rates.places(F.col("rate"), 6))


WAGES = """wages AS (SELECT role, CAST(ROUND(CAST(coalesce(wage * f, fb) AS DECIMAL(38,8)), 2) AS DOUBLE) AS
rate, wage IS NOT NULL AS live FROM (VALUES ('junior', 0.7::DOUBLE, 55.10::DOUBLE), ('mid', 1.0::DOUBLE,
84.55::DOUBLE), ('senior', 1.5::DOUBLE, 128.37::DOUBLE)) r(role, f, fb) CROSS JOIN (SELECT
arg_min((p_size - 25)::DOUBLE, p_partkey) AS wage FROM part WHERE p_partkey % 2 = 0 AND p_size > 25))"""


def observations(t):
    return t.read("part").selectExpr("p_partkey AS series_rank", "p_partkey % 2 AS observation_rank",
                                     "CAST(p_size - 25 AS DOUBLE) AS value")


@query("rat1_wage_rates", "RAT1 MTH4", f"WITH {WAGES} SELECT * FROM wages")
def wage_rates(t):
    return rates.wage_rates(observations(t))


def survey(t):
    return t.read("orders").selectExpr(
        "o_orderkey + 1 AS seq", "CASE WHEN o_orderstatus = 'F' THEN 'United States of America' ELSE "
        "'Elsewhere' END AS country", "o_totalprice AS compensation",
        "CASE WHEN o_orderkey % 19 <> 0 THEN (o_custkey % 240) / 10.0D END AS years")


def SURVEY(limit):
    cap = f"AND o_orderkey + 1 <= {limit}" if limit else ""
    return f"""used AS (SELECT o_totalprice AS comp, CASE WHEN o_orderkey % 19 <> 0 THEN (o_custkey % 240) /
    10.0::DOUBLE ELSE 0 END AS years FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND
    o_totalprice < 1000000 {cap}), survey AS (SELECT role, CASE WHEN n >= 50 THEN coalesce(mean, fb) ELSE fb
    END AS rate, n >= 50 AS live, n AS sample_size FROM (VALUES ('junior', 0, 2, 55.10::DOUBLE), ('mid', 3, 7,
    84.55::DOUBLE), ('senior', 8, 99, 128.37::DOUBLE)) r(role, lo, hi, fb) CROSS JOIN (SELECT count(*) AS n
    FROM used) LEFT JOIN (SELECT band, sum(comp::DECIMAL(18,2))::DOUBLE / count(*) / 2080 AS mean FROM (SELECT
    comp, CASE WHEN years BETWEEN 0 AND 2 THEN 'junior' WHEN years BETWEEN 3 AND 7 THEN 'mid' WHEN years
    BETWEEN 8 AND 99 THEN 'senior' END AS band FROM used) GROUP BY band) ON band = role)"""


@query("rat3_survey_rates", "RAT3 AGG24 JON16",
       f"WITH {SURVEY(None)} SELECT role, {R('rate', 6)} AS rate, live, sample_size FROM survey")
def survey_rates(t):
    return rates.survey_rates(survey(t)).withColumn("rate", rates.places(F.col("rate"), 6))


@query("rat3_survey_rates_whole", "RAT3 AGG24 JON16",
       f"WITH {SURVEY(None)} SELECT role, {R('rate', 6)} AS rate, live, sample_size FROM survey")
def survey_rates_whole(t):
    return rates.survey_rates(survey(t), first_rows=None).withColumn(
        "rate", rates.places(F.col("rate"), 6))


SEARCH = f"""{SNIPPETS}, figures AS (SELECT technology, unnest({HOURLY}) AS value FROM snippets), searches AS
(SELECT technology, coalesce(median, 84.55::DOUBLE) AS rate, coalesce(sample_size, 0) AS figures_found FROM
(SELECT DISTINCT technology FROM snippets) LEFT JOIN {MEDIAN('figures', 'technology')} USING (technology))"""


@query("rat4_search_rates", "RAT4 STR13 AGG23",
       f"WITH {SEARCH} SELECT technology, {R('rate', 6)} AS rate, figures_found FROM searches")
def search_rates(t):
    return rates.search_rates(snippets(t)).drop("live").withColumn(
        "rate", rates.places(F.col("rate"), 6))


BLEND = f"""{OFFERS}, {WAGES}, {SURVEY(None)}, {SEARCH}, grid AS (SELECT s.technology, r.role, coalesce(w.rate,
fallback) AS bls, coalesce(w.live, false) AS bls_live, coalesce(o.rate, fallback * 1.05::DOUBLE) AS levels,
coalesce(o.live, false) AS levels_live, coalesce(v.rate, fallback) AS so, coalesce(v.live, false) AS so_live,
s.rate * factor AS ddg FROM searches s CROSS JOIN {ROLES.replace('roles(', 'r(')} LEFT JOIN wages w ON w.role =
r.role LEFT JOIN offers o ON o.technology = s.technology AND o.role = r.role LEFT JOIN survey v ON v.role =
r.role), weights AS (SELECT *, CASE WHEN bls_live THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN levels_live THEN
0.3::DOUBLE ELSE 0 END + CASE WHEN so_live THEN 0.2::DOUBLE ELSE 0 END + 0.1::DOUBLE AS w, bls_live::INT +
levels_live::INT + so_live::INT + 1 AS n FROM grid)"""


@query("rat5_blended_rates", "RAT5 AGG25",
       f"""WITH {BLEND} SELECT technology, role, {R('''bls * (0.4::DOUBLE / w) + levels * (0.3::DOUBLE / w) +
           so * (0.2::DOUBLE / w) + ddg * (0.1::DOUBLE / w)''')} AS blended_rate, CASE WHEN n >= 3 THEN 'high'
           WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence, n::BIGINT AS sources_used, {R('bls')} AS
           bls_rate, {R('levels')} AS levels_rate, {R('so')} AS so_rate, {R('ddg')} AS ddg_rate
           FROM weights""")
def blended_rates(t):
    searches = rates.search_rates(snippets(t))
    sources = rates.rate_sources(
        searches, rates.wage_rates(observations(t)),
        rates.offer_rates(salaries(t), ["Python", "Java", "Rust"]),
        rates.survey_rates(survey(t)), searches)
    return rates.blend_rates(sources)


@query("rat6_benchmarks", "RAT6 AGG26",
       f"""WITH {SNIPPETS}, lang AS (SELECT language, avg(d) AS d, avg(p) AS p FROM (SELECT language,
           unnest({_all('(\\d+(?:\\.\\d+)?)\\s*(?:days|debt days)')})::DECIMAL(18,4) AS d, NULL AS p FROM
           snippets UNION ALL SELECT language, NULL, unnest(list_filter({_all('(\\d+(?:\\.\\d+)?)\\s*%')},
           lambda v: v >= 1 AND v <= 50))::DECIMAL(18,4) FROM snippets) GROUP BY language), cost AS (SELECT
           max(v) AS c FROM (SELECT unnest({_all('\\$([\\d,]+(?:\\.\\d+)?)')}) AS v FROM snippets) WHERE
           v BETWEEN 100 AND 10000)
           SELECT language, {R('coalesce(d, 15)', 1)} AS avg_debt_days, {R('coalesce(p, 10)', 1)} AS
           avg_debt_ratio_pct, coalesce(c, 433)::DOUBLE AS cost_per_function_usd, c IS NOT NULL AS live,
           CASE WHEN c IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM lang CROSS JOIN cost""")
def benchmarks(t):
    rows = snippets(t)
    return rates.benchmark_table(rates.language_benchmarks(rows), rates.function_benchmark(rows))


@query("agg27_breach_figures", "AGG27",
       f"""WITH {SNIPPETS} SELECT coalesce(c * 1000000, 4880000)::DOUBLE AS average_breach_cost, coalesce(p /
           100, 0.046)::DOUBLE AS breach_probability, c IS NOT NULL AND p IS NOT NULL AS live FROM (SELECT
           max(v) AS c FROM (SELECT unnest({_all('(?i)\\$?([\\d,\\.]+)\\s*(?:million|m)')}) AS v FROM
           snippets) WHERE v BETWEEN 1 AND 20) CROSS JOIN (SELECT max(v) AS p FROM (SELECT
           unnest({_all('(\\d+(?:\\.\\d+)?)\\s*%')}) AS v FROM snippets) WHERE v BETWEEN 0.1 AND 50)""")
def breach_figures(t):
    return rates.breach_figures(snippets(t))


BLENDED = """blended AS (SELECT technology, max(o_orderkey % 97) + 40.0::DOUBLE AS mid_rate, max(o_orderkey %
89) + 20.0::DOUBLE AS junior_rate FROM (SELECT *, CASE o_custkey % 7 WHEN 0 THEN 'Py' WHEN 1 THEN 'Django'
WHEN 2 THEN 'Aws' WHEN 3 THEN 'Torch' WHEN 4 THEN 'Redis' WHEN 5 THEN 'Ts' ELSE 'Kafka' END AS technology
FROM orders) GROUP BY technology)"""


def blended_table(t):
    tech = F.expr("CASE o_custkey % 7 WHEN 0 THEN 'Py' WHEN 1 THEN 'Django' WHEN 2 THEN 'Aws' WHEN 3 THEN "
                  "'Torch' WHEN 4 THEN 'Redis' WHEN 5 THEN 'Ts' ELSE 'Kafka' END")
    return t.read("orders").groupBy(tech.alias("technology")).agg(
        (F.max(F.col("o_orderkey") % 97) + 40.0).alias("mid_rate"),
        (F.max(F.col("o_orderkey") % 89) + 20.0).alias("junior_rate"))


@query("agg32_stack_rates", "AGG32",
       f"""WITH {BLENDED}, s AS (SELECT c_custkey AS repo_id, CASE c_custkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN
           'ts' ELSE 'cobol' END AS lang, CASE WHEN c_custkey % 2 = 0 THEN 'django' END AS fw, CASE WHEN
           c_custkey % 5 = 0 THEN 'aws' END AS cloud, CASE WHEN c_custkey % 7 = 0 THEN 'torch' END AS ai,
           CASE WHEN c_custkey % 11 = 0 THEN 'redis' END AS db FROM customer), j AS (SELECT s.*,
           coalesce(l.mid_rate, 84.55::DOUBLE) AS base, coalesce(l.junior_rate, 55.10::DOUBLE) AS doc,
           f.mid_rate AS fr, c.mid_rate AS cr, a.mid_rate AS ar, d.mid_rate AS dr FROM s
           LEFT JOIN blended l ON lower(l.technology) = lang LEFT JOIN blended f ON lower(f.technology) = fw
           LEFT JOIN blended c ON lower(c.technology) = cloud LEFT JOIN blended a ON lower(a.technology) = ai
           LEFT JOIN blended d ON lower(d.technology) = db)
           SELECT repo_id, {R('base')} AS base_rate, {R('coalesce(fr, base)')} AS code_quality_rate,
           {R('CASE WHEN fw IS NULL AND cloud IS NULL THEN base * 1.1::DOUBLE ELSE coalesce(greatest(fr, cr), base) END')}
           AS security_rate, {R('coalesce(ar, base * 1.2::DOUBLE)')} AS ai_ml_rate, {R('coalesce(dr, base)')}
           AS database_rate, {R('doc')} AS documentation_rate, {R('base')} AS test_rate,
           CAST(CASE WHEN ai IS NOT NULL OR db IS NOT NULL OR cloud IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN
           ai IS NOT NULL THEN 10 ELSE 0 END AS INTEGER) AS specialist_premium_pct FROM j""")
def stack_rates(t):
    key = F.col("c_custkey")

    def some(cond, name):
        return F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    stacks = t.read("customer").select(
        key.alias("repo_id"), F.when(key % 3 == 0, "py").when(key % 3 == 1, "ts").otherwise("cobol")
        .alias("primary_language"), some(key % 2 == 0, "django").alias("frameworks"),
        some(key % 5 == 0, "aws").alias("cloud"), some(key % 7 == 0, "torch").alias("ai_ml"),
        some(key % 11 == 0, "redis").alias("databases"), some(key % 13 == 0, "kafka").alias("infra"))
    return rates.stack_rates(stacks, blended_table(t))


@query("agg34_provenance", "AGG34",
       """SELECT DISTINCT o_custkey AS repo_id, CASE WHEN o_orderkey % 2 = 0 THEN 'benchmarks' ELSE
          'hourly_rates' END || ':' || CASE WHEN o_orderpriority LIKE '5%' THEN 'fallback' ELSE 'live' END AS
          mark FROM orders""")
def provenance(t):
    observed = t.read("orders").selectExpr(
        "o_custkey AS repo_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'benchmarks' ELSE 'hourly_rates' END AS "
        "source", "o_orderpriority LIKE '5%' AS used_fallback")
    return rates.provenance(observed)
