"""Hourly-rate and benchmark tables from landed observations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import text
from arrears.functions.numeric import cents, lookup, places
from arrears.operators.common import running_sums, stage


def with_roles(df: DataFrame) -> DataFrame:
    """Each row once per role, with the role's fallback rate."""
    roles = F.array(*[F.lit(role) for role in C.ROLE_RATES])
    return df.withColumn("role", F.explode(roles)).withColumn(
        "fallback", lookup(F.col("role"), C.ROLE_RATES))


def wage_rates(observations: DataFrame) -> DataFrame:
    """Role rates from the first series, in series order, whose latest value is positive.

    ``observations``: series_rank, observation_rank (0 = latest), value.
    """
    latest = observations.filter("observation_rank = 0 AND value > 0")
    wage = with_roles(latest.agg(F.min_by("value", "series_rank").alias("wage")))
    live = F.col("wage").isNotNull()
    factor = lookup(F.col("role"), C.WAGE_ROLE_FACTORS)
    return wage.select("role", F.when(live, cents(F.col("wage") * factor))
                       .otherwise(cents(F.col("fallback"))).alias("rate"), live.alias("live"))


ACCURACY = 1000   # ranks of the sketch are right within one in so many of a key's values
MARGIN = 2.5 / ACCURACY


def upper_median(values: DataFrame, keys: list[str]) -> DataFrame:
    """Element n // 2 of the sorted values of each key, exact.

    A quantile sketch of each key, merged from those of the tasks, gives two values around the middle; the values between
    them, about one in two hundred, are counted and their running sums taken over ranges. How many values lie below
    is counted too, so the answer does not rest on the sketch: where it misses, the key's least and greatest
    value take the place of its bounds.
    """
    rows = stage(values.filter("value IS NOT NULL").select(*keys, "value"))
    bounds = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.percentile_approx("value", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("_q"),
        F.min("value").alias("_least"), F.max("value").alias("_most"))
    near = _same_keys(rows, bounds.select(*keys, "total", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_least", "_most"), keys)
    target = F.floor(F.col("total") / 2)
    counted = near.groupBy(*keys, "total", "_lo", "_hi", "_least", "_most").agg(
        F.count_if(F.col("value") < F.col("_lo")).alias("_below"), F.count_if(F.col("value") <= F.col("_hi")).alias("_upto"))
    low, high = F.col("_below") <= target, F.col("_upto") > target
    checked = stage(counted.select(*keys, "total", target.alias("target"), F.when(low, F.col("_lo")).otherwise(F.col("_least")).alias("_lo"),
                                   F.when(high, F.col("_hi")).otherwise(F.col("_most")).alias("_hi"),
                                   F.when(low, F.col("_below")).otherwise(F.lit(0)).alias("_below")))
    between = _same_keys(rows, checked, keys).filter("value BETWEEN _lo AND _hi")
    inside = between.groupBy(*keys, "value", "total", "target", "_below").agg(F.count("*").alias("n"))
    start = F.col("_below") + F.col("_before")
    return running_sums(inside, keys, [F.col("value")], "n", "_before").filter((start <= F.col("target")) & (F.col("target") < start + F.col("n"))).select(
        *keys, F.col("value").alias("median"), F.col("total").alias("sample_size"))


def _same_keys(rows: DataFrame, of_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their key; a null key is a key."""
    named = of_keys.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in of_keys.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def offer_rates(salaries: DataFrame, technologies: list[str]) -> DataFrame:
    """Role rates per technology from offers whose title or company mentions it.

    Every offer is matched against the stated technologies in one pass, without a join.
    """
    names = F.array(*[F.lit(name) for name in technologies])
    title, company = F.lower("title"), F.lower("company")
    mentioned = F.filter(names, lambda t: F.contains(title, F.lower(t))
                         | F.contains(company, F.lower(t)))
    hits = salaries.filter("total_compensation > 0").select(
        F.explode(mentioned).alias("technology"), F.col("total_compensation").alias("value"))
    median = upper_median(hits, ["technology"])
    asked = salaries.sparkSession.createDataFrame([(t,) for t in technologies], "technology string")
    joined = with_roles(asked).join(median, "technology", "left")
    live = F.col("median").isNotNull()
    factor = lookup(F.col("role"), C.OFFER_ROLE_FACTORS)
    return joined.select(
        "technology", "role", F.when(live, F.col("median") / C.HOURS_PER_YEAR * factor)
        .otherwise(F.col("fallback") * C.OFFER_FALLBACK_FACTOR).alias("rate"),
        live.alias("live"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


def role_of_years(years: Column) -> Column:
    """Role whose band holds the years; values between two bands belong to none."""
    case = F.when(F.lit(False), "")
    for role, (low, high) in C.ROLE_YEARS.items():
        case = case.when(years.between(low, high), role)
    return case


def survey_rates(survey: DataFrame, country: str = "United States of America",
                 first_rows: int | None = None, minimum: int = 50) -> DataFrame:
    """Mean hourly pay per role from the survey, or from its leading ``first_rows`` rows.

    ``survey``: seq (1-based row of the file), country, compensation, years.
    """
    used = survey.filter((F.col("country") == country) & (F.col("compensation") > 0)
                         & (F.col("compensation") < 1_000_000))
    if first_rows is not None:
        used = used.filter(F.col("seq") <= first_rows)
    sums = used.groupBy(role_of_years(F.coalesce("years", F.lit(0.0))).alias("band")).agg(
        F.count("*").alias("n"), F.sum(F.col("compensation").cast("decimal(18,2)")).alias("pay"))
    one = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample_size"), *[
        F.max(F.when(F.col("band") == role,
                     F.col("pay").cast("double") / F.col("n") / C.HOURS_PER_YEAR)).alias(role)
        for role in C.ROLE_RATES])
    live = F.col("sample_size") >= minimum
    mean = F.coalesce(*[F.when(F.col("role") == role, F.col(role)) for role in C.ROLE_RATES])
    return with_roles(one).select(
        "role", F.when(live, F.coalesce(mean, F.col("fallback"))).otherwise(F.col("fallback"))
        .alias("rate"), live.alias("live"), "sample_size")


def search_rates(snippets: DataFrame) -> DataFrame:
    """Upper median of hourly figures in search snippets per technology.

    A technology that was searched without any figure keeps the fallback and still counts as live.
    """
    figures = snippets.select("technology", F.explode(text.hourly_figures(F.col("body")))
                              .alias("value"))
    median = upper_median(figures, ["technology"])
    searched = snippets.select("technology").distinct()
    return searched.join(median, "technology", "left").select(
        "technology", F.coalesce("median", F.lit(C.ROLE_RATES["mid"])).alias("rate"),
        F.coalesce("sample_size", F.lit(0)).alias("figures_found"), F.lit(True).alias("live"))


def rate_sources(technologies: DataFrame, wages: DataFrame, offers: DataFrame, survey: DataFrame,
                 searches: DataFrame) -> DataFrame:
    """One row per (technology, role, source) with rate and live flag, fallbacks filled in."""
    tech = with_roles(technologies.select("technology").distinct())

    def named(df, name, rate):
        return df.select("technology", "role", F.lit(name).alias("source"),
                         rate.cast("double").alias("rate"),
                         F.coalesce("live", F.lit(False)).alias("live"))

    fallback = F.col("fallback")
    bls = named(tech.join(wages, "role", "left"), "bls", F.coalesce("rate", fallback))
    levels = named(tech.join(offers, ["technology", "role"], "left"), "levels",
                   F.coalesce("rate", fallback * C.OFFER_FALLBACK_FACTOR))
    so = named(tech.join(survey, "role", "left"), "so", F.coalesce("rate", fallback))
    ddg = named(tech.join(searches, "technology", "left"), "ddg",
                F.coalesce("rate", F.lit(C.ROLE_RATES["mid"]))
                * lookup(F.col("role"), C.OFFER_ROLE_FACTORS))
    return bls.unionByName(levels).unionByName(so).unionByName(ddg)


def blend_rates(sources: DataFrame, normalise: str = "live") -> DataFrame:
    """Weighted blend per (technology, role).

    All four rates are summed, but the weights are divided by the live weight only - the model's
    own definition; ``normalise='all'`` divides by the full weight instead.
    """
    weight = lookup(F.col("source"), C.BLEND_WEIGHTS)
    pivot = {name: F.max(F.when(F.col("source") == name, F.col("rate"))) for name in C.BLEND_WEIGHTS}
    live = {name: F.max(F.when((F.col("source") == name) & F.col("live"), weight).otherwise(0.0))
            for name in C.BLEND_WEIGHTS}
    wide = sources.groupBy("technology", "role").agg(
        *[v.alias(f"{k}_rate") for k, v in pivot.items()],
        *[v.alias(f"{k}_live") for k, v in live.items()],
        F.count_if("live").alias("sources_used"))
    live_weight = sum((F.col(f"{name}_live") for name in C.BLEND_WEIGHTS), F.lit(0.0))
    divisor = F.when(live_weight == 0, F.lit(1.0)).otherwise(live_weight)
    if normalise == "all":
        divisor = F.lit(1.0)
    blended = sum((F.col(f"{name}_rate") * (F.lit(w) / divisor)
                   for name, w in C.BLEND_WEIGHTS.items()), F.lit(0.0))
    return wide.select(
        "technology", "role", cents(blended).alias("blended_rate"),
        F.when(F.col("sources_used") >= 3, "high").when(F.col("sources_used") >= 2, "medium")
        .otherwise("low").alias("confidence"), "sources_used",
        *[cents(F.col(f"{name}_rate")).alias(f"{name}_rate") for name in C.BLEND_WEIGHTS])


# --- benchmarks -----------------------------------------------------------------------------------

def function_benchmark(snippets: DataFrame) -> DataFrame:
    """Largest dollar figure in range, else the published cost per function (one row)."""
    figure = F.max(F.array_max(text.dollar_figures(F.col("body"))))
    return snippets.agg(figure.alias("figure")).select(
        F.coalesce("figure", F.lit(C.FUNCTION_BENCHMARK)).alias("cost_per_function_usd"),
        F.col("figure").isNotNull().alias("live"))


def language_benchmarks(snippets: DataFrame) -> DataFrame:
    """Mean debt days and debt ratio per language from search snippets.

    Sums run over decimals, so the mean does not depend on the order of rows.
    """
    def total(values):
        return F.aggregate(values, F.lit(0).cast("decimal(28,4)"),
                           lambda acc, v: (acc + F.coalesce(v.try_cast("decimal(18,4)"), F.lit(0))).cast("decimal(28,4)"))

    body = F.col("body")
    days, ratios = text.day_figures(body), text.percent_figures(body, 1, 50)
    sums = snippets.select(
        "language", total(days).alias("day_sum"), F.size(days).alias("day_n"),
        total(ratios).alias("ratio_sum"), F.size(ratios).alias("ratio_n"),
    ).groupBy("language").agg(*[F.sum(c).alias(c)
                                for c in ("day_sum", "day_n", "ratio_sum", "ratio_n")])

    def mean(part, default):
        value = F.col(f"{part}_sum").cast("double") / F.nullif(f"{part}_n", F.lit(0))
        return places(F.coalesce(value, F.lit(default)), 1)

    return sums.select("language", mean("day", C.DEBT_DAYS_BENCHMARK).alias("avg_debt_days"),
                       mean("ratio", C.DEBT_RATIO_BENCHMARK).alias("avg_debt_ratio_pct"))


def benchmark_table(languages: DataFrame, cost: DataFrame) -> DataFrame:
    """Language figures beside the one-row function benchmark."""
    one = F.broadcast(cost.withColumn("_one", F.lit(1)))
    return languages.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one").withColumn(
        "confidence", F.when(F.col("live"), "high").otherwise("low"))


def breach_figures(snippets: DataFrame) -> DataFrame:
    """Largest stated breach cost and largest stated probability (one row)."""
    body = F.col("body")
    found = snippets.agg(
        F.max(F.array_max(text.million_figures(body))).alias("cost"),
        F.max(F.array_max(text.percent_figures(body, 0.1, 50))).alias("pct"))
    return found.select(
        F.coalesce("cost", F.lit(C.BREACH_COST)).alias("average_breach_cost"),
        F.coalesce(F.col("pct") / 100, F.lit(C.BREACH_PROBABILITY)).alias("breach_probability"),
        (F.col("cost").isNotNull() & F.col("pct").isNotNull()).alias("live"))


# --- stack rates ----------------------------------------------------------------------------------

def stack_rates(stacks: DataFrame, blended: DataFrame) -> DataFrame:
    """Rates per debt category of every repository from its main technologies.

    ``stacks``: repo_id, primary_language and technology lists. ``blended``: technology (lower
    case) and mid/junior rate columns; a technology without a rate falls back to the base rate.
    """
    def first(column):
        return F.get(F.col(column), F.lit(0))

    rates = blended.select(F.lower("technology").alias("technology"), "mid_rate", "junior_rate")
    picks = stacks.select(
        "repo_id", "primary_language", "frameworks", "cloud", "ai_ml", "databases",
        F.explode(F.array_distinct(F.filter(F.concat(
            F.array(F.lower("primary_language")),
            F.array(*[F.lower(first(c)) for c in
                      ("frameworks", "ai_ml", "databases", "cloud", "infra")])),
            lambda t: t.isNotNull()))).alias("technology"))
    # Technologies of a repository are at most six, so this is one small group per repository.
    joined = picks.join(rates, "technology", "left")
    lang = F.lower("primary_language")

    def rate_of(target, column="mid_rate"):
        return F.max(F.when(F.col("technology") == target, F.col(column)))

    wide = joined.groupBy("repo_id").agg(
        F.first("primary_language").alias("primary_language"),
        F.coalesce(rate_of(lang), F.lit(C.ROLE_RATES["mid"])).alias("base_rate"),
        F.coalesce(rate_of(lang, "junior_rate"), F.lit(C.ROLE_RATES["junior"])).alias("doc_rate"),
        rate_of(F.lower(first("frameworks"))).alias("framework_rate"),
        F.max(F.when((F.col("technology") == F.lower(first("frameworks")))
                     | (F.col("technology") == F.lower(first("cloud"))), F.col("mid_rate")))
        .alias("security_top"),
        rate_of(F.lower(first("ai_ml"))).alias("ai_rate"),
        rate_of(F.lower(first("databases"))).alias("database_rate"),
        F.first(first("frameworks")).alias("framework"), F.first(first("cloud")).alias("cloud_tech"),
        F.first(first("ai_ml")).alias("ai_tech"), F.first(first("databases")).alias("database"))
    base = F.col("base_rate")
    has_ai = F.col("ai_tech").isNotNull()
    special = has_ai | F.col("database").isNotNull() | F.col("cloud_tech").isNotNull()
    return wide.select(
        "repo_id", cents(base).alias("base_rate"),
        cents(F.coalesce("framework_rate", base)).alias("code_quality_rate"),
        cents(F.when(F.col("framework").isNotNull() | F.col("cloud_tech").isNotNull(),
                     F.coalesce("security_top", base)).otherwise(base * 1.1))
        .alias("security_rate"),
        cents(F.coalesce("ai_rate", base * 1.2)).alias("ai_ml_rate"),
        cents(F.coalesce("database_rate", base)).alias("database_rate"),
        cents(F.col("doc_rate")).alias("documentation_rate"), cents(base).alias("test_rate"),
        (F.when(special, 15).otherwise(0) + F.when(has_ai, 10).otherwise(0))
        .alias("specialist_premium_pct"))


def provenance(observed: DataFrame) -> DataFrame:
    """Distinct ``name:live`` / ``name:fallback`` marks per repository (a handful of names)."""
    mark = F.concat_ws(":", "source", F.when(F.col("used_fallback"), "fallback").otherwise("live"))
    return observed.select("repo_id", mark.alias("mark")).distinct()


def fresh(snapshots: DataFrame, as_of, hours: Column) -> DataFrame:
    """Dimension snapshots younger than their time to live."""
    age = (F.lit(as_of).cast("timestamp").cast("long") - F.col("fetched_at").cast("timestamp").cast("long")) / 3600
    return snapshots.filter(age < hours)
