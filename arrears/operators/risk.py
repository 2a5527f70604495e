"""Risky files: complexity joined with change pressure."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import cents
from arrears.functions.paths import normalize_repo_path
from arrears.functions.scoring import (
    business_impact, churn_multiplier, confidence, effort_minutes, price, severity_name,
    severity_rank,
)
from arrears.operators.items import debt_items


def parsed_rules(rules: DataFrame) -> DataFrame:
    effort = F.coalesce("base_effort", "fixed_effort")
    return rules.select(
        "rule_key", effort_minutes(effort).alias("minutes"),
        F.coalesce("severity", F.lit("MAJOR")).alias("severity"),
        F.coalesce("type", F.lit("CODE_SMELL")).alias("type"))


def rule_minutes(rules: DataFrame) -> DataFrame:
    """Mean minutes of code-smell rules per severity: at most one row per rule severity."""
    return (rules.filter("type = 'CODE_SMELL'").groupBy("severity")
            .agg((F.sum("minutes").cast("double") / F.count("*")).alias("minutes")))


def minutes_by_complexity(rules: DataFrame) -> DataFrame:
    """Minutes for each of the four complexity severities, with the fixed default where unmeasured."""
    spark = rules.sparkSession
    grid = spark.createDataFrame(
        [(name, rule, float(C.RULE_SEVERITY_MINUTES[rule]))
         for name, rule in C.COMPLEXITY_TO_RULE_SEVERITY.items()],
        "complexity_severity string, severity string, default_minutes double")
    means = rule_minutes(rules)
    return grid.join(means, "severity", "left").select(
        "complexity_severity", F.coalesce("minutes", "default_minutes").alias("minutes"))


def minutes_for_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    default = float(C.RULE_SEVERITY_MINUTES["MAJOR"])
    return keys.join(rules.select("rule_key", "minutes"), "rule_key", "left").withColumn(
        "minutes", F.coalesce(F.col("minutes").cast("double"), F.lit(default)))


def functions_per_file(functions: DataFrame) -> DataFrame:
    known = F.col("severity").isin(*C.SEVERITY_RANK)
    return (functions.withColumn("path", normalize_repo_path(F.col("path")))
            .groupBy("repo_id", "path").agg(
                F.max("complexity").alias("max_complexity"),
                F.count("*").alias("function_count"),
                severity_name(F.max(F.when(known, severity_rank(F.col("severity")))))
                .alias("severity")))


def risky_files(functions: DataFrame, hotspots: DataFrame, minutes: DataFrame,
                rate: float = C.ROLE_RATES[C.CATEGORY_ROLE["code_quality"]],
                used_fallback: bool = False,
                suspects: DataFrame | None = None) -> DataFrame:
    """Files with measured functions and change history, priced at their category's role rate.

    Functions are reduced to one row per file before the join. ``minutes`` has four rows (one per
    severity), so it is broadcast. ``suspects`` are files whose cost is raised by half.
    """
    joined = (functions_per_file(functions).join(hotspots, ["repo_id", "path"])
              .join(F.broadcast(minutes.withColumnRenamed("complexity_severity", "severity")),
                    "severity"))
    churn = churn_multiplier(F.col("change_count"))
    fallback = F.lit(used_fallback)
    trust = confidence("git_history", fallback, ~fallback)
    impact = business_impact(F.col("severity"), churn, F.col("change_count"))
    hours = F.col("minutes") * churn / 60
    cost = price(hours, F.lit(rate), impact, trust)
    if suspects is not None:
        flagged = suspects.select("repo_id", "path", F.lit(1.5).alias("_premium")).distinct()
        joined = joined.join(flagged, ["repo_id", "path"], "left")
        cost = cents(cost.cast("double") * F.coalesce("_premium", F.lit(1.0)))
    return debt_items(
        joined, "risky_files", category="code_quality", severity=F.col("severity"),
        kind="complexity_hotspot", hours=hours, impact=impact, trust=trust,
        complexity=F.col("max_complexity"), change_count=F.col("change_count"),
        churn_multiplier=churn, base_minutes=cents(F.col("minutes")),
        adjusted_minutes=cents(F.col("minutes") * churn), used_fallback=fallback, fixed_cost=cost)
