"""Debt items: the common row of every rule, priced in one projection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import cents, places
from arrears.functions.scoring import confidence, price

# Steps fix the order in which equally ranked items appear.
STEPS = {name: number for number, name in enumerate((
    "risky_files", "architecture", "duplication", "reliability", "performance", "dead_code",
    "security", "documentation", "test_debt", "dependency_hygiene", "vulnerabilities"), start=1)}

ITEM_FIELDS = {
    "repo_id": "string", "step": "int", "file": "string", "category": "string",
    "severity": "string", "type": "string", "function": "string", "line": "int",
    "remediation_hours": "decimal(18,6)", "confidence": "decimal(18,2)",
    "business_impact": "string", "fixed_cost": "decimal(18,2)", "fixed_rate": "double",
    "complexity": "int", "change_count": "long", "churn_multiplier": "double",
    "base_minutes": "decimal(18,2)", "adjusted_minutes": "decimal(18,2)",
    "used_fallback": "boolean", "issue_text": "string", "doc_type": "string",
    "package": "string", "version_specifier": "string", "cve_id": "string",
    "cvss_score": "double", "fixed_version": "string", "detail": "string",
}

COPIES = "copies"  # how many items a row stands for, where alike ones are counted


def copies(items: DataFrame) -> Column:
    return F.col(COPIES) if COPIES in items.columns else F.lit(1).cast("long")


def debt_items(df: DataFrame, step: str, *, category: str, severity, kind, hours, impact,
               trust: Column | None = None, **extra) -> DataFrame:
    """Project rule hits into debt items. ``file``, ``function``, ``line`` and ``copies`` may be given in extra."""
    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    values = {
        "repo_id": F.col("repo_id"), "step": F.lit(STEPS[step]), "file": F.col("path"),
        "category": F.lit(category), "severity": column(severity), "type": column(kind),
        "remediation_hours": column(hours), "business_impact": column(impact),
        "confidence": confidence("static_analysis") if trust is None else trust,
        **{name: column(value) for name, value in extra.items()},
    }
    given = df.select(*[value.alias(name) for name, value in values.items()])
    fields = ITEM_FIELDS | ({COPIES: "long"} if COPIES in values else {})
    return given.selectExpr(*[
        f"CAST({name if name in values else 'NULL'} AS {dtype}) AS {name}"
        for name, dtype in fields.items()])


def price_items(items: DataFrame, rate=C.ROLE_RATES["mid"], security_rate=None,
                documentation_rate=None) -> DataFrame:
    """Add ``rate`` and ``cost_usd``. Rates are numbers, or columns already joined to the items.

    Architecture work is priced 20 % above the base rate. Items with a fixed cost keep it; items
    with a fixed rate ignore the base rate.
    """
    def column(value):
        return value if isinstance(value, Column) else F.lit(float(value))

    base = column(rate)
    category = F.col("category")
    applied = F.coalesce(
        F.col("fixed_rate"),
        F.when(category == "architecture", base * 1.2)
        .when(category == "security", column(security_rate) if security_rate is not None else base)
        .when(category == "documentation",
              column(documentation_rate) if documentation_rate is not None
              else F.lit(C.ROLE_RATES["junior"]))
        .otherwise(base))
    cost = F.coalesce("fixed_cost", price(F.col("remediation_hours"), applied,
                                          F.col("business_impact"), F.col("confidence")))
    return (items.withColumn("rate", cents(applied)).withColumn("cost_usd", cost)
            .drop("fixed_cost", "fixed_rate"))


def union_items(*parts: DataFrame) -> DataFrame:
    """All items of a scan, in one row shape."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def hours_from_minutes(minutes: Column) -> Column:
    return places(minutes.cast("double") / 60, 6)
