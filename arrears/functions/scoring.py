"""Severity, confidence, impact and price of a finding; scores and bands of a scan."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import cents, clamp, lookup, places


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), C.SEVERITY_RANK, 0)


def severity_name(rank: Column) -> Column:
    """Inverse of ``severity_rank``; rank 0 or null reads as low."""
    return lookup(rank, {v: k for k, v in C.SEVERITY_RANK.items()}, "low")


def complexity_severity(complexity: Column) -> Column:
    bands = [(name, band) for name, band in C.COMPLEXITY_BANDS.items() if name != "critical"]
    case = None
    for name, (low, high) in bands:
        hit = complexity.between(low, high)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("critical")


def churn_multiplier(changes: Column) -> Column:
    case = None
    for threshold, factor in sorted(C.CHURN_STEPS, reverse=True):
        hit = changes >= threshold
        case = F.when(hit, factor) if case is None else case.when(hit, factor)
    return case.otherwise(1.0)


def confidence(category: Column | str, used_fallback: Column | None = None,
               has_history: Column | None = None) -> Column:
    """Confidence of a category, given by name or as a column."""
    default = C.CONFIDENCE["static_analysis"]
    value = (F.lit(C.CONFIDENCE.get(category, default)) if isinstance(category, str)
             else lookup(category, C.CONFIDENCE, default))
    if has_history is not None:
        value = F.when(has_history, value).otherwise(C.CONFIDENCE["fallback"])
    if used_fallback is not None:
        value = F.when(used_fallback, C.CONFIDENCE["fallback"]).otherwise(value)
    return value


def business_impact(severity: Column, churn: Column | None = None,
                    changes: Column | None = None) -> Column:
    rank = severity_rank(severity)
    churn = F.lit(1.0) if churn is None else churn
    changes = F.lit(0) if changes is None else changes
    return (F.when((rank >= 4) | (churn >= 2.2), "critical")
            .when((rank >= 3) | (changes >= 6), "high")
            .when((rank >= 2) | (changes >= 3), "medium")
            .otherwise("low"))


def price(hours: Column, rate: Column, impact: Column, conf: Column) -> Column:
    """Confidence-adjusted cost in cents precision."""
    weight = lookup(F.lower(impact), C.IMPACT_WEIGHTS, C.IMPACT_WEIGHTS["medium"])
    return cents(hours.cast("double") * rate.cast("double") * weight
                 * clamp(conf.cast("double"), 0.25, 1.0))


def debt_score(total: Column, functions: Column, benchmark: Column) -> Column:
    per_function = total.cast("double") / functions.cast("double")
    valid = (functions > 0) & (benchmark > 0)
    return places(F.when(valid, F.least(F.lit(C.SCORE_CAP),
                                        per_function / benchmark.cast("double") * 10))
                  .otherwise(F.lit(0.0)), 2)


def sanity_columns(total: Column, functions: Column, benchmark: Column) -> dict[str, Column]:
    """Cost per function against the industry benchmark."""
    bench = benchmark.cast("double")
    per_function = total.cast("double") / F.greatest(functions, F.lit(1)).cast("double")
    variance = (per_function - bench) / bench * 100
    text = F.when(F.lit(False), "")
    for factor, wording in C.ASSESSMENTS[:-1]:
        text = text.when(per_function < bench * factor, wording)
    return {
        "cost_per_function": places(per_function, 2),
        "industry_avg": bench,
        "variance_pct": places(variance, 2),
        "is_reasonable": (per_function <= bench) | (variance < C.VARIANCE_LIMIT),
        "assessment": text.otherwise(C.ASSESSMENTS[-1][1]),
    }


def _steps(table, holds, otherwise) -> Column:
    """Value of the first step of a table whose bound holds."""
    case = F.when(F.lit(False), F.lit(otherwise))
    for bound, value in table:
        case = case.when(holds(bound), F.lit(value))
    return case.otherwise(F.lit(otherwise))


def risk_level(score: Column) -> Column:
    return _steps(C.RISK_LEVELS, lambda floor: score >= floor, "low")


def score_band(score: Column) -> Column:
    """Three-step band used by dashboards and messages."""
    return F.when(score <= 3, "low").when(score <= 6, "moderate").otherwise("high")


def ownership_risk(owners: Column, share: Column, changes: Column) -> Column:
    shares = C.OWNERSHIP_SHARES
    return (F.when(changes <= 1, "low")
            .when(((owners <= 1) & (changes >= 3)) | (share >= shares["critical"]), "critical")
            .when((owners <= 2) | (share >= shares["high"]), "high")
            .when((owners <= 3) | (share >= shares["medium"]), "medium")
            .otherwise("low"))


def repo_multipliers(age_days: Column, bus_factor: Column, team: Column) -> dict[str, Column]:
    age = F.when(age_days < C.YOUNG_DAYS, C.YOUNG_MULTIPLIER).otherwise(
        _steps(C.AGE_MULTIPLIERS, lambda days: age_days > days, 1.0))
    bus = _steps(C.BUS_FACTOR_MULTIPLIERS, lambda people: bus_factor <= people, 1.0)
    size = _steps(C.TEAM_MULTIPLIERS, lambda people: team <= people, C.LARGE_TEAM_MULTIPLIER)
    return {
        "repo_age_multiplier": age,
        "bus_factor_multiplier": bus,
        "team_size_multiplier": size,
        "combined_multiplier": places(age * bus * size, 2),
    }


def cvss_severity(score: Column) -> Column:
    return (F.when(score.isNull(), "UNKNOWN").when(score >= 9.0, "CRITICAL")
            .when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").otherwise("LOW"))


def vulnerability_hours(severity: Column) -> Column:
    return lookup(severity, C.VULNERABILITY_HOURS, C.VULNERABILITY_HOURS["UNKNOWN"])


def effort_minutes(effort: Column) -> Column:
    """Minutes from '10min', '2h', '1.5d'; anything else is the MAJOR default."""
    text = F.lower(F.trim(effort))
    number = r"(\d+(?:\.\d+)?)"
    minutes = F.nullif(F.regexp_extract(text, r"(\d+)\s*min", 1), F.lit("")).try_cast("int")
    hours = F.nullif(F.regexp_extract(text, number + r"\s*h", 1), F.lit("")).cast("double")
    days = F.nullif(F.regexp_extract(text, number + r"\s*d", 1), F.lit("")).cast("double")
    return F.coalesce(minutes, F.floor(hours * 60).try_cast("int"), F.floor(days * 480).try_cast("int"),
                      F.lit(C.RULE_SEVERITY_MINUTES["MAJOR"]))


def roi_columns(total: Column) -> dict[str, Column]:
    amount = F.coalesce(total.cast("double"), F.lit(0.0))
    savings = cents(amount * 0.40)
    payback = F.when(savings == 0, F.lit(99)).otherwise(
        F.round((amount / savings.cast("double") * 12).cast("decimal(28,8)"), 0).cast("int"))
    roi = F.when(amount == 0, F.lit(0)).otherwise(
        F.round(((savings.cast("double") * 3 - amount) / amount * 100).cast("decimal(28,8)"), 0)
        .cast("int"))
    return {
        "total_fix_cost": cents(amount),
        "annual_maintenance_savings": savings,
        "payback_months": payback,
        "three_year_roi_pct": roi,
        "recommended_budget": cents(amount / 4),
        "recommendation": F.when(roi > 0, C.ROI_POSITIVE).otherwise(C.ROI_OTHER),
    }


def security_cost_columns(cwe: Column, cvss: Column, hours: Column, rate: Column,
                          breach_cost: Column, breach_probability: Column) -> dict[str, Column]:
    """Fix cost, plus the expected breach value for critical scores only."""
    fix = hours.cast("double") * rate.cast("double")
    factor = lookup(cwe, C.CWE_FACTORS, 1.0)
    expected = F.when(cvss >= 9.0, breach_probability * 0.5 * (breach_cost * factor) * 0.01
                      ).otherwise(F.lit(0.0))
    return {
        "fix_cost": cents(fix),
        "expected_breach_value": cents(expected),
        "breach_probability_pct": F.when(cvss >= 9.0, places(breach_probability * 0.5 * 100, 2))
        .otherwise(F.lit(0).cast("decimal(18,2)")),
        "breach_cost_used": F.when(cvss >= 9.0, cents(breach_cost * factor))
        .otherwise(F.lit(0).cast("decimal(18,2)")),
        "total_security_cost": cents(fix + expected),
    }
