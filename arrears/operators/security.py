"""Static security scanner results: noise filter and pricing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import lookup
from arrears.functions.paths import normalize_repo_path
from arrears.functions.scoring import business_impact, confidence, security_cost_columns
from arrears.operators.items import debt_items


def significant_results(results: DataFrame) -> DataFrame:
    """High severity, or medium severity with at least medium confidence."""
    severity, trust = F.col("issue_severity"), F.col("issue_confidence")
    return results.filter((severity == "HIGH")
                          | ((severity == "MEDIUM") & trust.isin("MEDIUM", "HIGH")))


def security_items(results: DataFrame, rate=C.ROLE_RATES["mid"],
                   breach_cost: float = C.BREACH_COST,
                   breach_probability: float = C.BREACH_PROBABILITY) -> DataFrame:
    """Priced scanner findings; ``rate`` is a number or a column of the results."""
    kept = significant_results(results)
    severity = F.lower("issue_severity")
    hours = lookup(F.col("issue_severity"), C.SCAN_HOURS, C.SCAN_HOURS["LOW"])
    cvss = F.when(F.col("issue_severity") == "HIGH", 7.0).otherwise(5.0)
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    cwe = F.col("cwe_id") if "cwe_id" in results.columns else F.lit("CWE-UNKNOWN")
    cost = security_cost_columns(cwe, cvss, hours, rate, F.lit(breach_cost),
                                 F.lit(breach_probability))["total_security_cost"]
    return debt_items(
        kept, "security", category="security", severity=severity, kind="security_hotspot",
        hours=hours, impact=business_impact(severity), trust=confidence("security_scan"),
        file=normalize_repo_path(F.col("filename")), line=F.col("line_number"),
        issue_text=F.col("issue_text"), detail=F.col("test_id"), fixed_cost=cost)
