"""Report, message and ticket rows of scans; deterministic narrative texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths, text
from arrears.functions.numeric import cents, lookup, places
from arrears.functions.scoring import roi_columns, severity_rank
from arrears.operators.common import top_per_group


def with_roi(scans: DataFrame) -> DataFrame:
    return scans.withColumns(roi_columns(F.col("total_cost_usd")))


def roi_projection(scans: DataFrame, months: int = 12) -> DataFrame:
    """Cumulative savings for each of the next months beside the fix cost."""
    annual = F.col("annual_maintenance_savings").cast("double")
    return with_roi(scans).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months)))).select(
        "scan_id", "month", places(annual / 12 * F.col("month"), 0).alias("savings"),
        F.col("total_fix_cost").alias("fix_cost"))


def payback_months(cost: Column, saves: Column) -> Column:
    """Whole months until savings cover the cost, null (shown as N/A) without savings."""
    return F.when(saves > 0, F.ceil(cost.cast("double") / saves.cast("double")))


def action_hint(category: Column) -> Column:
    return lookup(category, C.ACTION_HINTS, C.DEFAULT_ACTION_HINT)


def triage_rows(findings: DataFrame, keys: list[str], order: list[Column],
                limit: int = 5) -> DataFrame:
    """Deterministic triage of the leading findings."""
    top = top_per_group(findings, keys, order, limit)
    category = F.coalesce("category", F.lit("unknown"))
    return top.select(
        *keys, "position", F.col("finding_key").alias("finding_id"), category.alias("debt_type"),
        F.lit(False).alias("justified"),
        F.when(category == "architecture", "module").otherwise("file").alias("remediation_scope"),
        action_hint(F.coalesce("category", F.lit("code_quality"))).alias("action_hint"),
        F.lit(C.TRIAGE_NOTE).alias("confidence_note"))


def priority_actions(findings: DataFrame, triage: DataFrame, keys: list[str],
                     order: list[Column], limit: int = 3) -> DataFrame:
    """Leading findings as actions; the reason comes from their triage row when there is one."""
    top = top_per_group(findings, keys, order, limit)
    hints = triage.groupBy(*keys, F.col("finding_id").alias("finding_key")).agg(
        F.max_by("action_hint", "position").alias("action_hint"))
    where = F.coalesce(F.nullif("module", F.lit("")), F.col("file_path"))
    cost = F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0))
    return top.join(hints, [*keys, "finding_key"], "left").select(
        *keys, F.col("position").alias("rank"),
        F.concat(F.lit("Remediate "), F.replace(F.coalesce("category", F.lit("debt")), F.lit("_"),
                                                F.lit(" ")), F.lit(" in "), where).alias("title"),
        where.alias("file_or_module"),
        F.coalesce("action_hint", F.lit(C.DEFAULT_WHY)).alias("why"),
        places(F.coalesce(F.col("effort_hours").cast("double"), F.lit(0.0)), 1)
        .alias("estimated_hours"),
        cents(cost).alias("estimated_cost"), cents(cost * 0.015).alias("saves_per_month"),
        F.concat(F.lit("Sprint "), F.col("position")).alias("sprint"))


def _first_of(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    return top_per_group(df, keys, order, 1).select(*keys, column)


def architecture_reviews(scans: DataFrame, modules: DataFrame, findings: DataFrame,
                         keys: list[str], order: list[Column]) -> DataFrame:
    """Structural summary naming the top module; empty text without findings and modules."""
    lead = _first_of(modules, keys, order, "module")
    structural = findings.filter("category = 'architecture'").groupBy(*keys).agg(
        F.lit(True).alias("structural"))
    joined = scans.select(*keys).join(lead, keys, "left").join(structural, keys, "left")
    any_input = F.col("module").isNotNull() | F.coalesce("structural", F.lit(False))
    before, after = C.ARCHITECTURE_SUMMARY.split("%s")
    return joined.select(
        *keys, F.when(any_input, F.concat(F.lit(before), F.coalesce("module", F.lit("core module")),
                                          F.lit(after))).otherwise("").alias("summary"),
        F.when(any_input, C.ARCHITECTURE_BOUNDARY).otherwise("").alias("recommended_boundary"))


def test_gap_reviews(scans: DataFrame, findings: DataFrame, keys: list[str],
                     order: list[Column]) -> DataFrame:
    lead = _first_of(findings.filter("category = 'test_debt'"), keys, order, "file_path")
    before, after = C.TEST_GAP_SUMMARY.split("%s")
    focus = F.col("file_path")
    return scans.select(*keys).join(lead, keys, "left").select(
        *keys, F.coalesce(F.concat(F.lit(before), focus, F.lit(after)), F.lit("")).alias("summary"),
        F.coalesce(focus, F.lit("")).alias("focus_area"),
        F.when(focus.isNotNull(), C.TEST_GAP_STYLE).otherwise("").alias("suggested_test_style"))


test_gap_reviews.__test__ = False  # not a test case


def executive_summaries(scans: DataFrame, lead_modules: DataFrame, reviews: DataFrame,
                        keys: list[str]) -> DataFrame:
    """Summary text with cost, score, hours and the module with most risk."""
    note = reviews.select(*keys, F.col("summary").alias("note"))
    joined = scans.join(lead_modules.select(*keys, "module"), keys, "left").join(note, keys, "left")
    closing = F.when(F.coalesce("note", F.lit("")) != "", F.col("note")).otherwise(C.SUMMARY_CLOSING)
    zero = F.lit(0)
    summary = F.concat(
        F.lit("The repository carries about "),
        text.money_text(F.coalesce("total_cost_usd", zero)),
        F.lit(" in estimated technical debt with a debt score of "),
        text.fixed_text(F.coalesce("debt_score", zero), 1), F.lit("/10 and roughly "),
        text.fixed_text(F.coalesce("total_hours", zero), 0),
        F.lit(" remediation hours. The highest concentration of risk is in "),
        F.coalesce("module", F.lit("the core module")), F.lit(". "), closing)
    return joined.select(*keys, summary.alias("executive_summary"))


def metric_rows(scans: DataFrame) -> DataFrame:
    """Key figures of a scan as (metric, value, source) rows."""
    col = F.col
    age = F.coalesce("repo_age_days", F.lit(0))
    sign = F.when(col("variance_pct") >= 0, "+").otherwise("")

    def row(name, value, source):
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), source.alias("source"))

    rows = F.array(
        row("Hourly Rate Used", F.concat(F.lit("$"), text.fixed_text(F.coalesce(
            "hourly_rate", F.lit(C.ROLE_RATES["mid"])), 2), F.lit("/hr")),
            F.concat(F.lit("Confidence: "), F.coalesce("rate_confidence", F.lit("N/A")))),
        row("Cost per Function", text.money_text(F.coalesce("cost_per_function", F.lit(0))),
            F.lit("Industry avg: $1,083/fn")),
        row("Variance vs Industry", F.concat(sign, text.fixed_text(col("variance_pct"), 1),
                                             F.lit("%")), F.coalesce("assessment", F.lit(""))),
        row("Combined Multiplier", F.concat(text.fixed_text(F.coalesce(
            "combined_multiplier", F.lit(1)), 2), F.lit("x")), F.lit("Bus factor x age x team")),
        row("Team Size", F.coalesce(col("team_size").cast("string"), F.lit("?")),
            F.lit("From git history")),
        row("Bus Factor", F.coalesce(col("bus_factor").cast("string"), F.lit("?")),
            F.lit("1 = high risk")),
        row("Repo Age", F.concat(F.floor(age / 365), F.lit(" years")),
            F.concat(age, F.lit(" days"))))
    return scans.select("scan_id", F.posexplode(rows).alias("position", "r")).select(
        "scan_id", "position", "r.metric", "r.value", "r.source")


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Repository profile as label and value pairs."""
    def listed(name, empty):
        joined = F.array_join(F.coalesce(name, F.array().cast("array<string>")), ", ")
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))

    def yes(name):
        return F.when(F.coalesce(name, F.lit(False)), "Yes").otherwise("No")

    pairs = {
        "Primary Language": F.coalesce("primary_language", F.lit("Unknown")),
        "Has Tests": yes("has_tests"), "Frameworks": listed("frameworks", "N/A"),
        "Has CI/CD": yes("has_ci_cd"), "Databases": listed("databases", "None"),
        "AI Libraries": listed("ai_ml", "None"),
        "Team Size": F.concat(F.lit("~"), F.coalesce(F.col("team_size").cast("string"), F.lit("?")),
                              F.lit(" engineers")),
        "Bus Factor": F.coalesce(F.col("bus_factor").cast("string"), F.lit("?")),
        "Repo Age": F.concat(F.floor(F.coalesce("repo_age_days", F.lit(0)) / 365),
                             F.lit(" years")),
        "Combined Multiplier": F.concat(text.fixed_text(F.coalesce(
            "combined_multiplier", F.lit(1)), 2), F.lit("x")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value"))
                     for k, v in pairs.items()])
    return profiles.select("repo_id", F.posexplode(rows).alias("position", "r")).select(
        "repo_id", "position", "r.label", "r.value")


def top_items(items: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """Most expensive items with the short forms shown in a report."""
    top = top_per_group(items, keys, [F.col("cost_usd").desc(), F.col("seq")], limit)
    shown = F.when(F.coalesce("file", F.lit("")) == "", "unknown").otherwise(
        paths.truncate(paths.clean_path(F.col("file")), 45, 45))
    minutes = F.coalesce(F.col("adjusted_minutes").cast("double"), F.lit(0.0))
    return top.select(
        *keys, "position", shown.alias("file"), paths.title_label(F.col("category")).alias("category"),
        F.upper(F.substring(F.lower(F.coalesce("severity", F.lit("low"))), 1, 3)).alias("severity"),
        text.money_text(F.col("cost_usd")).alias("cost"),
        F.concat(text.fixed_text(minutes / 60, 1), F.lit("h")).alias("hours"))


def tickets(items: DataFrame, keys: list[str], min_severity: str = "medium",
            limit: int = 10) -> DataFrame:
    """Ticket rows of the most expensive items at or above a severity.

    An unknown severity ranks below low and is left out.
    """
    floor = C.SEVERITY_RANK[min_severity]
    rank = severity_rank(F.coalesce("severity", F.lit("low")))
    top = top_per_group(items.filter(rank >= floor), keys,
                        [F.col("cost_usd").desc(), F.col("seq")], limit)
    col = F.col
    file = paths.clean_path(F.coalesce("file", F.lit("unknown")))
    category = paths.title_label(F.coalesce("category", F.lit("code_quality")))
    severity = F.lower(F.coalesce("severity", F.lit("medium")))
    function = F.coalesce("function", F.lit(""))
    hours = F.coalesce(col("adjusted_minutes").cast("double"), F.lit(0.0)) / 60
    summary = F.concat(F.lit("["), category, F.lit("] "), file,
                       F.when(function != "", F.concat(F.lit(" — "), function)).otherwise(""))
    description = F.concat(
        F.lit("*File:* +"), file, F.lit("+\n*Function:* "),
        F.when(function != "", function).otherwise("N/A"), F.lit("\n*Category:* "), category,
        F.lit("\n*Severity:* "), F.upper(severity), F.lit("\n\n*Estimated Cost:* "),
        text.money_text(col("cost_usd")), F.lit("\n*Remediation Hours:* "),
        text.fixed_text(hours, 1), F.lit("h\n*Complexity Score:* "),
        F.coalesce(col("complexity").cast("string"), F.lit("N/A")))
    return top.select(
        *keys, "position", paths.truncate(summary, 255, 252).alias("summary"),
        description.alias("description"), lookup(severity, C.TICKET_PRIORITY, "Medium")
        .alias("priority"),
        F.concat_ws(",", lookup(F.coalesce("category", F.lit("code_quality")), C.TICKET_LABEL,
                                "tech-debt"), F.lit("tech-debt"), F.lit("automated"))
        .alias("labels"))


def epics(scans: DataFrame) -> DataFrame:
    """One grouping ticket per scan."""
    name = F.substring_index("github_url", "/", -1)
    score = text.fixed_text(F.col("debt_score"), 1)
    return scans.select("scan_id", F.concat(
        F.lit("[Tech Debt] "), name, F.lit(" — "), text.money_text(F.col("total_cost_usd")),
        F.lit(" total debt (score: "), score, F.lit("/10)")).alias("summary"))


def messages(scans: DataFrame, categories: DataFrame, actions: DataFrame) -> DataFrame:
    """Chat message of each scan: headline, top three categories and actions, return, summary."""
    col = F.col
    top = top_per_group(categories, ["scan_id"], [col("cost_usd").desc(), col("category")], 3)
    line = F.struct("position", F.concat(
        F.lit("  -  "), paths.title_label(col("category")), F.lit(": *"),
        text.money_text(col("cost_usd")), F.lit("*")).alias("line"))
    # At most three lines per scan reach these lists.
    category_lines = top.groupBy("scan_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("categories"))
    step = F.struct("rank", F.concat(
        F.lit("  "), col("rank"), F.lit(". *"), col("title"), F.lit("* — "),
        text.money_text(col("estimated_cost")), F.lit(" ("), col("estimated_hours"), F.lit("h)"))
        .alias("line"))
    action_lines = actions.filter("rank <= 3").groupBy("scan_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(step)), lambda x: x["line"]), "\n").alias("actions"))
    score = col("debt_score")
    roi = F.when(col("annual_maintenance_savings") > 0, F.concat(
        F.lit("*ROI:* Fix costs "), text.money_text(col("total_fix_cost")), F.lit(" → saves "),
        text.money_text(col("annual_maintenance_savings")), F.lit("/yr -  Payback in "),
        col("payback_months"), F.lit(" months"))).otherwise("")
    joined = with_roi(scans).join(category_lines, "scan_id", "left").join(
        action_lines, "scan_id", "left")
    return joined.select(
        "scan_id", F.when(score <= 3, "🟢").when(score <= 6, "🟡").otherwise("🔴").alias("emoji"),
        F.substring_index("github_url", "/", -1).alias("repo_name"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.coalesce("actions", F.lit("")).alias("actions"), roi.alias("roi"),
        paths.truncate(F.coalesce("executive_summary", F.lit("")), 300, 297).alias("summary"),
        F.concat(F.lit("Tech Debt Report: "), col("github_url"), F.lit(" | Score: "),
                 text.fixed_text(score, 1), F.lit("/10 | Total Cost: "),
                 text.money_text(col("total_cost_usd"))).alias("fallback_text"))
