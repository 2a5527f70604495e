"""Findings, module summaries and the remediation roadmap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import cents, places
from arrears.functions.paths import module_of, title_label
from arrears.functions.scoring import (
    debt_score, price, sanity_columns, severity_name, severity_rank,
)
from arrears.functions.text import percent_text
from arrears.operators.common import sum_cents, top_per_group
from arrears.operators.items import copies

OWNER_COLUMNS = ("owner_count", "top_contributor_share", "ownership_risk")


def finding_id(file: Column, category: Column, kind: Column, function: Column,
               line: Column) -> Column:
    """Stable 12-digit id; absent parts are empty text."""
    parts = [F.coalesce(part.cast("string"), F.lit(""))
             for part in (file, category, kind, function, line)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def source_tool(category: Column, used_fallback: Column) -> Column:
    return (F.when(category == "security", "bandit").when(category == "dependency", "osv")
            .when(category == "documentation", "ast")
            .when(F.coalesce(used_fallback, F.lit(False)), "complexity_fallback")
            .otherwise("git+static"))


def evidence() -> Column:
    """Up to six evidence records of an item with owner columns, in fixed order."""
    def record(present: Column, source: str, summary: Column) -> Column:
        return F.when(present, F.struct(F.lit(source).alias("source"), summary.alias("summary")))

    col = F.col
    share = F.coalesce(col("top_contributor_share").cast("double"), F.lit(0.0))
    records = F.array(
        record(col("complexity").isNotNull(), "complexity",
               F.concat(F.lit("Complexity score "), col("complexity"))),
        record(col("change_count").isNotNull(), "git_history",
               F.concat(F.lit("Changed "), col("change_count"),
                        F.lit(" times in sampled history"))),
        record(col("issue_text") != "", "security_scan", F.substring("issue_text", 1, 160)),
        record(col("doc_type") != "", "documentation",
               F.concat(F.lit("Missing documentation type: "), col("doc_type"))),
        record(col("package") != "", "dependency",
               F.concat(F.lit("Package "), col("package"), F.lit(" requires attention"))),
        record(col("owner_count").isNotNull(), "ownership",
               F.concat(col("owner_count"), F.lit(" contributors, top contributor share "),
                        percent_text(share))))
    kept = F.filter(records, lambda r: r.isNotNull())
    default = F.array(F.struct(
        F.lit("analysis").alias("source"),
        F.concat(col("category"), F.lit(" finding from analysis pipeline")).alias("summary")))
    return F.when(F.size(kept) > 0, kept).otherwise(default)


def with_file_owners(items: DataFrame, ownership: DataFrame) -> DataFrame:
    """Attach the ownership of each item's file."""
    owners = ownership.select("repo_id", F.col("path").alias("file"), *OWNER_COLUMNS)
    return items.join(owners, ["repo_id", "file"], "left")


def normalize_findings(items: DataFrame) -> DataFrame:
    """Priced items (with owner columns) as findings."""
    col = F.col
    return items.select(
        "repo_id",
        finding_id(col("file"), col("category"), col("type"), col("function"), col("line"))
        .alias("id"),
        F.coalesce("file", F.lit("unknown")).alias("file_path"),
        module_of(F.coalesce("file", F.lit("unknown"))).alias("module"),
        F.coalesce("category", F.lit("code_quality")).alias("category"),
        col("type").alias("subcategory"), col("function").alias("symbol_name"),
        col("line").alias("line_start"), col("line").alias("line_end"),
        F.lower(F.coalesce("severity", F.lit("low"))).alias("severity"),
        F.coalesce("business_impact", F.lit("medium")).alias("business_impact"),
        places(F.coalesce("remediation_hours", F.lit(0)), 2).alias("effort_hours"),
        F.coalesce("cost_usd", F.lit(0)).cast("decimal(18,2)").alias("cost_usd"),
        F.coalesce("confidence", F.lit(0.5)).cast("decimal(18,2)").alias("confidence"),
        source_tool(col("category"), col("used_fallback")).alias("source_tool"),
        evidence().alias("evidence"), F.lit("open").alias("status"),
        *[col(name) for name in OWNER_COLUMNS], "step")


def finding_order(*ties: str) -> list[Column]:
    """Severity, cost and confidence descending; ``ties`` make the order total."""
    return [severity_rank(F.col("severity")).desc(), F.col("cost_usd").desc(),
            F.col("confidence").desc(), *[F.col(name) for name in ties]]


FINDING_TIES = ("step", "file_path", "line_start", "symbol_name", "subcategory", "id")


def summarize_modules(findings: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    total = F.count("*")
    return findings.groupBy(*keys, "module").agg(
        total.alias("finding_count"), sum_cents("cost_usd", "total_cost_usd"),
        sum_cents("effort_hours", "total_effort_hours"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("max_severity"),
        places(F.sum("confidence").cast("double") / total, 2).alias("avg_confidence"))


def with_module_owners(modules: DataFrame, ownership: DataFrame) -> DataFrame:
    return modules.join(ownership.select("repo_id", "module", *OWNER_COLUMNS),
                        ["repo_id", "module"], "left")


def module_order() -> list[Column]:
    return [severity_rank(F.col("max_severity")).desc(), F.col("total_cost_usd").desc(),
            F.col("module")]


def roadmap_bucket() -> Column:
    rank = severity_rank(F.col("severity"))
    hours = F.col("effort_hours")
    return (F.when((hours <= 4) & (F.col("confidence") >= 0.6) & (rank >= 2), "quick_wins")
            .when((hours >= 8) | (rank >= 4), "strategic").otherwise("next_up"))


def roadmap(findings: DataFrame, keys: tuple[str, ...] = ("repo_id",), *,
            limit: int | None = None, ties: tuple[str, ...] = FINDING_TIES) -> DataFrame:
    """Findings of each bucket in finding order, with their position; all, or the first ``limit``."""
    title = F.concat(title_label(F.col("category")), F.lit(" in "), F.col("file_path"))
    bucketed = findings.withColumn("bucket", roadmap_bucket())
    top = top_per_group(bucketed, [*keys, "bucket"], finding_order(*ties), limit)
    return top.select(*keys, "bucket", "position", F.col("id").alias("finding_id"),
                      title.alias("title"), "file_path", "module", "severity", "business_impact",
                      "effort_hours", "cost_usd", "confidence")


def category_costs(items: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Cost, hours and items per category; the six fixed categories always appear.

    The empty categories are added to the aggregated rows, so the items are read once.
    """
    times = copies(items)
    totals = items.groupBy(*keys, "category").agg(
        F.coalesce(F.sum(F.col("cost_usd") * times), F.lit(0)).cast("decimal(28,2)").alias("cost_usd"),
        F.sum(F.col("remediation_hours") * times).cast("decimal(28,6)").alias("hours"),
        F.sum(times).alias("item_count"))
    empty = totals.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(name) for name in C.CATEGORIES])).alias("category"),
        F.lit(0).cast("decimal(28,2)").alias("cost_usd"), F.lit(0).cast("decimal(28,6)").alias("hours"),
        F.lit(0).cast("long").alias("item_count"))
    return totals.unionByName(empty).groupBy(*keys, "category").agg(
        sum_cents("cost_usd"), places(F.sum("hours"), 2).alias("hours"),
        F.sum("item_count").alias("item_count"))


def category_report(categories: DataFrame, totals: DataFrame,
                    keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Share of each category in the stated total and in the sum of shown categories."""
    shown = categories.groupBy(*keys).agg(F.sum("cost_usd").alias("shown_total"))
    joined = categories.join(shown, list(keys)).join(
        totals.select(*keys, "total_cost_usd"), list(keys), "left")

    def share(whole):
        return F.when(F.col(whole) != 0, places(
            F.col("cost_usd").cast("double") / F.col(whole).cast("double") * 100, 1)
        ).otherwise(F.lit(0).cast("decimal(18,1)"))

    return (joined.withColumn("label", title_label(F.col("category")))
            .withColumn("pct_of_total", share("total_cost_usd"))
            .withColumn("pct_of_shown", share("shown_total"))
            .drop("shown_total", "total_cost_usd"))


def baseline_cost(functions: Column, rate: Column) -> Column:
    hours = functions.cast("double") * (C.BASELINE_MINUTES / 60)
    return price(hours, rate, F.lit("low"), F.lit(C.BASELINE_CONFIDENCE))


def repo_totals(items: DataFrame, repos: DataFrame) -> DataFrame:
    """Total cost, hours, sprints and score per repository.

    ``repos`` has one row per repository: repo_id, functions, rate, multiplier, benchmark.
    """
    times = copies(items)
    sums = items.groupBy("repo_id").agg(
        F.sum(F.col("cost_usd") * times).alias("item_cost"), F.sum(F.col("remediation_hours") * times).alias("item_hours"),
        F.sum(times).alias("issues_found"))
    col = F.col
    joined = repos.join(sums, "repo_id", "left").fillna({"issues_found": 0})
    base = baseline_cost(col("functions"), col("rate"))
    base_hours = col("functions").cast("double") * (C.BASELINE_MINUTES / 60)
    multiplier = F.coalesce(col("multiplier").cast("double"), F.lit(C.DEFAULT_MULTIPLIER))
    item_cost = F.coalesce(col("item_cost"), F.lit(0)).cast("double")
    item_hours = F.coalesce(col("item_hours"), F.lit(0)).cast("double")
    joined = joined.withColumn("baseline_cost", base).withColumn(
        "_cost", (item_cost + base.cast("double")) * multiplier).withColumn(
        "_hours", item_hours + base_hours * multiplier)
    sanity = sanity_columns(col("_cost"), col("functions"), col("benchmark"))
    return joined.select(
        "repo_id", col("functions").alias("functions_analyzed"), "issues_found", "baseline_cost",
        cents(col("_cost")).alias("total_cost_usd"),
        cents(col("_hours")).alias("total_hours"),
        cents(col("_hours") / C.HOURS_PER_SPRINT).alias("total_sprints"),
        debt_score(col("_cost"), col("functions"), col("benchmark")).alias("debt_score"),
        *[value.alias(name) for name, value in sanity.items()])
