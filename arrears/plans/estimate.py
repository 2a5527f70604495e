"""Full analysis of many repositories at once: from text, history and feeds to a priced scan."""

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.numeric import cents, places
from arrears.operators import (
    architecture, dependencies, facts as python, findings, history, reports, risk, security, smells, testgap,
)
from arrears.operators.common import stage
from arrears.operators.findings import FINDING_TIES, finding_order, module_order
from arrears.operators.items import COPIES, price_items, union_items
from arrears.operators.store import top_modules
from arrears.plans.profile import profile
from arrears.sources import scan_store


@dataclass
class Inputs:
    """What an estimate reads.

    ``settings`` has one row per repository: repo_id, base_rate, security_rate, documentation_rate,
    multiplier, benchmark. Without it the settings come from the profile of each repository: its stack
    and ``blended`` rates (technology, mid_rate, junior_rate), its team, and ``benchmark`` (one row:
    cost_per_function_usd). What neither gives takes the published defaults.
    """

    source_files: DataFrame
    commit_files: DataFrame
    rules: DataFrame
    settings: DataFrame | None = None
    scanner_results: DataFrame | None = None
    advisories: DataFrame | None = None
    as_of: str = "2026-01-01"
    blended: DataFrame | None = None
    benchmark: DataFrame | None = None
    data_sources: tuple[str, ...] = ()


@dataclass
class Estimate:
    """What an estimate found. The priced items of the rules are there; the rest is worked out, once, when it is asked for."""

    inputs: Inputs = field(repr=False)
    facts: DataFrame = field(repr=False)
    functions: DataFrame = field(repr=False)
    settings: DataFrame
    changes: DataFrame
    hotspots: DataFrame
    listed: DataFrame
    profile: DataFrame | None = None

    @cached_property
    def priced(self) -> DataFrame:
        """All priced items, those of advisories included: one per package and advisory, far more rows than either has."""
        given = self.inputs
        if given.advisories is None:
            return self.listed
        found = dependencies.vulnerabilities(given.source_files, given.advisories)
        return stage(self.listed.unionByName(_priced(found, self.settings)))

    @cached_property
    def counted(self) -> DataFrame:
        """The priced items, those of advisories counted by package and severity (column ``copies``): for sums."""
        given = self.inputs
        if given.advisories is None:
            return self.listed
        found = dependencies.counted_vulnerabilities(given.source_files, given.advisories)
        return stage(self.listed.withColumn(COPIES, F.lit(1).cast("long")).unionByName(_priced(found, self.settings)))

    @cached_property
    def counted_items(self) -> DataFrame:
        return findings.with_file_owners(self.counted, self.ownership)

    @cached_property
    def ownership(self) -> DataFrame:
        return stage(history.file_ownership(None, by_author=self.changes))

    @cached_property
    def items(self) -> DataFrame:
        return findings.with_file_owners(self.priced, self.ownership)

    @cached_property
    def findings(self) -> DataFrame:
        return stage(findings.normalize_findings(self.items))

    @cached_property
    def modules(self) -> DataFrame:
        return stage(findings.with_module_owners(
            findings.summarize_modules(self.findings), history.module_ownership(self.inputs.commit_files)))

    @cached_property
    def roadmap(self) -> DataFrame:
        return findings.roadmap(self.findings)

    @cached_property
    def base(self) -> DataFrame:
        """Settings, functions and rate of each repository."""
        counts = self.functions.groupBy("repo_id").agg(F.count("*").alias("functions"))
        return self.settings.join(counts, "repo_id", "left").fillna({"functions": 0}).withColumn("rate", F.col("base_rate"))

    @cached_property
    def categories(self) -> DataFrame:
        return with_baseline(findings.category_costs(self.counted), self.base)

    @cached_property
    def totals(self) -> DataFrame:
        return findings.repo_totals(self.counted, self.base)

    @cached_property
    def ownership_summary(self) -> DataFrame:
        return history.ownership_summary(self.inputs.commit_files, self.ownership, self.hotspots.select("repo_id", "path"), self.inputs.as_of)

    @cached_property
    def measured(self) -> DataFrame:
        """Files scanned and mean complexity of the functions of each repository."""
        files = self.facts.filter("kind = 'file'").groupBy("repo_id").agg(F.count("*").alias("files_scanned"))
        means = self.functions.groupBy("repo_id").agg(places(F.avg("complexity"), 2).alias("avg_complexity"))
        return files.join(means, "repo_id", "left").fillna({"avg_complexity": 0.0})


def _settings(repos: DataFrame, settings: DataFrame | None) -> DataFrame:
    defaults = {"base_rate": C.ROLE_RATES["mid"], "security_rate": C.ROLE_RATES["mid"],
                "documentation_rate": C.ROLE_RATES["junior"], "multiplier": C.DEFAULT_MULTIPLIER,
                "benchmark": C.FUNCTION_BENCHMARK}
    if settings is None:
        return repos.select("repo_id", *[F.lit(float(v)).alias(c) for c, v in defaults.items()])
    known = settings.select("repo_id", *[F.col(c).cast("double").alias(c) for c in defaults])
    return repos.join(known, "repo_id", "left").fillna(defaults)


def profile_settings(found: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """Settings of each repository from its profile and the benchmark of one function."""
    cost = F.lit(C.FUNCTION_BENCHMARK)
    if benchmark is not None:
        found = found.join(F.broadcast(benchmark.select("cost_per_function_usd").limit(1)), how="left")   # one row
        cost = F.coalesce("cost_per_function_usd", cost)
    return found.select("repo_id", F.col("code_quality_rate").alias("base_rate"), "security_rate", "documentation_rate",
                        F.col("combined_multiplier").alias("multiplier"), cost.alias("benchmark"))


def risky(functions: DataFrame, hotspots: DataFrame, minutes: DataFrame,
          suspects: DataFrame | None) -> DataFrame:
    """Risky files; repositories without any history use complexity in place of changes."""
    with_history = hotspots.select("repo_id").distinct()
    without = functions.join(with_history, "repo_id", "left_anti")
    spots = history.complexity_hotspots(without).select("repo_id", "path", "change_count")
    return risk.risky_files(
        functions.join(with_history, "repo_id", "left_semi"),
        hotspots.select("repo_id", "path", "change_count"), minutes, suspects=suspects
    ).unionByName(risk.risky_files(without, spots, minutes, used_fallback=True, suspects=suspects))


def architecture_items(parsed: DataFrame, source_files: DataFrame,
                       cycles: bool = True) -> DataFrame:
    modules = architecture.known_modules(source_files)
    edges = architecture.local_imports(architecture.import_rows(parsed), modules)
    items = union_items(architecture.oversized_modules(parsed), architecture.high_fanout(edges))
    if cycles:
        items = items.unionByName(
            architecture.cyclic_dependencies(architecture.import_cycles(edges)))
    return items


def collect_items(inputs: Inputs, parsed: DataFrame, hotspots: DataFrame, functions: DataFrame,
                  settings: DataFrame, cycles: bool = True) -> DataFrame:
    """Priced items of all rules but the advisories', in step order."""
    suspects = smells.generated_code(inputs.commit_files, parsed)
    minutes = risk.minutes_by_complexity(inputs.rules)
    risky_items = stage(risky(functions, hotspots, minutes, suspects))
    spots = risky_items.select("repo_id", F.col("file").alias("path"))
    parts = [
        risky_items, architecture_items(parsed, inputs.source_files, cycles),
        smells.duplicate_logic(parsed), smells.reliability_smells(parsed),
        smells.performance_smells(parsed), smells.dead_code(parsed),
        smells.missing_docstrings(parsed), testgap.test_gaps(inputs.source_files, spots),
        dependencies.dependency_hygiene(inputs.source_files),
    ]
    if inputs.scanner_results is not None:
        rated = inputs.scanner_results.join(
            settings.select("repo_id", "security_rate"), "repo_id", "left")
        parts.append(security.security_items(rated, F.col("security_rate")))
    return _priced(union_items(*parts), settings)


def _priced(items: DataFrame, settings: DataFrame) -> DataFrame:
    items = items.join(
        settings.select("repo_id", "base_rate", "documentation_rate"), "repo_id", "left")
    return price_items(items, F.col("base_rate"),
                       documentation_rate=F.col("documentation_rate")).drop(
        "base_rate", "documentation_rate")


def estimate(inputs: Inputs, cycles: bool = True) -> Estimate:
    """Priced items of every repository, and from them findings, modules, roadmap, category costs and totals.

    Results that several later steps read are written on the way: the parsed facts, changes by file and author, the
    hotspots, the risky files and the priced items; of what follows, ownership, findings and modules. The rest stays lazy.
    """
    parsed = python.staged_facts(inputs.source_files)
    functions = smells.measured_functions(parsed)
    changes = stage(history.author_changes(inputs.commit_files))
    hotspots = stage(history.hotspots(None, by_author=changes))
    repos = (inputs.source_files.select("repo_id").distinct())
    found = None
    if inputs.settings is None and inputs.blended is not None:
        found = stage(profile(inputs.source_files, inputs.commit_files, parsed, inputs.blended, inputs.as_of))
    settings = stage(_settings(repos, inputs.settings if found is None else profile_settings(found, inputs.benchmark)))
    items = stage(collect_items(inputs, parsed, hotspots, functions, settings, cycles))
    return Estimate(inputs=inputs, facts=parsed, functions=functions, settings=settings, changes=changes, hotspots=hotspots,
                    listed=items, profile=found)


def with_baseline(categories: DataFrame, repos: DataFrame) -> DataFrame:
    """Add the baseline upkeep of all functions to code quality; no other category carries it."""
    hours = F.col("functions").cast("double") * (C.BASELINE_MINUTES / 60)
    cost = findings.baseline_cost(F.col("functions"), F.col("rate")).cast("double")
    base = repos.select("repo_id", (hours * F.col("multiplier")).alias("_hours"),
                        (cost * F.col("multiplier")).alias("_cost"))
    joined = categories.join(base, "repo_id", "left")
    applies = F.col("category") == "code_quality"

    def plus(column, extra):
        extra = F.when(applies, F.coalesce(extra, F.lit(0.0))).otherwise(F.lit(0.0))
        return F.col(column).cast("double") + extra

    return joined.withColumn("cost_usd", cents(plus("cost_usd", F.col("_cost")))
                             ).withColumn("hours", places(plus("hours", F.col("_hours")), 2)
                                          ).drop("_hours", "_cost")


STACK = ("primary_language", "frameworks", "databases", "cloud", "infra", "ai_ml", "testing", "has_tests", "has_ci_cd", "dependency_count", "uses_ai")
TEAM = {"estimated_team_size": "team_size", "bus_factor": "bus_factor", "repo_age_days": "repo_age_days", "commits_per_week": "commits_per_week"}


def _document(repos: DataFrame, part: DataFrame | None, name: str, fields: dict[str, str]) -> DataFrame:
    """One object of the stored document: the named columns that a table has, null where it has no row."""
    if part is None:
        return repos
    known = [F.col(column).alias(key) for key, column in fields.items() if column in part.columns]
    return repos.join(part.select("repo_id", F.struct(*known).alias(name)), "repo_id", "left") if known else repos


def _listed(rows: DataFrame, order: str, names: list[str]) -> DataFrame:
    """Short lists of rows - their number is a fixed one - as arrays."""
    return rows.groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, *[n for n in names if n != order]))),
                                                   lambda r: F.struct(*[r[n].alias(n) for n in names])).alias("listed"))


def payloads(result: Estimate) -> DataFrame:
    """The stored document of each repository (repo_id, payload): its figures, ownership, profile, rates, actions, return
    and summary, as readers of the store expect them. Lists that grow with the repository are tables of their own."""
    order = finding_order(*FINDING_TIES)
    keyed = result.findings.withColumn("finding_key", F.col("id"))
    triage = reports.triage_rows(keyed, ["repo_id"], order)
    actions = _listed(reports.priority_actions(keyed, triage, ["repo_id"], order), "rank", [
        "rank", "title", "file_or_module", "why", "estimated_hours", "estimated_cost", "saves_per_month", "sprint"])
    reviews = reports.architecture_reviews(result.totals, result.modules, keyed, ["repo_id"], module_order())
    lead = top_modules(result.modules, ["repo_id"], 1)
    texts = reports.executive_summaries(result.totals, lead, reviews, ["repo_id"])
    costs = result.categories.groupBy("repo_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "category", F.struct(F.col("cost_usd").cast("double").alias("cost_usd"), F.col("hours").cast("double").alias("hours"),
                             F.col("item_count")))))).alias("cost_by_category"))   # at most one entry per category
    named = result.inputs.data_sources
    sources = F.array(*[F.lit(s) for s in named]).cast("array<string>")
    repos = reports.with_roi(result.totals).join(costs, "repo_id", "left").join(texts, "repo_id", "left").join(
        actions.withColumnRenamed("listed", "priority_actions"), "repo_id", "left")
    repos = repos.join(result.settings.select("repo_id", "base_rate", F.col("multiplier").alias("combined_multiplier")), "repo_id", "left").join(
        result.measured, "repo_id", "left")
    owners = result.ownership_summary
    repos = _document(repos, owners, "ownership_summary", {c: c for c in owners.columns if c != "repo_id"})
    for name, fields in (("tech_stack", {c: c for c in STACK}), ("team", TEAM), ("multipliers", {"combined_multiplier": "combined_multiplier"})):
        repos = _document(repos, result.profile, name, fields)

    def has(*names):
        return [n for n in names if n in repos.columns]

    def object_of(*names):
        return F.struct(*[F.col(n) for n in has(*names)])

    rates = F.struct(cents(F.col("base_rate")).cast("double").alias("blended_rate"), F.lit("medium").alias("confidence"),
                     F.array(*[F.lit(s) for s in named or ("BLS fallback",)]).alias("sources_used"))
    analysis = F.struct(
        F.col("total_cost_usd").cast("double").alias("total_cost_usd"), F.col("debt_score").cast("double").alias("debt_score"),
        F.col("total_hours").cast("double").alias("total_remediation_hours"), F.col("total_sprints").cast("double").alias("total_remediation_sprints"),
        "cost_by_category", F.struct(*[F.col(c).cast("string").alias(c) for c in has("cost_per_function", "industry_avg", "variance_pct", "is_reasonable", "assessment")]).alias("sanity_check"),
        rates.alias("hourly_rates"), sources.alias("data_sources_used"),
        object_of("files_scanned", "functions_analyzed", "issues_found", "avg_complexity").alias("summary"),
        *has("ownership_summary", "combined_multiplier"), *([object_of("tech_stack", "team", "multipliers").alias("repo_profile")] if has("tech_stack") else []))
    roi = object_of("total_fix_cost", "annual_maintenance_savings", "payback_months", "three_year_roi_pct", "recommended_budget", "recommendation")
    return repos.select("repo_id", F.to_json(F.struct(
        "executive_summary", "priority_actions", roi.alias("roi_analysis"), analysis.alias("raw_analysis"))).alias("payload"))


def save(result: Estimate, root: str, batch_id: str, created_at, user_id: str | None = None,
         repositories: DataFrame | None = None) -> None:
    """Write an estimate to the scan store as one complete scan per repository.

    Scan ids follow from repository and batch, so a repeated save replaces the same rows.
    ``repositories`` (repo_id, github_url) adds addresses to the stored ones.
    """
    scan_id = F.substring(F.sha1(F.concat_ws("|", "repo_id", F.lit(batch_id))), 1, 12)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("scan_id", scan_id)

    totals = result.totals
    if result.profile is not None:
        totals = totals.join(result.profile.select(
            "repo_id", F.col("team_size").cast("int"), F.col("bus_factor").cast("int"), F.col("repo_age_days").cast("int"),
            "combined_multiplier", "primary_language", F.col("code_quality_rate").alias("hourly_rate")), "repo_id", "left")
    scans = keyed(totals.join(payloads(result), "repo_id", "left")).withColumns({
        "job_id": F.lit(batch_id), "user_id": F.lit(user_id), "created_at": F.lit(created_at).cast("timestamp"),
        "status": F.lit("complete")})
    found = keyed(result.findings).withColumn("finding_key", F.col("id"))
    seen = None
    if repositories is not None:
        seen = repositories.withColumns({"repo_name": F.element_at(F.split("github_url", "/"), -1),
                                         "last_scanned_at": F.lit(created_at).cast("timestamp"), "user_id": F.lit(user_id)})
    scan_store.save_scan(root, batch_id, scans, keyed(result.items), found, keyed(result.modules),
                         keyed(result.roadmap), seen)
