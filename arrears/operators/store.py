"""Questions over stored scans: latest, history, triage, comparison, trends, portfolio."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths
from arrears.functions.numeric import percent, places
from arrears.functions.scoring import risk_level, severity_rank
from arrears.operators.common import keep_last, spread, sum_cents, top_per_group
from arrears.operators.findings import finding_order, module_order


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("scan_id").desc()]


def complete(scans: DataFrame, user_id=None) -> DataFrame:
    kept = scans.filter("status = 'complete'")
    return kept if user_id is None else kept.filter(F.col("user_id") == user_id)


def history(scans: DataFrame, limit: int, user_id=None, key: str = "repo_id") -> DataFrame:
    """Newest ``limit`` complete scans of every repository; position 1 is the latest."""
    return top_per_group(complete(scans, user_id), [key], newest_first(), limit)


def latest_scans(scans: DataFrame, user_id=None, key: str = "repo_id") -> DataFrame:
    return history(scans, 1, user_id, key).drop("position")


def scan_pairs(scans: DataFrame, user_id=None) -> DataFrame:
    """Latest and previous scan of every repository with their headline figures."""
    recent = history(scans, 2, user_id)
    figures = ("scan_id", "total_cost_usd", "debt_score", "total_hours")

    def at(position, name):
        return F.max(F.when(F.col("position") == position, F.col(name)))

    return recent.groupBy("repo_id").agg(
        *[at(1, name).alias(f"latest_{name}") for name in figures],
        *[at(2, name).alias(f"previous_{name}") for name in figures])


def of_scans(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Rows of the given scans only; applied before any aggregation, so old scans are never rolled up."""
    return rows.join(scans.select("scan_id").distinct(), "scan_id", "left_semi")


# --- triage ---------------------------------------------------------------------------------------

FINDING_KEY = ["scan_id", "finding_key"]


def derived_status(findings: DataFrame, suppressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Status after all events: the last suppression or reviewing feedback wins.

    Events stay append-only; nothing is updated in place.
    """
    marks = suppressions.select(*FINDING_KEY, "created_at", F.lit("suppressed").alias("mark"))
    reviewed = feedback.filter(F.col("feedback_type").isin(*C.REVIEWED_FEEDBACK)).select(
        *FINDING_KEY, "created_at", F.lit("reviewed").alias("mark"))
    last = marks.unionByName(reviewed).groupBy(*FINDING_KEY).agg(
        F.max_by("mark", F.struct("created_at", "mark")).alias("mark"))
    return (findings.join(last, FINDING_KEY, "left")
            .withColumn("status", F.coalesce("mark", "status")).drop("mark"))


def with_triage(findings: DataFrame, suppressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Findings with the status their events give them, and their suppression and feedback state.

    The events of a finding are counted, not collected: a list per finding has no bound, and the
    event tables already hold the rows in long form.
    """
    findings = derived_status(findings, suppressions, feedback)
    muted = suppressions.groupBy(*FINDING_KEY).agg(
        F.max("active").alias("suppressed"), F.count("*").alias("suppression_count"),
        F.max_by("reason", F.struct("created_at", "reason")).alias("last_reason"))
    notes = feedback.groupBy(*FINDING_KEY).agg(
        F.count("*").alias("feedback_count"),
        F.max_by("feedback_type", F.struct("created_at", "feedback_type")).alias("last_feedback"))
    return (findings.join(muted, FINDING_KEY, "left").join(notes, FINDING_KEY, "left")
            .fillna({"suppressed": False, "suppression_count": 0, "feedback_count": 0}))


def triage_rows(findings: DataFrame, suppressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every suppression and feedback of a finding as a row of its own."""
    events = suppressions.select(*FINDING_KEY, F.lit("suppression").alias("kind"), F.col("reason").alias("detail"), "created_at")
    events = events.unionByName(feedback.select(*FINDING_KEY, F.lit("feedback").alias("kind"),
                                                F.col("feedback_type").alias("detail"), "created_at"))
    return findings.join(events, FINDING_KEY)


OWNER_DOCUMENT = "array<struct<id:string,owner_count:bigint,top_contributor_share:double,ownership_risk:string>>"


def with_payload_owners(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings with the owner columns their scan's payload holds, for scans stored without them."""
    listed = F.from_json(payload_analysis(F.col("payload"), "findings"), OWNER_DOCUMENT)
    rows = scans.select("scan_id", F.explode(listed).alias("o"))
    owners = rows.groupBy("scan_id", F.col("o.id").alias("finding_key")).agg(*[
        F.max(f"o.{name}").alias(name) for name in ("owner_count", "top_contributor_share", "ownership_risk")])
    kept = findings.drop("owner_count", "top_contributor_share", "ownership_risk")
    return kept.join(owners, FINDING_KEY, "left")


def unresolved() -> Column:
    return (F.col("status") == "open") & ~F.col("suppressed")


def query_findings(findings: DataFrame, *, category=None, severity=None, module=None,
                   min_confidence=None) -> DataFrame:
    """Filtered findings; filters reach the scan of the store. Sort and page with ``page``."""
    kept = findings
    if category:
        kept = kept.filter(F.col("category") == category)
    if severity:
        floor = C.SEVERITY_RANK.get(severity.lower(), 0)
        allowed = [name for name, rank in C.SEVERITY_RANK.items() if rank >= floor]
        if floor:
            kept = kept.filter(F.lower(F.coalesce("severity", F.lit("low"))).isin(*allowed))
    if module:
        kept = kept.filter(F.col("module") == module)
    if min_confidence is not None:
        kept = kept.filter(F.coalesce("confidence", F.lit(0)) >= min_confidence)
    return kept


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a total order; the row count before paging is ``df.count()``."""
    return df.orderBy(*order).offset(offset).limit(limit)


def next_page(findings: DataFrame, scan_id, last_seq: int | None = None, limit: int = 50) -> DataFrame:
    """The rows of a scan that come after ``last_seq``, the last one seen, in finding order.

    ``seq`` rises in that order and files are sorted by it, so the filter skips what lies before, and a late page reads
    no more than the first.
    """
    rows = findings.filter(F.col("scan_id") == scan_id)
    return (rows if last_seq is None else rows.filter(F.col("seq") > last_seq)).orderBy("seq").limit(limit)


def triage_stats(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Total, open, suppressed and reviewed findings with rates."""
    counts = findings.groupBy(*keys).agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.col("status") == "open").alias("active_findings"),
        F.count_if("suppressed").alias("suppressed_findings"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed_findings"))
    total = F.col("total_findings")
    return counts.withColumn("suppression_rate", percent(F.col("suppressed_findings"), total)
                             ).withColumn("review_rate", percent(F.col("reviewed_findings"), total))


def category_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("findings"))


def top_unresolved(findings: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    return top_per_group(findings.filter(unresolved()), keys, finding_order("seq"), limit)


# --- comparison -----------------------------------------------------------------------------------

def compare(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each scan pair as added, removed or common, with their severity change.

    ``pairs``: repo_id, previous_scan_id, latest_scan_id. A finding id repeated inside one scan
    counts once, the last one wins.
    """
    sides = pairs.select("repo_id", F.explode(F.array(
        F.struct(F.col("latest_scan_id").alias("scan_id"), F.lit("latest").alias("side")),
        F.struct(F.col("previous_scan_id").alias("scan_id"), F.lit("previous").alias("side"))
    )).alias("s")).select("repo_id", "s.scan_id", "s.side").filter("scan_id IS NOT NULL")
    wanted = findings.select("scan_id", "finding_key", "file_path", "category", "severity",
                             "cost_usd", "seq")
    rows = wanted.join(sides, "scan_id")
    single = keep_last(rows, ["repo_id", "side", "finding_key"], "seq")

    def side(name):
        return single.filter(F.col("side") == name).select(
            "repo_id", "finding_key",
            *[F.col(c).alias(f"{name}_{c}") for c in
              ("file_path", "category", "severity", "cost_usd", "seq")])

    both = side("latest").join(side("previous"), ["repo_id", "finding_key"], "full")
    latest, previous = F.col("latest_seq"), F.col("previous_seq")
    from_rank = severity_rank(F.col("previous_severity"))
    to_rank = severity_rank(F.col("latest_severity"))
    return both.withColumn(
        "change", F.when(previous.isNull(), "added").when(latest.isNull(), "removed")
        .otherwise("common")).withColumn(
        "severity_change", F.when(F.col("change") != "common", F.lit(None))
        .when(to_rank > from_rank, "worsened").when(to_rank < from_rank, "improved"))


def compare_summary(pairs: DataFrame, finding_counts: DataFrame) -> DataFrame:
    """Metric deltas of each pair; without a previous scan the latest values are the delta."""
    counts = finding_counts.select("scan_id", "findings")
    joined = pairs
    for name in ("latest", "previous"):
        joined = joined.join(counts.select(
            F.col("scan_id").alias(f"{name}_scan_id"), F.col("findings").alias(f"{name}_findings")),
            f"{name}_scan_id", "left")

    def delta(name):
        change = (F.coalesce(F.col(f"latest_{name}"), F.lit(0)).cast("double")
                  - F.coalesce(F.col(f"previous_{name}"), F.lit(0)).cast("double"))
        return places(change, 2)

    return joined.select(
        "repo_id", "latest_scan_id", "previous_scan_id",
        delta("total_cost_usd").alias("cost_delta_usd"),
        delta("debt_score").alias("debt_score_delta"),
        delta("total_hours").alias("hours_delta"),
        (F.coalesce("latest_findings", F.lit(0)) - F.coalesce("previous_findings", F.lit(0)))
        .alias("finding_count_delta"))


def change_rollup(changes: DataFrame) -> DataFrame:
    """Count and cost of new, existing and resolved findings per repository, over all of them."""
    state = (F.when(F.col("change") == "added", "new").when(F.col("change") == "removed", "resolved")
             .otherwise("existing"))
    rows = changes.withColumn("state", state).withColumn(
        "cost", F.coalesce("latest_cost_usd", "previous_cost_usd"))
    return rows.groupBy("repo_id", "state").agg(F.count("*").alias("findings"),
                                                sum_cents("cost", "cost_usd"))


def change_items(changes: DataFrame, change: str, limit: int) -> DataFrame:
    """First findings of one kind of change per repository, in scan order."""
    seq = F.coalesce("latest_seq", "previous_seq")
    return top_per_group(changes.filter(F.col("change") == change).withColumn("seq", seq),
                         ["repo_id"], [F.col("seq")], limit)


def first_scan_rollup(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Repositories with one scan: every stored finding, repeated ids included, is new."""
    first = pairs.filter("previous_scan_id IS NULL").select(
        "repo_id", F.col("latest_scan_id").alias("scan_id"))
    return findings.join(first, "scan_id").groupBy("repo_id").agg(
        F.lit("new").alias("state"), F.count("*").alias("findings"), sum_cents("cost_usd"))


def whole_change_rollup(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """New, existing and resolved findings of every repository; with a first scan all are new."""
    both = compare(pairs.filter("previous_scan_id IS NOT NULL"), findings)
    return change_rollup(both).unionByName(first_scan_rollup(pairs, findings))


def change_lists(changes: DataFrame, limit: int) -> DataFrame:
    """First findings of each kind of change per repository, in scan order."""
    kind = F.when(F.col("change") != "common", F.col("change")).otherwise(F.col("severity_change"))
    rows = changes.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn(
        "seq", F.coalesce("latest_seq", "previous_seq"))
    return top_per_group(rows, ["repo_id", "kind"], [F.col("seq")], limit)


def category_deltas(changes: DataFrame) -> DataFrame:
    """New, resolved and net findings per category."""
    category = F.coalesce("latest_category", "previous_category", F.lit("unknown"))
    new, gone = F.count_if(F.col("change") == "added"), F.count_if(F.col("change") == "removed")
    return changes.filter("change <> 'common'").groupBy(
        "repo_id", category.alias("category")).agg(
        new.alias("new"), gone.alias("resolved"), (new - gone).alias("net"))


# --- trends ---------------------------------------------------------------------------------------

def debt_trend(scans: DataFrame, limit: int = 20, user_id=None) -> DataFrame:
    """Change of the latest scan against the one before, with the ends of the shown history."""
    recent = history(scans, limit, user_id)
    cost = F.col("total_cost_usd").cast("double")

    def at(position):
        return F.max(F.when(F.col("position") == position, cost))

    ends = recent.groupBy("repo_id").agg(
        F.count("*").alias("total_scans"), at(1).alias("latest_cost"), at(2).alias("previous_cost"),
        F.max_by(cost, "position").alias("first_scan_cost"))
    change = F.when((F.col("total_scans") < 2) | (F.col("previous_cost") == 0), F.lit(0.0)).otherwise(
        (F.col("latest_cost") - F.col("previous_cost")) / F.col("previous_cost") * 100)
    return ends.select(
        "repo_id", places(change, 1).alias("change_pct"),
        F.when(change > 2, "up").when(change < -2, "down").otherwise("stable").alias("direction"),
        "total_scans", "first_scan_cost", "latest_cost")


def trend_points(recent: DataFrame) -> DataFrame:
    """Oldest-first points of a history with display dates."""
    return recent.select(
        "repo_id", "scan_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.date_format("created_at", "MMM dd").alias("date_display"), "total_cost_usd", "debt_score",
        (-F.col("position")).alias("sort_key"))


def scan_category_trend(recent: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings and cost per scan and category of a history."""
    shown = recent.select("repo_id", "scan_id", "created_at")
    return findings.join(shown, "scan_id").groupBy(
        "repo_id", "scan_id", "created_at", F.coalesce("category", F.lit("unknown"))
        .alias("category")).agg(F.count("*").alias("findings"), sum_cents("cost_usd"))


def active_trend(recent: DataFrame, findings: DataFrame) -> DataFrame:
    """Open, unsuppressed findings and their cost per scan; scans without any count zero."""
    active = of_scans(findings, recent).filter(unresolved()).groupBy("scan_id").agg(
        F.count("*").alias("active_finding_count"), sum_cents("cost_usd", "active_cost_usd"))
    return (recent.select("repo_id", "scan_id", "created_at").join(active, "scan_id", "left")
            .withColumn("active_finding_count", F.coalesce("active_finding_count", F.lit(0)))
            .withColumn("active_cost_usd", F.coalesce("active_cost_usd", F.lit(0))))


def finding_rollups(findings: DataFrame) -> DataFrame:
    """Findings, and those stored as open, with their cost per scan and category: written with a scan, so that trends
    need no finding rows."""
    is_open = F.col("status") == "open" if "status" in findings.columns else F.lit(True)
    cost = F.col("cost_usd").cast("decimal(28,2)")
    return findings.groupBy("repo_id", "scan_id", F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("findings"), F.sum(cost).alias("cost_usd"), F.count_if(is_open).alias("open_findings"),
        F.sum(F.when(is_open, cost)).alias("open_cost_usd"))


def rolled_up_category_trend(recent: DataFrame, rollups: DataFrame) -> DataFrame:
    """Findings and cost per category of the scans of a history, from the rollups alone."""
    return rollups.join(recent.select("scan_id", "created_at"), "scan_id").select(
        "repo_id", "scan_id", "created_at", "category", "findings", "cost_usd")


def rolled_up_active_trend(recent: DataFrame, rollups: DataFrame, findings: DataFrame, suppressions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Open, unsuppressed findings and their cost per scan: the rollups less what events have closed.

    Of the findings only those that an event names are read.
    """
    opened = of_scans(rollups, recent).groupBy("scan_id").agg(F.sum("open_findings").alias("n"), F.sum("open_cost_usd").alias("cost"))
    muted, notes = of_scans(suppressions, recent), of_scans(feedback, recent)
    named = muted.select(*FINDING_KEY).unionByName(notes.select(*FINDING_KEY)).distinct()
    touched = findings.join(named, FINDING_KEY, "left_semi").filter("status = 'open'")
    closed = with_triage(touched, muted, notes).filter(~unresolved()).groupBy("scan_id").agg(
        F.count("*").alias("gone"), F.sum("cost_usd").alias("gone_cost"))
    zero = F.lit(0)
    return recent.select("repo_id", "scan_id", "created_at").join(opened, "scan_id", "left").join(closed, "scan_id", "left").select(
        "repo_id", "scan_id", "created_at", (F.coalesce("n", zero) - F.coalesce("gone", zero)).alias("active_finding_count"),
        (F.coalesce("cost", zero) - F.coalesce("gone_cost", zero)).cast("decimal(28,2)").alias("active_cost_usd"))


def first_last_delta(points: DataFrame, keys: list[str], count: str, cost: str) -> DataFrame:
    """Last minus first point per key, over the scans in which the key appears."""
    when = F.struct("created_at", "scan_id")
    return points.groupBy(*keys).agg(
        (F.max_by(count, when) - F.min_by(count, when)).alias("count_delta"),
        (F.max_by(cost, when) - F.min_by(cost, when)).cast("decimal(18,2)").alias("cost_delta_usd"))


def module_trend(recent: DataFrame, modules: DataFrame) -> DataFrame:
    shown = spread(recent.select("repo_id", "scan_id", "created_at"), "scan_id")
    return modules.join(shown, "scan_id").select(
        "repo_id", "scan_id", "created_at", F.coalesce("module", F.lit("root")).alias("module"),
        "finding_count", "total_cost_usd",
        F.coalesce("max_severity", F.lit("low")).alias("max_severity"))


def latest_module_severity(points: DataFrame) -> DataFrame:
    when = F.struct("created_at", "scan_id")
    return points.groupBy("repo_id", "module").agg(
        F.max_by("max_severity", when).alias("latest_max_severity"))


def rich_trend(recent: DataFrame, findings: DataFrame, modules: DataFrame,
               roadmap: DataFrame) -> DataFrame:
    """Headline figures with finding, module and roadmap counts per scan of a history."""
    base = spread(trend_points(recent), "scan_id")
    counts = of_scans(findings, recent).groupBy("scan_id").agg(F.count("*").alias("finding_count"))
    areas = of_scans(modules, recent).groupBy("scan_id").agg(F.count("*").alias("module_count"))
    plan = of_scans(roadmap, recent).groupBy("scan_id").agg(
        F.count_if(F.col("bucket") == "quick_wins").alias("quick_wins"),
        F.count_if(F.col("bucket") == "strategic").alias("strategic_items"))
    joined = base
    for part in (counts, areas, plan):
        joined = joined.join(part, "scan_id", "left")
    return joined.fillna(0, ["finding_count", "module_count", "quick_wins", "strategic_items"])


# --- portfolio ------------------------------------------------------------------------------------

def with_urls(scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Scan address: the payload's own, else the repository's, else empty."""
    urls = repositories.select("repo_id", F.col("github_url").alias("repository_url"))
    if "payload_url" not in scans.columns:   # a saved scan keeps it in its payload
        scans = scans.withColumn("payload_url", F.get_json_object("payload", "$.github_url"))
    joined = scans.join(urls, "repo_id", "left")
    return joined.withColumn("url", F.coalesce(
        F.nullif("payload_url", F.lit("")), F.nullif("repository_url", F.lit("")), F.lit("")))


def portfolio(scans: DataFrame, repositories: DataFrame, categories: DataFrame,
              user_id=None) -> DataFrame:
    """Latest scan per address and user with risk level and most expensive category.

    Scans are reduced to the newest per (user, repository, own address) before the join with
    repositories, so a repository with very many scans is joined once per address.
    """
    if "payload_url" not in scans.columns:
        scans = scans.withColumn("payload_url", F.get_json_object("payload", "$.github_url"))
    done = complete(scans, user_id)
    newest = top_per_group(done, ["user_id", "repo_id", "payload_url"], newest_first(), 1).drop("position")
    keyed = with_urls(newest, repositories).withColumn(
        "key", F.when(F.col("url") != "", paths.repo_key(F.col("url"))).otherwise(F.col("repo_id")))
    latest = top_per_group(keyed, ["user_id", "key"], newest_first(), 1).drop("position")
    score = F.coalesce(F.col("debt_score").cast("double"), F.lit(0.0))
    document = payload_analysis(F.col("payload"), "repo_profile") if "payload" in latest.columns else F.lit(None).cast("string")
    latest = latest.withColumn("profile", F.from_json(document, PROFILE_DOCUMENT))
    top = top_category(of_scans(categories, latest))
    return latest.join(top, "scan_id", "left").select(
        "user_id", F.col("key").alias("repo_key"), "scan_id",
        F.when(F.col("url").startswith("http"), F.col("url"))
        .otherwise(F.concat(F.lit("https://github.com/"), "key")).alias("github_url"),
        score.alias("debt_score"),
        F.coalesce(F.col("total_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.col("total_hours").cast("double"), F.lit(0.0)).alias("remediation_hours"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("scanned_at"),
        F.coalesce("profile.tech_stack.primary_language", "primary_language", F.lit("Unknown")).alias("language"),
        F.coalesce("profile.team.estimated_team_size", _own(latest, "team_size"), F.lit(0)).alias("team_size"),
        F.coalesce("profile.team.bus_factor", _own(latest, "bus_factor"), F.lit(0)).alias("bus_factor"),
        F.coalesce("profile.tech_stack.has_tests", F.lit(False)).alias("has_tests"),
        F.coalesce("profile.tech_stack.has_ci_cd", F.lit(False)).alias("has_ci_cd"),
        F.coalesce("top_category", F.lit("unknown")).alias("top_category"),
        risk_level(score).alias("risk_level"))


PROFILE_DOCUMENT = ("struct<tech_stack:struct<primary_language:string,has_tests:boolean,has_ci_cd:boolean>,"
                    "team:struct<estimated_team_size:int,bus_factor:int>>")


def _own(df: DataFrame, name: str) -> Column:
    """A column of the scan itself, null where the frame has none."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast("int")


def top_category(categories: DataFrame) -> DataFrame:
    """Most expensive category of every scan; equal costs go to the first name."""
    order = F.struct(-F.col("cost_usd"), F.col("category"))
    return categories.groupBy("scan_id").agg(
        paths.title_label(F.min_by("category", order)).alias("top_category"))


def portfolio_summary(scans: DataFrame, user_id=None, keys: tuple[str, ...] = ()) -> DataFrame:
    done = complete(scans, user_id)
    per_repo = done.groupBy(*keys, "repo_id").agg(
        F.count("*").alias("n"), F.sum("debt_score").alias("score"),
        F.sum("total_cost_usd").alias("cost"), F.sum("total_hours").alias("hours"),
        F.max("debt_score").alias("worst"), F.min("debt_score").alias("best"))
    return per_repo.groupBy(*keys).agg(
        F.count("repo_id").alias("total_repos"), F.sum("n").alias("total_scans"),
        places(F.sum("score").cast("double") / F.sum("n"), 1).alias("avg_debt_score"),
        sum_cents("cost", "total_cost_usd"), sum_cents("hours", "total_hours"),
        F.max("worst").alias("worst_score"), F.min("best").alias("best_score"))


def portfolio_trends(scans: DataFrame, user_id=None) -> DataFrame:
    """Score and cost points per repository; order by repository and date when shown."""
    return complete(scans, user_id).select(
        "user_id", "repo_id", "scan_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.coalesce("debt_score", F.lit(0)).alias("score"),
        F.coalesce("total_cost_usd", F.lit(0)).alias("cost"))


def repository_list(repositories: DataFrame, scans: DataFrame) -> DataFrame:
    """Repositories with last scan, latest cost and score and their number of scans of any status.

    The store is append-only: when a repository was last scanned is read from its scans.
    """
    counts = scans.groupBy("repo_id").agg(F.count("*").alias("total_scans"))
    latest = latest_scans(scans).select(
        "repo_id", F.col("created_at").alias("last_scanned"),
        F.col("total_cost_usd").alias("latest_cost"), F.col("debt_score").alias("latest_score"))
    return (repositories.join(counts, "repo_id", "left").join(latest, "repo_id", "left")
            .fillna(0, ["total_scans"]))


def recently_scanned(listed: DataFrame) -> DataFrame:
    """Repositories, the most recently scanned first; those never scanned come last."""
    return listed.orderBy(F.col("last_scanned").desc_nulls_last(), "repo_id")


PORTFOLIO_SORTS = ("debt_score", "total_cost", "scanned_at")


def sort_portfolio(rows: DataFrame, by: str = "debt_score", descending: bool = True) -> DataFrame:
    """Portfolio rows in a chosen order; follow with ``limit`` to read the leading rows."""
    if by not in PORTFOLIO_SORTS:
        raise ValueError(f"sort by one of {PORTFOLIO_SORTS}")
    column = F.col(by)
    return rows.orderBy(column.desc() if descending else column.asc(), "repo_key")


def scan_by_id(scans: DataFrame, scan_id, user_id=None) -> DataFrame:
    found = scans.filter(F.col("scan_id") == scan_id)
    return found if user_id is None else found.filter(F.col("user_id") == user_id)


def scan_by_job(scans: DataFrame, job_id, user_id=None) -> DataFrame:
    found = scans.filter(F.col("job_id") == job_id)
    return found if user_id is None else found.filter(F.col("user_id") == user_id)


def scan_summary(scans: DataFrame) -> DataFrame:
    """Headline fields of scans; the free summary comes from the stored payload."""
    return scans.select(
        "scan_id", "repo_id", "job_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "total_cost_usd",
        "debt_score", "total_hours", "total_sprints",
        F.coalesce(payload_analysis(F.col("payload"), "cost_by_category"), F.lit("{}")).alias("cost_by_category"),
        F.coalesce(payload_analysis(F.col("payload"), "summary"), F.lit("{}")).alias("summary"))


def profile_field(payload: Column, path: str, column: Column, default) -> Column:
    """Field of the stored profile, else the scan's own column, else a default."""
    return F.coalesce(payload_analysis(payload, f"repo_profile.{path}"), column.cast("string"),
                      F.lit(default))


def scans_with_keys(scans: DataFrame, repositories: DataFrame) -> DataFrame:
    return with_urls(scans, repositories).select(
        "scan_id", "repo_id", "repository_url", paths.repo_key(F.col("url")).alias("normalized"),
        "debt_score", "total_cost_usd", "created_at")


CHANGE_STATES = ("new", "existing", "resolved")


def with_changes(rollup: DataFrame, changes: DataFrame) -> DataFrame:
    """A summary with the counts of a whole change rollup: new, existing and resolved findings."""
    counts = changes.groupBy("repo_id").agg(*[
        F.sum(F.when(F.col("state") == state, F.col("findings")).otherwise(0)).alias(f"{state}_findings") for state in CHANGE_STATES])
    return rollup.join(counts, "repo_id", "left").fillna(0, [f"{state}_findings" for state in CHANGE_STATES])


def summary_rollup(scans: DataFrame, findings: DataFrame, modules: DataFrame,
                   roadmap: DataFrame) -> DataFrame:
    """High-level figures of the latest scan of every repository, the stored ownership summary among them."""
    latest = latest_scans(scans)
    stats = triage_stats(of_scans(findings, latest), ["scan_id"])
    areas = of_scans(modules, latest).groupBy("scan_id").agg(F.count("*").alias("module_count"))
    plan = of_scans(roadmap, latest).groupBy("scan_id").agg(
        F.count_if(F.col("bucket") == "quick_wins").alias("quick_wins"),
        F.count_if(F.col("bucket") == "strategic").alias("strategic_items"))
    owners = payload_analysis(F.col("payload"), "ownership_summary") if "payload" in latest.columns else F.lit(None).cast("string")
    joined = latest.select("repo_id", "scan_id", "total_cost_usd", "debt_score", "total_hours",
                           F.coalesce(owners, F.lit("{}")).alias("ownership_summary"))
    for part in (stats, areas, plan):
        joined = joined.join(part, "scan_id", "left")
    whole = ("total_findings", "active_findings", "suppressed_findings", "reviewed_findings",
             "module_count", "quick_wins", "strategic_items")
    return joined.fillna(0, list(whole)).withColumns({
        rate: F.coalesce(rate, F.lit(0).cast("decimal(18,1)")) for rate in ("suppression_rate", "review_rate")})


def top_modules(modules: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    return top_per_group(modules, keys, module_order(), limit)


def payload_analysis(payload: Column, field: str) -> Column:
    """Field of a stored payload: of its ``raw_analysis`` document if present, else of the whole."""
    nested = F.get_json_object(payload, "$.raw_analysis")
    is_document = nested.startswith("{")
    return F.when(F.coalesce(is_document, F.lit(False)),
                  F.get_json_object(payload, f"$.raw_analysis.{field}")).otherwise(
        F.get_json_object(payload, f"$.{field}"))

