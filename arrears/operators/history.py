"""Change history: hotspots, contributor concentration, ownership and team profile."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.functions import paths
from arrears.functions.numeric import places
from arrears.functions.scoring import ownership_risk, repo_multipliers
from arrears.operators.common import stage, top_per_group


def first_commits(commit_files: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows of the ``limit`` oldest commits of every repository; without a limit, everything.

    Commits are ranked without their files: two narrow columns, one row per commit.
    """
    if limit is None:
        return commit_files
    commits = commit_files.select("repo_id", "commit_seq").distinct()
    first = top_per_group(commits, ["repo_id"], [F.col("commit_seq")], limit).drop("position")
    return commit_files.join(first, ["repo_id", "commit_seq"], "left_semi")


def changed_files(commit_files: DataFrame) -> DataFrame:
    """Resolve each change to one normalised path and drop excluded folders.

    The path is generated, as a list of one: a plain expression would be merged into the tests and the replacements below
    and worked out again in each of them, with all that the caller's columns are made of.
    """
    path = F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")))
    return (commit_files.withColumn("path", F.explode(F.array(path)))
            .filter(F.col("path").isNotNull() & ~paths.has_skip_part(F.col("path")))
            .withColumn("path", paths.normalize_repo_path(F.col("path"))))


def author_changes(commit_files: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Changes of each file by each author address, with the last one: what hotspots and ownership of files add up.

    Paths are resolved here, once. A file that holds most changes is reduced on many tasks, as it is grouped with the
    author first. Stage it where both are asked for.
    """
    changes = changed_files(first_commits(commit_files, max_commits))
    return changes.groupBy("repo_id", "path", "author_email").agg(
        F.count("*").alias("changes"), *_latest("commit_seq", "author_date"))


def hotspots(commit_files: DataFrame | None, max_commits: int | None = None, by_author: DataFrame | None = None) -> DataFrame:
    """Change count, distinct authors and last change per file, over all or the oldest commits.

    ``by_author`` gives what ``author_changes`` found, in place of the commits.
    """
    per_author = author_changes(commit_files, max_commits) if by_author is None else by_author
    return per_author.groupBy("repo_id", "path").agg(
        F.sum("changes").alias("change_count"),
        F.count("author_email").alias("unique_authors"),
        F.max_by("last_changed", "last_seq").alias("last_changed"))


def _latest(order: str, moment: str) -> list[Column]:
    """Order and date of the last change; both stay fixed-width, which keeps hash aggregation."""
    return [F.max(order).alias("last_seq"), F.max_by(moment, order).alias("last_changed")]


def complexity_hotspots(functions: DataFrame) -> DataFrame:
    """Stand-in hotspots for repositories without history: two changes per function."""
    path = paths.normalize_repo_path(F.col("path"))
    return functions.withColumn("path", path).groupBy("repo_id", "path").agg(
        (F.count("*") * 2).alias("change_count"),
        F.lit(1).cast("long").alias("unique_authors"),
        F.lit(None).cast("timestamp").alias("last_changed"),
        F.sum("complexity").alias("complexity_score"),
        F.max("complexity").alias("max_complexity"))


def concentration(counts: DataFrame, keys: list[str], carry_latest: bool = False) -> DataFrame:
    """Owners, changes, top share and bus factor per key from rows (keys..., author, changes).

    Contributors with the same count are interchangeable, so they are first folded into a histogram
    (changes -> contributors). A key has at most sqrt(2 * total changes) distinct counts, which
    bounds the rows the running sum sees however many contributors share the key.
    ``carry_latest`` keeps the last change (``last_seq``, ``last_changed``) of a key.
    """
    latest = _latest("last_seq", "last_changed") if carry_latest else []
    histogram = counts.groupBy(*keys, "changes").agg(F.count("*").alias("people"), *latest)
    volume = F.col("people") * F.col("changes")
    group = Window.partitionBy(*keys)
    running = group.orderBy(F.col("changes").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (histogram
              .withColumn("_people_before", F.coalesce(F.sum("people").over(running), F.lit(0)))
              .withColumn("_before", F.coalesce(F.sum(volume).over(running), F.lit(0)))
              .withColumn("_all", F.sum(volume).over(group)))
    # Fewest contributors that cover four fifths of all changes, in exact integer arithmetic.
    reached = (F.col("_before") + volume) * 5 >= F.col("_all") * 4
    needed = F.col("_people_before") + F.greatest(F.lit(1).cast("long"), F.expr(
        "(_all * 4 - _before * 5 + changes * 5 - 1) div (changes * 5)"))
    return (ranked.groupBy(*keys).agg(
        F.sum("people").alias("owner_count"),
        F.sum(volume).alias("total_changes"),
        F.max("changes").alias("_top"),
        F.coalesce(F.min(F.when(reached, needed)), F.sum("people")).alias("bus_factor"),
        *latest)
        .withColumn("top_contributor_share",
                    places(F.col("_top").cast("double") / F.col("total_changes"), 2))
        .drop("_top"))


def _author() -> Column:
    return F.lower(F.trim(F.coalesce("author_email", F.lit(""))))


def _identified(commit_files: DataFrame, max_commits: int | None) -> DataFrame:
    return first_commits(commit_files, max_commits).withColumn("author", _author())


def _with_risk(profile: DataFrame) -> DataFrame:
    return profile.withColumn("ownership_risk", ownership_risk(
        F.col("owner_count"), F.col("top_contributor_share"), F.col("total_changes")))


def file_ownership(commit_files: DataFrame | None, max_commits: int | None = None, by_author: DataFrame | None = None) -> DataFrame:
    """Owners and bus factor per file; ``by_author`` as in ``hotspots``."""
    if by_author is None:
        changes = changed_files(_identified(commit_files, max_commits).filter("author <> ''"))
        counts = changes.groupBy("repo_id", "path", "author").agg(
            F.count("*").alias("changes"), *_latest("commit_seq", "author_date"))
    else:   # spellings of an address are one author
        counts = by_author.withColumn("author", _author()).filter("author <> ''").groupBy("repo_id", "path", "author").agg(
            F.sum("changes").alias("changes"), F.max_by("last_changed", "last_seq").alias("last_changed"), F.max("last_seq").alias("last_seq"))
    return _with_risk(concentration(counts, ["repo_id", "path"], carry_latest=True)).drop("last_seq")


def module_ownership(commit_files: DataFrame, max_commits: int | None = None) -> DataFrame:
    """Every commit counts a touched file once for its folder."""
    changes = changed_files(_identified(commit_files, max_commits).filter("author <> ''"))
    touched = changes.select("repo_id", "commit_seq", "path", "author").distinct()
    counts = (touched.withColumn("module", paths.module_of(F.col("path")))
              .groupBy("repo_id", "module", "author").agg(F.count("*").alias("changes")))
    return _with_risk(concentration(counts, ["repo_id", "module"]))


def ownership_hotspots(files: DataFrame, hotspot_paths: DataFrame) -> DataFrame:
    """Ownership of the hotspot files, most at risk first within a repository."""
    return files.join(hotspot_paths.select("repo_id", "path").distinct(), ["repo_id", "path"],
                      "left_semi")


def hotspot_order() -> list[Column]:
    risk = F.col("ownership_risk")
    return [(risk == "critical").desc(), (risk == "high").desc(),
            F.col("top_contributor_share").desc(), F.col("total_changes").desc(), F.col("path")]


def ownership_summary(commit_files: DataFrame, files: DataFrame, hotspot_paths: DataFrame,
                      as_of, max_commits: int | None = None) -> DataFrame:
    """One row per repository: sample size, contributors, bus factor, siloed and handed-over hotspots."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 90 DAYS")
    commits = (_identified(commit_files, max_commits)
               .groupBy("repo_id", "commit_seq")
               .agg(F.max("author").alias("author"), F.max("author_date").alias("author_date")))
    counts = stage(commits.groupBy("repo_id", "author")
                   .agg(F.count("*").alias("changes"),
                        F.max((F.col("author_date") > cutoff).cast("int")).alias("active")))
    sample = counts.groupBy("repo_id").agg(
        F.sum("changes").alias("commit_sample_size"),
        F.count(F.when(F.col("author") != "", 1)).alias("unique_contributors"),
        F.sum(F.when(F.col("author") != "", F.col("active")).otherwise(0))
        .alias("active_contributors_90d"))
    people = concentration(counts.filter("author <> ''"), ["repo_id"]).select(
        "repo_id", "bus_factor", "top_contributor_share")
    share = F.col("top_contributor_share")
    spots = ownership_hotspots(files, hotspot_paths).groupBy("repo_id").agg(
        F.count_if((F.col("owner_count") <= 1) | (share >= 0.8)).alias("siloed_hotspots"),
        F.count_if(F.col("owner_count") >= 4).alias("handoff_hotspots"))
    return (sample.join(people, "repo_id", "left").join(spots, "repo_id", "left")
            .fillna(0, ["bus_factor", "siloed_hotspots", "handoff_hotspots"])
            .withColumn("top_contributor_share",
                        F.coalesce("top_contributor_share", F.lit(0).cast("decimal(18,2)"))))


def _seconds(moment: Column) -> Column:
    return moment.cast("timestamp").cast("long")


def team_profile(commit_files: DataFrame, as_of) -> DataFrame:
    """Team size, activity, bus factor and age over the whole history of a repository."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 90 DAYS")
    commits = (commit_files.groupBy("repo_id", "commit_seq")
               .agg(F.max("author_email").alias("author"), F.max("author_date").alias("author_date")))
    per_author = (commits.groupBy("repo_id", "author")
                  .agg(F.count("*").alias("changes"),
                       F.max((F.col("author_date") > cutoff).cast("int")).alias("active"),
                       F.min("commit_seq").alias("first_seq"),
                       F.min_by("author_date", "commit_seq").alias("first_date"),
                       *_latest("commit_seq", "author_date")))
    named = F.col("author").isNotNull() & (F.col("author") != "")
    totals = per_author.groupBy("repo_id").agg(
        F.count(F.when(named, 1)).alias("team_size"),
        F.sum(F.when(named, F.col("active")).otherwise(0)).alias("active_contributors"),
        F.sum("changes").alias("total_commits"),
        F.floor((_seconds(F.max_by("last_changed", "last_seq"))
                 - _seconds(F.min_by("first_date", "first_seq"))) / 86400).alias("repo_age_days"))
    people = concentration(per_author.select("repo_id", "author", "changes"), ["repo_id"]).select(
        "repo_id", "bus_factor")
    weeks = F.greatest(F.col("repo_age_days") / 7, F.lit(1.0))
    return (totals.join(people, "repo_id")
            .withColumn("is_solo", F.col("bus_factor") == 1)
            .withColumn("commit_frequency", places(F.col("total_commits") / weeks, 1)))


def default_team(repos: DataFrame, profile: DataFrame) -> DataFrame:
    """Profile of every repository; those without history get the single-developer default."""
    default = {"team_size": 1, "active_contributors": 1, "total_commits": 0, "repo_age_days": 365,
               "bus_factor": 1, "is_solo": True}
    return (repos.select("repo_id").join(profile, "repo_id", "left").fillna(default)
            .withColumn("commit_frequency",
                        F.coalesce("commit_frequency", F.lit(1).cast("decimal(18,1)"))))


def with_multipliers(team: DataFrame) -> DataFrame:
    return team.withColumns(repo_multipliers(
        F.col("repo_age_days"), F.col("bus_factor"), F.col("team_size")))
