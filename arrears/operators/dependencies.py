"""Manifests: loose version specs, tech stack, and known vulnerabilities."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths, text
from arrears.functions.numeric import cents
from arrears.functions.scoring import (
    business_impact, confidence, cvss_severity, vulnerability_hours,
)
from arrears.operators.common import keep_last, spread
from arrears.operators.items import debt_items

NPM_MANIFEST = ("struct<dependencies:map<string,string>,devDependencies:map<string,string>>")


def root_manifests(source_files: DataFrame) -> DataFrame:
    return source_files.filter(
        F.col("path").isin("requirements.txt", "pyproject.toml", "package.json"))


def requirement_lines(files: DataFrame) -> DataFrame:
    """Effective lines of pip manifests with their 1-based line number."""
    lines = files.filter(paths.base_name(F.col("path")) == "requirements.txt").select(
        "repo_id", "path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    bare = F.regexp_replace(F.substring_index("raw", "#", 1), r"^\s+|\s+$", "")
    return (lines.select("repo_id", "path", (F.col("pos") + 1).alias("line"),
                         bare.alias("requirement"))
            .filter((F.col("requirement") != "") & ~F.col("requirement").startswith("-")))


def npm_dependencies(files: DataFrame) -> DataFrame:
    """Rows (section, package, spec) of package.json files; malformed files give none."""
    parsed = files.filter(paths.base_name(F.col("path")) == "package.json").select(
        "repo_id", "path", F.from_json("text", NPM_MANIFEST).alias("doc"))
    sections = parsed.select("repo_id", "path", F.explode(F.map_from_arrays(
        F.array(F.lit("dependencies"), F.lit("devDependencies")),
        F.array("doc.dependencies", "doc.devDependencies"))).alias("section", "specs"))
    return sections.select("repo_id", "path", "section",
                           F.explode("specs").alias("package", "spec"))


def _hygiene_items(df: DataFrame) -> DataFrame:
    severity = text.issue_severity(F.col("issue"))
    return debt_items(
        df.filter("issue IS NOT NULL"), "dependency_hygiene", category="dependency",
        severity=severity, kind=F.col("issue"), hours=F.when(severity == "medium", 0.75)
        .otherwise(1.5), impact="medium", trust=confidence("dependency"),
        file=paths.base_name(F.col("path")), line=F.col("line"), package=F.col("package"),
        version_specifier=F.col("spec"), detail=F.col("section"))


def loose_requirements(files: DataFrame) -> DataFrame:
    lines = requirement_lines(root_manifests(files)).select(
        "repo_id", "path", "line", F.lit(None).cast("string").alias("section"),
        text.requirement_name(F.col("requirement")).alias("package"),
        text.requirement_spec(F.col("requirement")).alias("spec")).filter("package <> ''")
    return _hygiene_items(lines.withColumn("issue", text.pip_issue(F.col("spec"))))


def loose_packages(files: DataFrame) -> DataFrame:
    deps = npm_dependencies(root_manifests(files)).withColumn("line", F.lit(None).cast("int"))
    return _hygiene_items(deps.withColumn("issue", text.npm_issue(F.col("spec"))))


def dependency_hygiene(files: DataFrame) -> DataFrame:
    return loose_requirements(files).unionByName(loose_packages(files))


# --- vulnerabilities ------------------------------------------------------------------------------

def pinned_packages(files: DataFrame) -> DataFrame:
    """Packages and versions of root pip manifests; a bare name has version ``unknown``."""
    lines = files.filter("path = 'requirements.txt'").select(
        "repo_id", F.explode(F.split("text", "\r?\n")).alias("raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    pinned = r"^([a-zA-Z0-9_-]+)([=<>!~]+)(.+)$"
    name = F.lower(F.regexp_extract(line, pinned, 1))
    bare = F.lower(F.regexp_extract(line, r"^([a-zA-Z0-9_-]+)$", 1))
    return lines.filter((line != "") & ~line.startswith("#")).select(
        "repo_id", F.coalesce(F.nullif(name, F.lit("")), bare).alias("package"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract(line, pinned, 3)), F.lit("")),
                   F.lit("unknown")).alias("version")).filter("package <> ''")


def vulnerability_facts(records: DataFrame) -> DataFrame:
    """First CVE alias, first numeric score and first fixed version of landed advisory records."""
    scores = F.filter(F.transform("severity", lambda s: s["score"].try_cast("double")),
                      lambda s: s.isNotNull())
    cves = F.filter("aliases", lambda a: a.startswith("CVE-"))
    events = F.get(F.get(F.col("affected"), F.lit(0))["ranges"], F.lit(0))["events"]
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f.isNotNull())
    return records.select("package", "version", F.get(scores, F.lit(0)).alias("cvss_score"),
                          F.get(cves, F.lit(0)).alias("cve_id"),
                          F.get(fixed, F.lit(0)).alias("fixed_version"))


BLOCK = 5_000  # rows of each side of a popular package that meet in one piece


def _slice(rows: DataFrame, mine: str, other: str, at: str, over: str) -> DataFrame:
    """Each row in one slice of its own side, repeated for every slice of the other side."""
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (mine, other)]), F.col(mine))
    return rows.withColumn(at, own).withColumn(over, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop(mine, other)


def vulnerable_packages(packages: DataFrame, facts: DataFrame, block: int | None = None) -> DataFrame:
    """Packages joined to advisories.

    With ``block`` a package that many require and many advisories name does not meet in one task: both sides are cut by
    the hash of their rows into slices of about that many, and each pair of slices is a key of its own. A pair of rows
    meets once, where their slices do; the repeated rows are two in ``block`` of the pairs.
    """
    keys = ["package", "version"]
    if block is None:
        return packages.join(facts, keys)
    slices = F.ceil(F.count("*") / block)
    sizes = packages.groupBy(*keys).agg(slices.alias("_here")).join(facts.groupBy(*keys).agg(slices.alias("_there")), keys)
    met = [*keys, "_i", "_j"]
    left = _slice(packages.join(sizes, keys), "_here", "_there", "_i", "_j")
    right = _slice(facts.join(sizes, keys), "_there", "_here", "_j", "_i")
    return spread(left, *met).join(right.hint("merge"), met).drop("_i", "_j")


def _vulnerability_items(hits: DataFrame, severity: Column, **extra) -> DataFrame:
    hours = vulnerability_hours(severity)
    low = F.lower(severity)
    return debt_items(
        hits, "vulnerabilities", category="dependency", severity=low, kind="vulnerability",
        hours=hours, impact=business_impact(low), trust=confidence("dependency"),
        file="requirements.txt", package=F.col("package"), version_specifier=F.col("version"),
        fixed_cost=cents(hours * C.VULNERABILITY_RATE), **extra)


def vulnerabilities(files: DataFrame, records: DataFrame) -> DataFrame:
    """One item per package and advisory: as many as all advisories of a package times all that require it."""
    hits = vulnerable_packages(pinned_packages(files), vulnerability_facts(records), BLOCK)
    return _vulnerability_items(hits, cvss_severity(F.col("cvss_score")), cve_id=F.col("cve_id"),
                                cvss_score=F.col("cvss_score"), fixed_version=F.col("fixed_version"))


def counted_vulnerabilities(files: DataFrame, records: DataFrame) -> DataFrame:
    """The same items without the advisories' own columns; those of one package and severity are one row with ``copies``.

    Advisories are counted by version and severity before the join, so the rows grow with the packages.
    """
    facts = vulnerability_facts(records).groupBy(
        "package", "version", cvss_severity(F.col("cvss_score")).alias("cvss_severity")).agg(F.count("*").alias("copies"))
    hits = vulnerable_packages(pinned_packages(files), facts)
    return _vulnerability_items(hits, F.col("cvss_severity"), copies=F.col("copies"))


# --- tech stack -----------------------------------------------------------------------------------

def declared_dependencies(files: DataFrame) -> DataFrame:
    """Name -> version of every dependency file; a later file (by path) replaces an earlier one."""
    kept = files.filter(~paths.mentions_skip_name(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    lines = requirement_lines(kept)
    parts = F.split("requirement", "[=<>!~]")
    pip = lines.select("repo_id", "path", F.trim(F.get(parts, F.lit(0))).alias("name"),
                       F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("version"),
                       F.col("line").alias("pos"))
    npm = npm_dependencies(kept).select("repo_id", "path", F.col("package").alias("name"),
                                        F.col("spec").alias("version"),
                                        F.when(F.col("section") == "dependencies", 0)
                                        .otherwise(1).alias("pos"))
    setup = kept.filter(paths.base_name(F.col("path")).isin("pyproject.toml", "setup.py"))
    named = setup.select("repo_id", "path", F.explode(F.regexp_extract_all(
        "text", F.lit(r"[\"']?([a-zA-Z0-9_-]+)\s*[=<>]+"), F.lit(1))).alias("name"),
        F.lit("").alias("version"), F.lit(0).alias("pos"))
    everything = pip.unionByName(npm).unionByName(named)
    return keep_last(everything.withColumn("_order", F.struct("path", "pos", "version")),
                     ["repo_id", "name"], "_order").select("repo_id", "name", "version")


def keyword_table(spark) -> DataFrame:
    """Fixed keyword dimension (under a hundred rows)."""
    rows = [(category, keyword, keyword.lower()) for category, words in C.TECH_KEYWORDS.items()
            for keyword in words]
    return spark.createDataFrame(rows, "category string, keyword string, name string")


def detected_technologies(dependencies: DataFrame) -> DataFrame:
    keywords = keyword_table(dependencies.sparkSession)
    return (dependencies.select("repo_id", F.lower("name").alias("name")).distinct()
            .join(F.broadcast(keywords), "name").select("repo_id", "category", "keyword"))


def extension_census(files: DataFrame) -> DataFrame:
    """Code files per extension, configuration and text formats aside."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    ext = paths.extension(F.col("path"))
    return (files.filter(~paths.mentions_skip_name(folder)).withColumn("extension", ext)
            .filter(F.col("extension").isNotNull()
                    & ~F.col("extension").isin(*C.NON_CODE_EXTENSIONS))
            .groupBy("repo_id", "extension").agg(F.count("*").alias("files")))


def stack_flags(files: DataFrame) -> DataFrame:
    """Tests, CI and containers by the presence of well-known root entries."""
    path = F.col("path")
    return files.groupBy("repo_id").agg(
        F.max(path.rlike("^(?:tests|test|__tests__|spec)/")).alias("has_tests"),
        F.max(path.startswith(".github/workflows/")).alias("has_ci_cd"),
        F.max(path.isin("Dockerfile", "docker-compose.yml")).alias("has_docker"))


def tech_stack(files: DataFrame) -> DataFrame:
    """One row per repository: main language, technologies per category, flags, dependency count.

    Lists hold fixed keywords only, so their length is bounded by the keyword table.
    """
    dependencies = declared_dependencies(files)
    found = detected_technologies(dependencies).groupBy("repo_id").agg(*[
        F.sort_array(F.collect_set(F.when(F.col("category") == name, F.col("keyword"))))
        .alias(name) for name in C.TECH_KEYWORDS])
    language = extension_census(files).groupBy("repo_id").agg(
        F.min_by("extension", F.struct(-F.col("files"), "extension")).alias("primary_language"))
    counts = dependencies.groupBy("repo_id").agg(F.count("*").alias("dependency_count"))
    empty = F.array().cast("array<string>")
    return (stack_flags(files).join(language, "repo_id", "left").join(found, "repo_id", "left")
            .join(counts, "repo_id", "left")
            .fillna({"primary_language": "py", "dependency_count": 0})
            .withColumns({name: F.coalesce(name, empty) for name in C.TECH_KEYWORDS})
            .withColumn("uses_ai", F.size("ai_ml") > 0))
