"""Readers for checked-out trees, history extracts, manifests and landed feeds."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.functions import paths
from arrears.sources import schemas


def source_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files under ``root``/<repo_id>/... as (repo_id, path, text), excluded files dropped.

    ``pattern`` (such as ``*.py``) prunes at listing time. The folder filter runs before the text
    is decoded; undecodable bytes are dropped.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    prefix = root.rstrip("/").split(":", 1)[-1]
    relative = F.regexp_replace(bare, "^.*?" + _quoted(prefix) + "/", "")
    files = reader.load(root).select(
        F.substring_index(relative, "/", 1).alias("repo_id"),
        F.regexp_replace(relative, r"^[^/]*/", "").alias("path"), "content")
    path = F.col("path")
    return files.filter(~paths.under_skip_dir(path) & ~paths.is_skipped_file(path)).select(
        "repo_id", "path", F.replace(F.make_valid_utf8(F.col("content").cast("string")),
                                     F.lit("\ufffd"), F.lit("")).alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def commit_files(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.COMMIT_FILES).parquet(location)


def scanner_results(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.SCANNER_RESULTS).json(location)


def advisories(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.ADVISORIES).json(location)


def salaries(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.SALARIES).json(location).select(
        "title", F.col("companyName").alias("company"),
        F.col("totalyearlycompensation").alias("total_compensation"))


def remediation_rules(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.RULES).json(location).select(
        F.col("key").alias("rule_key"), "severity", "type",
        F.col("defaultRemFnBaseEffort").alias("base_effort"),
        F.col("defaultRemFn").alias("fixed_effort"))


def snippets(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(schemas.SNIPPETS).json(location)


def survey(spark: SparkSession, location: str, columns: str) -> DataFrame:
    """Survey CSV with a header; ``columns`` is its schema and must carry the row number ``seq``.

    Row numbers are stored when the file lands: a split file has no row order of its own.
    """
    return spark.read.schema(columns).option("header", "true").option("quote", '"').csv(location)


def repository_payloads(json_text: DataFrame) -> DataFrame:
    """Repository summaries from raw API documents (column ``payload``)."""
    doc = F.from_json("payload", schemas.REPOSITORY_PAYLOAD)
    return json_text.select(doc.alias("d")).select(
        "d.id", "d.name", "d.full_name", F.coalesce("d.private", F.lit(False)).alias("private"),
        "d.html_url", "d.clone_url", "d.default_branch", "d.description", "d.language",
        "d.updated_at", F.col("d.owner.login").alias("owner_login"),
        F.col("d.owner.avatar_url").alias("owner_avatar_url"))


def matches_search(query: str) -> Column:
    """Case-insensitive text search over name, description and language."""
    haystack = F.lower(F.concat_ws(" ", "full_name", "description", "language"))
    return F.contains(haystack, F.lit(query.strip().lower()))
