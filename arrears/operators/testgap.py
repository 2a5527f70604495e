"""Source files without a matching test, as an equality anti-join on file stems."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths
from arrears.functions.scoring import confidence
from arrears.operators.items import debt_items

_TEST_SUFFIX = r"(?:_test\.py|\.(?:test|spec)\.(?:tsx|ts|js))$"


def _suffixes(text: Column) -> Column:
    """All non-empty suffixes of a name; at most as many as the name is long."""
    size = F.length(text)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size),
                                        lambda i: F.substring(text, i, size)))


def tested_stems(test_paths: DataFrame) -> DataFrame:
    """Every stem some test path covers: (repo_id, stem), lower case.

    A test covers a stem when its name ends in ``test_<stem>.py``, ``<stem>_test.py`` or
    ``<stem>.test|spec.<ext>``, or when ``<stem>`` is a folder on its path. As no stem contains a
    slash, "path ends with" equals "base name ends with", so each test can list the stems it covers.
    """
    low = F.lower("path")
    name = paths.base_name(low)
    bare = F.regexp_replace(name, r"\.py$", "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(bare) - 4, F.lit(1))),
                      lambda i: F.substring(bare, i, 5) == "test_")
    after_prefix = F.when(name.endswith(".py"), F.transform(
        starts, lambda i: F.substring(bare, i + 5, F.length(bare))))
    before_suffix = F.when(name.rlike(_TEST_SUFFIX),
                           _suffixes(F.regexp_replace(name, _TEST_SUFFIX, "")))
    parts = F.split(low, "/")
    folders = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    empty = F.array().cast("array<string>")
    stems = F.concat(F.coalesce(after_prefix, empty), F.coalesce(before_suffix, empty), folders)
    return (test_paths.select("repo_id", F.explode(F.array_distinct(stems)).alias("stem"))
            .filter("stem <> ''").distinct())


def untested_sources(files: DataFrame) -> DataFrame:
    """Source files (repo_id, path) no test of the same repository covers."""
    path = F.col("path")
    kept = files.filter(~paths.under_skip_dir(path)).select("repo_id", "path")
    sources = kept.filter(paths.is_source_path(path)).withColumn("stem", F.lower(paths.stem(path)))
    stems = tested_stems(kept.filter(paths.is_test_path(path)))
    return sources.join(stems, ["repo_id", "stem"], "left_anti").drop("stem")


def flag_hotspots(sources: DataFrame, hotspot_paths: DataFrame) -> DataFrame:
    spots = hotspot_paths.select("repo_id", "path", F.lit(True).alias("is_hotspot")).distinct()
    return sources.join(spots, ["repo_id", "path"], "left").fillna(False, ["is_hotspot"])


def test_gaps(files: DataFrame, hotspot_paths: DataFrame) -> DataFrame:
    gaps = flag_hotspots(untested_sources(files), hotspot_paths)
    hot = F.col("is_hotspot")
    return debt_items(
        gaps, "test_debt", category="test_debt", kind="missing_tests",
        severity=F.when(hot, "high").otherwise("medium"),
        hours=F.when(hot, 4.0).otherwise(2.0), impact=F.when(hot, "high").otherwise("medium"),
        trust=confidence("test_debt"), fixed_rate=C.TEST_GAP_RATE,
        detail=F.when(hot, "hotspot_without_tests").otherwise("source_without_tests"))


test_gaps.__test__ = False  # not a test case
