"""Repository paths and URLs."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears import constants as C


def _any_of(values) -> str:
    return "|".join(re.escape(v) for v in values)


def normalize_repo_path(path: Column) -> Column:
    """Posix form without leading ``.`` and ``/`` characters (``.github/x`` gives ``github/x``)."""
    collapsed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(?:\.?/)+", "/")
    return F.regexp_replace(collapsed, r"^[./]+", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_of(path: Column) -> Column:
    """Parent folder, ``.`` for files at the root."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", ".").otherwise(parent)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def python_module(path: Column) -> Column:
    """Dotted module name; a package is named by its folder."""
    dotted = F.replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name, null without a dot."""
    name = base_name(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def under_skip_dir(path: Column) -> Column:
    """A parent folder carries an excluded name."""
    return path.rlike(rf"(?:^|/)(?:{_any_of(C.SKIP_DIRS)})/")


def has_skip_part(path: Column) -> Column:
    """Any component, the file name included, carries an excluded name."""
    return path.rlike(rf"(?:^|/)(?:{_any_of(C.SKIP_DIRS)})(?:/|$)")


def mentions_skip_name(path: Column) -> Column:
    """An excluded name occurs anywhere in the text (``env`` also hits ``environment``)."""
    return path.rlike(_any_of(C.SKIP_DIRS))


def is_skipped_file(path: Column) -> Column:
    """A pattern with an asterisk is an ending of the name, one without occurs anywhere in it."""
    name = base_name(path)
    endings = [p.lstrip("*") for p in C.SKIP_FILE_PATTERNS if p.startswith("*")]
    parts = [p for p in C.SKIP_FILE_PATTERNS if not p.startswith("*")]
    return name.rlike(rf"(?:{_any_of(endings)})$|{_any_of(parts)}")


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    in_dir = low.rlike(rf"(?:^|/)(?:{_any_of(C.TEST_DIRS)})(?:/|$)")
    return in_dir | base_name(low).rlike(_any_of(C.TEST_NAME_PARTS))


def is_source_path(path: Column) -> Column:
    suffix = F.lower(base_name(path)).rlike(rf".(?:{_any_of(C.SOURCE_SUFFIXES)})$")
    return suffix & ~is_test_path(path)


def clean_path(path: Column) -> Column:
    """Path as shown to people: no clone prefix, no line suffix."""
    bare = F.regexp_replace(path, r"^/tmp/repos/[^/]+/", "")
    return F.regexp_replace(bare, r":\?$|:\d+$", "")


def truncate(text: Column, limit: int, keep: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(tail))
                  ).otherwise(text)


def title_label(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


# --- URLs -----------------------------------------------------------------------------------------

def _bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"/+$", "")


def normalize_url(url: Column) -> Column:
    """Full https address of a repository; other hosts stay as they are."""
    bare = _bare_url(url)
    return (F.when(bare.startswith("https://github.com/"), bare)
            .when(bare.startswith("http://github.com/"),
                  F.replace(bare, F.lit("http://"), F.lit("https://")))
            .when(bare.startswith("github.com/"), F.concat(F.lit("https://"), bare))
            .when(~bare.startswith("http"), F.concat(F.lit("https://github.com/"), bare))
            .otherwise(bare))


def url_owner(url: Column) -> Column:
    parts = F.split(normalize_url(url), "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("unknown")


def url_name(url: Column) -> Column:
    return F.try_element_at(F.split(normalize_url(url), "/"), F.lit(-1))


def repo_key(url: Column) -> Column:
    """``owner/name`` of a repository address."""
    bare = F.regexp_replace(_bare_url(url), r"^(?:https://|http://|)github\.com/", "")
    parts = F.split(F.regexp_replace(bare, r"^/+", ""), "/")
    return F.when(F.size(parts) >= 2,
                  F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(bare)
