"""Figures, tokens and version specs in free text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears import constants as C

REQUIREMENT = r"^\s*([A-Za-z0-9_.\-]+)\s*(.*)$"


def _figures(text: Column, pattern: str) -> Column:
    """All group-1 numbers of a pattern, thousands separators dropped, as doubles."""
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(raw, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))


def _within(values: Column, low: float, high: float) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v >= low) & (v <= high))


def dollar_figures(text: Column) -> Column:
    """Dollar amounts between 100 and 10,000."""
    return _within(_figures(text, C.DOLLAR_FIGURE), *C.DOLLAR_RANGE)


def day_figures(text: Column) -> Column:
    return _within(_figures(text, C.DAY_FIGURE), 0, float("inf"))


def percent_figures(text: Column, low: float, high: float) -> Column:
    return _within(_figures(text, C.PERCENT_FIGURE), low, high)


def million_figures(text: Column) -> Column:
    """Amounts stated in millions (1 to 20), in units."""
    found = _within(_figures(text, C.MILLION_FIGURE), *C.MILLION_RANGE)
    return F.transform(found, lambda v: v * 1_000_000)


def hourly_figures(text: Column) -> Column:
    """Hourly pay between 20 and 300 from hourly, thousands-per-year and yearly mentions."""
    hourly = _figures(text, C.HOURLY_FIGURE)
    thousands = _figures(text, C.THOUSANDS_FIGURE)
    yearly = _figures(text, C.YEARLY_FIGURE)
    per_hour = F.concat(
        hourly,
        F.transform(thousands, lambda v: F.when(v < 1000, v * 1000).otherwise(v) / C.HOURS_PER_YEAR),
        F.transform(yearly, lambda v: v / C.HOURS_PER_YEAR))
    return _within(per_hour, *C.HOURLY_RANGE)


def identifier_tokens(text: Column) -> Column:
    """Whole words that are ASCII identifiers; a word with other letters or a leading digit is none."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"))


def generic_share(text: Column) -> Column:
    """Share of identifier tokens that are generic names; 0 without tokens."""
    tokens = identifier_tokens(text)
    total = F.size(tokens)
    generic = F.size(F.filter(tokens, lambda w: w.isin(*C.GENERIC_NAMES)))
    return F.when(total > 0, generic.cast("double") / total).otherwise(F.lit(0.0))


def requirement_name(line: Column) -> Column:
    return F.regexp_extract(line, REQUIREMENT, 1)


def requirement_spec(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, REQUIREMENT, 2))


def pip_issue(spec: Column) -> Column:
    """Loose-pin class of a pip version spec, null when pinned."""
    return (F.when(spec == "", "unbounded_version")
            .when(F.contains(spec, F.lit("*")) | F.contains(spec, F.lit("latest")),
                  "wildcard_version")
            .when(spec.rlike(r"^(?:>=|~=|>|<|\^)") & ~F.contains(spec, F.lit("==")),
                  "range_pinned_version"))


def npm_issue(spec: Column) -> Column:
    return (F.when(spec.isin("latest", "*"), "wildcard_version")
            .when(spec.rlike(r"^[\^~><]"), "range_pinned_version"))


def issue_severity(issue: Column) -> Column:
    return F.when(issue == "wildcard_version", "high").when(issue.isNotNull(), "medium")


def money_text(amount: Column) -> Column:
    """``$1,234``"""
    return F.concat(F.lit("$"), F.format_number(F.round(amount.cast("decimal(28,8)"), 0), 0))


def fixed_text(value: Column, digits: int) -> Column:
    """Plain number text with a fixed number of places, no separators."""
    if digits == 0:
        return F.round(value.cast("decimal(28,8)"), 0).cast("decimal(28,0)").cast("string")
    return F.round(value.cast("decimal(28,8)"), digits).cast(f"decimal(28,{digits})").cast("string")


def percent_text(share: Column) -> Column:
    return F.concat(fixed_text(share.cast("double") * 100, 0), F.lit("%"))
