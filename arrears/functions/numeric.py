"""Rounding rules shared by every money, hour and ratio column."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(value: Column, digits: int) -> Column:
    """Round half-up to ``digits``; the detour over an 8-digit decimal removes binary noise."""
    return F.round(value.cast("decimal(38,8)"), digits).cast(f"decimal(18,{digits})")


def cents(value: Column) -> Column:
    """Amount rounded to two places, exact to sum in any order."""
    return places(value, 2)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant-table lookup; absent keys give ``default``. The table is one folded map literal."""
    entries = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, 0 for an empty whole."""
    ratio = part.cast("double") / whole.cast("double") * 100
    return places(F.when(whole != 0, ratio).otherwise(F.lit(0.0)), digits)
