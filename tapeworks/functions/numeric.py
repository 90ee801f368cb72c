"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value, or null for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


#: What counts as a number in text; suffixes such as 5d are accepted by a cast alone.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def parse_double(c: Column) -> Column:
    """Text to double, null where it is not a number throughout."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_float(c: Column, default: float | None = 0.0) -> Column:
    """Cast to double; anything that does not parse becomes ``default``."""
    parsed = parse_double(c)
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def whole(c: Column) -> Column:
    """Truncate towards zero."""
    return c.cast("bigint")


def floor_div(c: Column, width) -> Column:
    """Integral floor division, also below zero."""
    width = F.lit(width) if not isinstance(width, Column) else width
    return F.call_function("div", c - F.pmod(c, width), width)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]


def hash_uniform(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the given columns only.

    Unlike ``rand()`` it gives the same value when a lost task is run again.
    The first 52 bits of a digest make an exact double.
    """
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
