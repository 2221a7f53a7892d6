"""Column functions over intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over hull; 0 if the hull is empty or an end is missing."""
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    present = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    overlap = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(present & (hull > 0), overlap / hull).otherwise(0.0)


def half_even(c: Column) -> Column:
    """Rounded to the nearest integer, ties to even, as bigint."""
    return F.bround(c, 0).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts alone, the same in every engine that has md5."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
