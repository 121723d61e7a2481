"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def days(earlier: Column, later: Column) -> Column:
    """Whole days from one time to another, rounded down, also below zero."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_US))).cast("long")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(float(otherwise)))


def r6(c: Column) -> Column:
    """Rounded to six places, where engines agree."""
    return F.round(c.cast("double"), 6)


def any_of(c: Column, words) -> Column:
    """Whether the text holds any of the words as a substring; false for null."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return F.coalesce(hit, F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
