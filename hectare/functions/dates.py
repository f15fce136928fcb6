"""Quarter, month and elapsed-time keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def quarter_id(ts) -> Column:
    """``year * 10 + quarter`` from a date or timestamp."""
    return F.year(col(ts)) * 10 + F.quarter(col(ts))


def quarter_id_from_text(text) -> Column:
    """Quarter key from ISO text; text too short or malformed gives null."""
    t = col(text)
    year = F.substring(t, 1, 4).try_cast("int")
    month = F.substring(t, 6, 2).try_cast("int")
    return F.when(
        (F.length(t) >= 7) & month.between(1, 12), year * 10 + F.floor((month - 1) / 3).cast("int") + 1
    )


def repair_quarter_id(qid, year, quarter) -> Column:
    """Ids from 40000 up were built from a full id in the quarter column; rebuild them from the year."""
    q = col(qid)
    return F.when(q >= 40000, col(year) * 10 + col(quarter) % 10).otherwise(q)


def dense_quarter(ts, base_year: int) -> Column:
    """Consecutive quarter number, so ``+ 1`` is always the next calendar quarter."""
    return (F.year(col(ts)) - base_year) * 4 + F.quarter(col(ts)) - 1


def quarter_label(qid) -> Column:
    q = col(qid)
    return F.concat(F.lit("Q"), (q % 10).cast("string"), F.lit(" "), F.floor(q / 10).cast("int").cast("string"))


def month_start(ts) -> Column:
    return F.trunc(col(ts), "MM")


def cyclic(value, period: int) -> tuple[Column, Column]:
    """(sin, cos) of one turn per ``period``."""
    angle = col(value) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def years_between(later, earlier, lo: float | None = None, hi: float | None = None) -> Column:
    years = F.datediff(col(later), col(earlier)) / F.lit(365.25)
    return clip(years, lo, hi)


def clip(value, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` alone would skip it)."""
    v = col(value)
    bounded = v
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    return F.when(v.isNotNull(), bounded)
