"""Growing stored tables by landed rows and new periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import extend_panel, unseen_periods
from ..operators.quantiles import group_agg
from ..sources.tables import append_version


def append_since(table: DataFrame, landed: DataFrame, ts: str, keys: list[str], enrich=None, path: str | None = None) -> DataFrame:
    """Add landed rows from the table's latest instant on; ``enrich`` maps them to the table's columns.

    Rows of that very instant may have been landed in part, so they are looked at again; keys that are stored already are
    dropped, and running it twice adds nothing. Rows that arrive later with an older instant are not taken (``panel_store``
    takes late and corrected rows); all rows of an empty table are.
    """
    mark = table.agg(F.max(ts)).scalar()
    fresh = landed.filter((F.col(ts) >= mark) | mark.isNull())
    return append_version(table, enrich(fresh) if enrich else fresh, keys, path)


def extend_quarters(panel: DataFrame, deals: DataFrame, keys: list[str], period: str, min_n: int, count: str, district: str,
                    template: list[str], price: str, low: float = 500, high: float = 50_000) -> DataFrame:
    """Append periods the panel does not hold, with each district's latest template values.

    Count and median ``price`` per key and period come from the raw deals whose price is between ``low`` and ``high``; cells
    of less than ``min_n`` deals are left out. Null prices are outside.
    """
    usable = unseen_periods(deals, panel, period).filter(F.col(price).between(low, high))
    fresh = group_agg(usable, [*keys, period], [F.count(F.lit(1)).alias(count)], {price: (price, 0.5)})
    return extend_panel(panel, fresh.filter(F.col(count) >= min_n), district, period, template)
