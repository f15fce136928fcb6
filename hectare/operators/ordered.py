"""Scans of a total order that is spread over tasks, with the last row of each stretch handed on.

Rows are dealt by ranges of (key, order), so a key with a third of all rows, or a million rows of one instant, runs in many tasks. Each row looks
back within its stretch; the first row of a stretch takes its predecessor from the table of last rows, one per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def stretches(df: DataFrame, columns: list[str], part: str = "_part") -> DataFrame:
    """``df`` dealt by ranges of ``columns`` (nulls first) with the number of the range as ``part``, stored: numbers rise with the order."""
    return stored(df.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()), "stretches")[0]


def previous_row(df: DataFrame, key: str, order: list[str], row: Column, out: str) -> DataFrame:
    """Attach ``row`` of the row before in the order of (key, ``order``) as the struct ``out``; null for the first row of a key.

    ``order`` should be unique within a key: rows that agree in it are dealt together and follow each other in any order. Rows
    with a null key have no predecessor.
    """
    columns = [key, *order]
    rows = stretches(df, columns)
    here = F.struct(F.col(key).alias("key"), row.alias("row"))
    last = rows.groupBy("_part").agg(F.max_by(here, F.struct(*columns)).alias("_last"))
    # one row per stretch
    carried = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    before = F.lag(here).over(Window.partitionBy("_part").orderBy(*columns))
    found = rows.withColumn("_before", before).join(carried, "_part").withColumn("_before", F.coalesce("_before", "_carried"))
    return found.withColumn(out, F.when(F.col("_before.key") == F.col(key), F.col("_before.row"))).drop("_part", "_before", "_carried")
