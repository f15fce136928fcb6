"""Neighbours in a sorted order that is spread over range partitions, also across the partitions' borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def neighbours_in_order(df: DataFrame, keys: list[str], back: int, label: str) -> DataFrame:
    """Pairs of rows (structs one, other) that agree in ``keys[0]`` (long) and stand up to ``back`` rows apart in the order of ``keys``;
    ``one`` comes first.

    ``df`` is read twice (for the ranges and for the rows), so it should be stored. Equal keys may be split over partitions: no task gets
    all rows of a frequent key.
    """
    names = df.columns
    kinds = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rest = None, None
        for batch in batches:
            old = 0 if rest is None else rest.num_rows
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if head is None or head.num_rows < back:
                head = rows.slice(0, back)
            first = rows.column(names.index(keys[0])).to_numpy()
            here, there = [], []
            for k in range(1, back + 1):
                at = np.arange(max(k, old), len(first))
                at = at[first[at] == first[at - k]]
                here.append(at)
                there.append(at - k)
            here, there = pa.array(np.concatenate(here)), pa.array(np.concatenate(there))
            yield pairs(rows.take(there), rows.take(here), len(here))
            rest = rows.slice(max(0, rows.num_rows - back))
        if head is not None:
            # rows near a border may come twice; they are told apart by their keys later
            ends = pa.concat_batches([head, rest])
            yield pairs(ends, None, ends.num_rows)

    def pairs(one: pa.RecordBatch, other: pa.RecordBatch | None, n: int) -> pa.RecordBatch:
        kind = pa.struct(list(one.schema))
        second = pa.nulls(n, kind) if other is None else pa.StructArray.from_arrays(other.columns, fields=list(other.schema))
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(one.columns, fields=list(one.schema)), second], names=["one", "other"])

    found = staged(ordered.mapInArrow(run, f"one struct<{kinds}>, other struct<{kinds}>"), label)
    inside = found.where("other IS NOT NULL")
    # a few rows per partition
    ends = found.where("other IS NULL").select("one.*").distinct()
    near = Window.partitionBy(keys[0]).orderBy(*keys[1:])
    row = F.struct(*names)
    across = ends.select(row.alias("other"), F.array(*[F.lag(row, k).over(near) for k in range(1, back + 1)]).alias("before"))
    across = across.select(F.explode("before").alias("one"), "other").where("one IS NOT NULL")
    return inside.unionByName(across.select("one", "other"))
