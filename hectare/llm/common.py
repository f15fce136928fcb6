"""Helpers the corpus operators share: staged tables, row keys and text columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import RUNTIME_SETTINGS, scratch_path

BLANK = r"[\x20\x09-\x0D]"
FILTER_BITS = 1 << 25


# whole texts travel in Arrow batches: a few thousand rows keep a worker's memory small
ARROW_ROWS = "2000"


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; workers started in another folder find this package as the driver does."""
    for key, value in {**RUNTIME_SETTINGS, "spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS}.items():
        spark.conf.set(key, value)
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing unfinished reads: all that was made from them is stored itself."""
    for frame in frames:
        sc = frame.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def with_row_key(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key per row. It is fixed only once the result is written, so stage the frame before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus)).cast("int")


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def _spread(key: Column | np.ndarray) -> Column | np.ndarray:
    """A bit number for a 64-bit key, the same in SQL and in numpy."""
    if isinstance(key, Column):
        return F.pmod(F.shiftrightunsigned(key, 20).bitwiseXOR(key), F.lit(FILTER_BITS))
    return ((key.view(np.uint64) >> np.uint64(20)).view(np.int64) ^ key) % FILTER_BITS


class KeyBits:
    """A bitmap of fixed size (four megabytes), broadcast: true for every key it was made from and false for most others.

    Its size does not depend on the number of keys; with very many it lets all through and saves nothing. A join must follow.
    """

    def __init__(self, shared):
        self.shared = shared

    def among(self, keys: np.ndarray) -> np.ndarray:
        return self.at(_spread(keys))

    def at(self, bits: np.ndarray) -> np.ndarray:
        return (self.shared.value[bits >> 6] >> (bits & 63)) & 1 == 1


def key_bits(keys: DataFrame, column: str) -> KeyBits:
    """The bitmap of a column of 64-bit keys; at most FILTER_BITS / 64 numbers come to the driver."""
    rows = keys.select(_spread(F.col(column)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return KeyBits(keys.sparkSession.sparkContext.broadcast(words))


def release(*bits: KeyBits) -> None:
    """Free bitmaps that nothing unfinished reads."""
    for one in bits:
        one.shared.destroy()


def key_filter(keys: DataFrame, column: str) -> Callable[[str], Column]:
    """A test on a column of 64-bit keys: true for every key of ``keys``. What it rejects is surely not among them."""
    bits = key_bits(keys, column)

    def test(at: pd.Series) -> pd.Series:
        return pd.Series(bits.at(at.to_numpy(np.int64)))

    may = F.pandas_udf(test, "boolean")
    return lambda name: may(_spread(F.col(name)))


def rows_among(df: DataFrame, keys: DataFrame | KeyBits, column: str, among: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` (64-bit key) can be among ``keys``, or surely is not: for frames that are mostly texts, whose rows
    the filter above would hold back while it waits for Python."""
    bits, at = keys if isinstance(keys, KeyBits) else key_bits(keys, column), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.among(batch.column(at).to_numpy()) == among))

    return df.mapInArrow(run, df.schema)
