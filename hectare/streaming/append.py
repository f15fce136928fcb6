"""Incremental append as a stream over a landing folder.

Each trigger takes the files that arrived since the last one. A batch is written under its own batch number, so a batch
that is retried after a lost executor or driver replaces itself instead of adding rows twice. The table is partitioned by
a hash of the key, and a batch reads only the partitions its own keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import drop_members
from ..operators.ranking import dedup
from ..sources.tables import first_existing

BUCKETS = 256


def append_stream(spark: SparkSession, landing: str, schema, table: str, checkpoint: str, keys: list[str], order: list,
                  enrich: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet", max_files: int | None = None,
                  buckets: int = BUCKETS):
    """Start appending new files of ``landing`` to the Parquet table; stops when all files present are done.

    Rows whose key the table holds already, or that repeat within a batch, are dropped. ``buckets`` must stay the same for
    a table. Returns the streaming query.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    landed = reader.load(landing)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        rows = dedup(enrich(batch) if enrich else batch, keys, order).withColumn("bucket", bucket)
        if number:
            # at most ``buckets`` numbers; they become a partition filter of the scan
            wanted = [r.bucket for r in rows.select("bucket").distinct().collect()]
            stored = _stored(batch.sparkSession, table, number).filter(F.col("bucket").isin(wanted))
            rows = drop_members(rows, stored, ["bucket", *keys])
        # one file per bucket and batch
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")

    return landed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, table: str, number: int) -> DataFrame:
    """Rows of earlier batches; the batch being written is left out in case this is a retry."""
    first_existing(spark, [table])
    return spark.read.parquet(table).filter(f"batch < {number}").drop("batch")
