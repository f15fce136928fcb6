"""Versions of a stored pipeline: written aside, made current by one commit mark, and only if they are accepted.

``versions/<name>`` holds a pipeline and its metrics; ``commits/<number>`` is a small file that names the version which is current from
then on. A mark is created last and never overwritten, so a write that breaks, or two writers at once, change nothing: readers follow
the highest mark.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import accept_model


@dataclass
class Version:
    number: int
    folder: str
    metrics: DataFrame

    def load(self) -> PipelineModel:
        return PipelineModel.load(f"{self.folder}/pipeline")


class ModelStore:
    """A folder of versions; ``metric`` (higher is better) may fall by ``tolerance`` at most."""

    def __init__(self, spark: SparkSession, folder: str, metric: str = "r2_log", tolerance: float = 0.002):
        self.spark, self.folder, self.metric, self.tolerance = spark, folder.rstrip("/"), metric, tolerance

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        files, at = self._files(), self._path("commits")
        if not files.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())

    def version(self, number: int) -> Version:
        name = self.spark.read.text(f"{self.folder}/commits/{number}").first()[0]
        folder = f"{self.folder}/versions/{name}"
        return Version(number, folder, self.spark.read.parquet(f"{folder}/metrics"))

    def current(self) -> Version | None:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else None

    def write_aside(self, pipeline: PipelineModel, metrics: DataFrame) -> str:
        """Store a version that nobody reads yet; returns its name."""
        name = uuid.uuid4().hex
        metrics.write.parquet(f"{self.folder}/versions/{name}/metrics")
        pipeline.write().save(f"{self.folder}/versions/{name}/pipeline")
        return name

    def commit(self, name: str, after: int | None) -> int:
        """Make a version current, if the current one is still number ``after``."""
        numbers = self.numbers()
        if (numbers[-1] if numbers else None) != after:
            raise RuntimeError("another version became current meanwhile")
        number = (after or 0) + 1
        out = self._files().create(self._path(f"commits/{number}"), False)  # fails where the mark exists
        out.write(bytearray(name.encode()))
        out.close()
        return number

    def offer(self, pipeline: PipelineModel, metrics: DataFrame) -> tuple[bool, Version]:
        """Write a version and make it current if it is accepted; returns whether it was, and the version that is current now."""
        before = self.current()
        name = self.write_aside(pipeline, metrics)
        if before is not None:
            stored = self.spark.read.parquet(f"{self.folder}/versions/{name}/metrics")
            verdict = accept_model(before.metrics, stored, self.metric, self.tolerance).first()
            if not verdict["accepted"]:
                return False, before
        return True, self.version(self.commit(name, before and before.number))


def applied(store: ModelStore, df: DataFrame) -> DataFrame:
    """``df`` by the current version, with its number."""
    now = store.current()
    if now is None:
        raise LookupError("the store has no version")
    return now.load().transform(df).withColumn("model_version", F.lit(now.number))
