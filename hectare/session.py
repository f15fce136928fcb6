"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings the jobs rely on; anything else is left to the cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(cpus: str | int = "*", app: str = "hectare", **settings: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass the session spark-submit gives you."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {
        **RUNTIME_SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **settings,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# folders of local applications without a configured one; the session cannot be given the setting once it runs
_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one of this local application (local mode only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _OWN_FOLDERS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def importable(spark: SparkSession) -> None:
    """Workers started in another folder find this package as the driver does."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def stored(df: DataFrame, label: str, by: str | None = None, seen: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """``df`` written once to the shared folder and read back: lineage ends here and survives lost executors.

    ``by`` partitions the files; ``seen`` names totals that are taken while the table is written.
    """
    path = scratch_path(df.sparkSession, label)
    watch = Observation()
    kept = df.observe(watch, *[c.alias(n) for n, c in seen.items()]) if seen else df
    (kept.write.partitionBy(by) if by else kept.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out, watch.get if seen else {}


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing unfinished reads."""
    for frame in frames:
        sc = frame.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
