"""A price panel kept up to date from deliveries of new, late and corrected deals.

Deliveries are kept as a log: of a deal's versions the latest counts, whenever it arrives, so an older instant is taken like any other
and a repeated delivery changes nothing. The panel is held as counts per (group, quarter, price); a delivery takes its corrected
deals out of the counts and puts the new ones in, and only the quarters it touches are written again. Amounts are summed as decimals, so what
is taken out leaves no trace.

``data/<name>`` holds what a delivery wrote; ``commits/<number>`` is a small file that names it and the quarters it replaced. A mark is
created last and never overwritten, so a write that breaks, or two writers at once, change nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_id
from ..operators.quantiles import join_groups, quantiles_by_rank

AMOUNT = "decimal(38,6)"
# a delivery of so many rows at most has its ids broadcast
FEW_ROWS = 200_000
PRICES = {"median_psqm": 0.5, "p25_psqm": 0.25, "p75_psqm": 0.75}


def latest_versions(changes: DataFrame, ids: list[str], version: str) -> DataFrame:
    """One row per ``ids``: the one with the greatest version, of equal versions the one with the greatest other columns.

    Null ids are one deal; a null version is older than any other. Reduced in the map tasks before the shuffle.
    """
    rest = [version, *[c for c in changes.columns if c not in (*ids, version)]]
    return changes.groupBy(*ids).agg(F.max(F.struct(*rest)).alias("_row")).select(*ids, "_row.*").select(*changes.columns)


class PanelStore:
    """The stored log, counts and panel below ``folder``.

    ``ids`` name a deal, ``version`` orders what was said about it, ``deleted`` (a boolean column, if there is one) takes a deal out.
    ``keys`` are the panel's groups; unit prices ``value`` outside ``(lo, hi]`` and groups with fewer than ``min_n`` deals
    in a quarter are left out. The settings and the columns of the deliveries must stay the same for a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, ids: list[str], version: str, keys: list[str], ts: str, value: str, amount: str,
                 deleted: str | None = None, min_n: int = 3, lo: float = 100, hi: float = 100_000, digits: int = 2):
        self.spark, self.folder, self.ids, self.version, self.keys = spark, folder.rstrip("/"), ids, version, keys
        self.ts, self.value, self.amount, self.deleted = ts, value, amount, deleted
        self.min_n, self.lo, self.hi, self.digits = min_n, lo, hi, digits

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """Committed deliveries, oldest first: number, name, quarters."""
        files, at = self._files(), self._path("commits")
        if not files.exists(at):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())
        marks = {int(r.path.rsplit("/", 1)[1]): r.value for r in self.spark.read.text([f"{self.folder}/commits/{n}" for n in numbers]).select(
            F.col("_metadata.file_path").alias("path"), "value").collect()} if numbers else {}
        return [{"number": n, **json.loads(marks[n])} for n in numbers]

    def _parts(self, kind: str, commits: list[dict], quarters: set[int] | None = None) -> DataFrame | None:
        """The newest state of each quarter (of ``quarters``) of a table; one folder per quarter, so others are not read."""
        newest = {q: c["name"] for c in commits for q in c["quarters"] if quarters is None or q in quarters}
        files = self._files()
        paths = [p for q, name in sorted(newest.items()) if files.exists(self._path(p := f"data/{name}/{kind}/part={q}"))]
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else None

    def _log(self, commits: list[dict]) -> DataFrame | None:
        """All versions that were taken up; they are written once, beside the versions they replaced."""
        return self.spark.read.parquet(*[f"{self.folder}/data/{c['name']}/pairs" for c in commits]).select("after.*") if commits else None

    def deals(self) -> DataFrame:
        """The latest version of every deal that is not deleted."""
        log = self._log(self._known())
        rows = latest_versions(log, self.ids, self.version)
        return rows.filter(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else rows

    def panel(self) -> DataFrame:
        """The panel of all quarters, as ``aggregates.quarterly_panel`` gives it for ``deals()``."""
        commits = self._known()
        found = self._parts("panel", commits)
        if found is None:
            # deliveries without a usable deal: the columns without rows
            return self._panel_of(self._cells(self._log(commits).filter(F.lit(False)), F.lit(1)))
        return found

    def _known(self) -> list[dict]:
        commits = self.commits()
        if not commits:
            raise LookupError("the store has no delivery")
        return commits

    def _cells(self, deals: DataFrame, sign: Column) -> DataFrame:
        """Signed counts and amounts per (group, quarter, price)."""
        used = (F.col(self.value) > self.lo) & (F.col(self.value) <= self.hi) & F.col("quarter_id").isNotNull()
        if self.deleted:
            used = used & ~F.coalesce(F.col(self.deleted), F.lit(False))
        rows = deals.withColumn("quarter_id", quarter_id(self.ts)).filter(used)
        amount = F.coalesce(F.col(self.amount).cast(AMOUNT), F.lit(0).cast(AMOUNT))
        return rows.groupBy(*self.keys, "quarter_id", F.col(self.value).cast("double").alias("price")).agg(
            F.sum(sign).alias("n"), F.sum(amount * sign).cast(AMOUNT).alias("total"))

    def _panel_of(self, cells: DataFrame) -> DataFrame:
        by = [*self.keys, "quarter_id"]
        sums = cells.groupBy(*by).agg(F.sum("n").alias("deed_count"), F.sum("total").cast("double").alias("total_value"), (F.sum(F.col("price") * F.col("n")) / F.sum("n")).alias("mean_psqm"))
        prices = quantiles_by_rank(cells, by, [(F.col("price"), PRICES)], weight="n")
        return join_groups(sums, prices, by).filter(F.col("deed_count") >= self.min_n).select(
            *by, F.floor(F.col("quarter_id") / 10).cast("int").alias("sale_year"), (F.col("quarter_id") % 10).alias("sale_quarter"), "deed_count",
            *[F.round(c, self.digits).alias(c) for c in ("total_value", "median_psqm", "mean_psqm", "p25_psqm", "p75_psqm")])

    def _write(self, df: DataFrame, name: str, kind: str) -> None:
        df.withColumn("part", F.col("quarter_id")).write.partitionBy("part").parquet(f"{self.folder}/data/{name}/{kind}")

    def _pairs(self, delivery: DataFrame, log: DataFrame | None) -> DataFrame:
        """``after`` and ``before`` (null where there is none) of the delivery's deals that are new or newer than in the log.

        Delivery and log are dealt by the ids once, together. The log is cut down first only if the delivery's ids are few enough to be
        broadcast: a semi-join with more would deal the whole log by itself.
        """
        columns = delivery.columns
        both = delivery.withColumn("_known", F.lit(False))
        if log is not None:
            met = log.select(*columns)
            if delivery.select(F.lit(1)).limit(FEW_ROWS + 1).count() <= FEW_ROWS:
                met = join_groups(met, F.broadcast(delivery.select(*self.ids).distinct()), self.ids, "left_semi")
            both = both.unionByName(met.withColumn("_known", F.lit(True)))
        row = F.struct(self.version, *[c for c in columns if c not in (*self.ids, self.version)])
        latest = both.groupBy(*self.ids).agg(F.max(F.when(~F.col("_known"), row)).alias("_new"), F.max(F.when(F.col("_known"), row)).alias("_old"))
        new, old = F.col(f"_new.{self.version}"), F.col(f"_old.{self.version}")
        latest = latest.filter(F.col("_new").isNotNull() & (F.col("_old").isNull() | (new > old) | (old.isNull() & new.isNotNull())))
        whole = lambda side: F.when(F.col(side).isNotNull(), F.struct(*[F.col(c) if c in self.ids else F.col(f"{side}.{c}") for c in columns]))
        return latest.select(whole("_new").alias("after"), whole("_old").alias("before"))

    def take(self, delivery: DataFrame) -> int:
        """Take up a delivery; returns the number of the state that is current then (the same as before if nothing is new).

        Of a delivery, rows that repeat a deal count by their version; a version that is not above the stored one is ignored.
        What comes to the driver are the quarters that change.
        """
        commits = self.commits()
        name = uuid.uuid4().hex
        at = f"{self.folder}/data/{name}"
        self._pairs(delivery, self._log(commits)).write.parquet(f"{at}/pairs")
        pairs = self.spark.read.parquet(f"{at}/pairs")
        if pairs.isEmpty():
            return commits[-1]["number"] if commits else 0
        sides = F.array(F.struct(F.col("after").alias("_row"), F.lit(1).alias("_sign")), F.struct(F.col("before").alias("_row"), F.lit(-1).alias("_sign")))
        signed = pairs.select(F.explode(F.filter(sides, lambda s: s["_row"].isNotNull())).alias("_s")).select("_s._row.*", "_s._sign")
        delta = self._cells(signed, F.col("_sign"))
        delta.write.parquet(f"{at}/delta")
        delta = self.spark.read.parquet(f"{at}/delta")
        quarters = {r.quarter_id for r in delta.select("quarter_id").distinct().collect()}
        if quarters:
            old = self._parts("cells", commits, quarters)
            every = delta if old is None else delta.unionByName(old)
            cells = every.groupBy(*self.keys, "quarter_id", "price").agg(F.sum("n").alias("n"), F.sum("total").cast(AMOUNT).alias("total")).filter("n <> 0")
            self._write(cells, name, "cells")
            now = self._parts("cells", [{"name": name, "quarters": sorted(quarters)}])
            if now is not None:
                self._write(self._panel_of(now), name, "panel")
        return self._commit(name, sorted(quarters), commits[-1]["number"] if commits else 0)

    def _commit(self, name: str, quarters: list[int], after: int) -> int:
        out = self._files().create(self._path(f"commits/{after + 1}"), False)  # fails where the mark exists
        out.write(bytearray(json.dumps({"name": name, "quarters": quarters}).encode()))
        out.close()
        return after + 1
