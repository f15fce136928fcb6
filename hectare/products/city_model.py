"""The city model as one stored pipeline: look-ups around a place, encodings, lags, own history, score and stack.

Every step is a fitted transformer that holds its settings (JSON) and its tables (Parquet, the point indexes included) and is stored with
them; a ``PipelineModel`` of such steps is saved, loaded on another session and applied to any table of subjects without the sales it
was fitted on.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import one_row
from ..operators import encode, features, model, spatial
from ..operators.quantiles import group_agg, join_groups
from ..session import stored


class FittedWriter(MLWriter):
    def __init__(self, step: Fitted):
        super().__init__()
        self.step = step

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.step, path, self.sparkSession, extraMetadata={"settings": json.dumps(self.step.settings), "tables": sorted(self.step.tables)})
        for name, table in self.step.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        self.step.store_more(f"{path}/more")


class FittedReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Fitted:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        step = self.kind(json.loads(about["settings"]), {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in about["tables"]})
        step.load_more(self.sparkSession, f"{path}/more")
        return step


class Fitted(Transformer, MLWritable, MLReadable):
    """A fitted step; its kinds say what it does in ``_transform``."""

    def __init__(self, settings: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.settings, self.tables = settings or {}, tables or {}

    def write(self) -> MLWriter:
        return FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return FittedReader(cls)

    def store_more(self, folder: str) -> None:
        """What is neither settings nor tables."""

    def load_more(self, spark, folder: str) -> None:
        """The way back."""


def _index_parts(index: spatial.PointIndex) -> tuple[dict, dict[str, DataFrame]]:
    about = {"names": index.names, "p_id": index.p_id, "cols": index.cols, "keep": index.keep, "grid": index.grid and vars(index.grid)}
    return about, {"spots": index.empty} if index.grid is None else {f"level_{n}": table for n, table in index.levels.items()}


def _index_of(about: dict, tables: dict[str, DataFrame]) -> spatial.PointIndex:
    grid = about["grid"] and spatial.Grid(**about["grid"])
    levels = {int(name.split("_")[1]): table for name, table in tables.items() if name.startswith("level_")}
    return spatial.PointIndex(grid, levels, about["names"], about["p_id"], about["cols"], about["keep"], tables.get("spots"))


class Surroundings(Fitted):
    """Distances (and their logs) to the nearest place of each kind and numbers of places in the radius; the nearest sale's columns."""

    @classmethod
    def of(cls, index: spatial.PointIndex, distances: dict[str, str] | None = None, counts: dict[str, str] | None = None, radius_m: float = 0.0,
           nearest: str | None = None) -> Surroundings:
        about, tables = _index_parts(index)
        return cls({"index": about, "distances": distances or {}, "counts": counts or {}, "radius_m": radius_m, "nearest": nearest}, tables)

    def _transform(self, df: DataFrame) -> DataFrame:
        s, index, at = self.settings, _index_of(self.settings["index"], self.tables), spatial.query_places(df)
        if s["distances"]:
            df = spatial.nearest_strata(df, index, s["distances"], log=True, places=at)
        if s["nearest"]:
            df = spatial.nearest_attrs(df, index, s["index"]["cols"], s["nearest"], places=at)
        if s["counts"]:
            df = spatial.count_within(df, index, s["radius_m"], s["counts"], metric="flat", places=at)
        return df


class Looked(Fitted):
    """Columns of a fitted table by its keys (null keys match); where they are null, a fallback column or a constant."""

    @classmethod
    def of(cls, table: DataFrame, keys: list[str], fallback: dict, derive: dict[str, str] | None = None) -> Looked:
        return cls({"keys": keys, "fallback": fallback, "derive": derive or {}}, {"table": table})

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        for name, rule in s["derive"].items():
            df = df.withColumn(name, F.expr(rule))
        out = join_groups(df, self.tables["table"], s["keys"])
        filled = {c: F.coalesce(F.col(c), F.col(v) if isinstance(v, str) else F.lit(v)) for c, v in s["fallback"].items() if v is not None}
        return out.withColumns(filled).drop(*s["derive"])


class Walk(Fitted):
    """The walk score by the fitted ends of its parts."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return features.apply_score(df, self.tables["ends"], _walk(self.settings["kinds"]), features.WALK_WEIGHTS, "walk_score")


class Stack(Fitted):
    """A fitted stack: adds ``log_prediction``."""

    fitted: dict | None = None

    @classmethod
    def of(cls, fitted: dict) -> Stack:
        step = cls()
        step.fitted = fitted
        return step

    def store_more(self, folder: str) -> None:
        from pyspark.sql import SparkSession

        model.save_stack(SparkSession.active(), self.fitted, folder)

    def load_more(self, spark, folder: str) -> None:
        self.fitted = model.load_stack(spark, folder)

    def _transform(self, df: DataFrame) -> DataFrame:
        inputs = df.withColumns({c: F.col(c).cast("double") for c in self.fitted["features"]})
        return model.predict_stack(inputs, self.fitted, "_price").withColumn("log_prediction", F.log1p("_price")).drop("_price")


def _walk(kinds: list[str]) -> dict[str, Column]:
    first, second, third = (f"dist_{k.lower()}_m" for k in kinds[:3])
    return features.walk_parts(first, second, f"{kinds[0]}_count", third, "nearest_sale_m", 1.0)


def fit_city_features(work: DataFrame, places: DataFrame, kind: str, kinds: list[str], as_of: int, radius_m: float = 2000, comps_m: float = 800,
                      price: str = "price", scale_on: DataFrame | None = None) -> PipelineModel:
    """The feature steps, fitted on past sales ``work`` (id, lat, lon, region, kind, parcel, dq, area, price) and ``places``.

    Subjects need id (of their parcel), lat, lon and kind. They get the distance, log distance and number in the radius of each kind of
    place; the region of the nearest past sale, with its encoded price, that of region and first letter of the kind, and its mean price a
    year before quarter ``as_of`` (the median region's where it had no sale then); the number of comparable sales; past sales of the own
    parcel and their mean area (0 and null where there are none); with ``scale_on``, a walk score by the ends it takes over those subjects.
    """
    near = spatial.index_points(places, {k: F.col(kind) == k for k in kinds})
    sold = spatial.index_points(work.select(F.col("id").alias("sale_id"), "lat", "lon", "region"), {"comps": F.lit(True)}, p_id="sale_id", cols=["region"])
    rows, lp = work.withColumn("letter", F.substring("kind", 1, 1)), F.log1p(price)
    # tables are computed once: sums of doubles differ in the last digits from run to run, and a fitted model must not
    fixed = lambda table: stored(table, "fitted")[0]
    before = fixed(work.filter(F.col("dq") == as_of - 4).groupBy("region").agg(F.avg(price).alias("price_lag4")))
    own = fixed(work.groupBy(F.col("parcel").alias("id")).agg(F.count(F.lit(1)).alias("own_sales"), F.avg("area").alias("own_area")))
    usual = work.agg(F.avg(lp).alias("overall")).withColumn("lag", one_row(group_agg(before, [], [], {"m": ("price_lag4", 0.5)}))["m"]).first()
    mean = lambda keys, name: fixed(encode.fit_target_encoding(rows, keys, lp).withColumnRenamed("encoded", name))
    steps = [
        Surroundings.of(near, {f"dist_{k.lower()}_m": k for k in kinds}, {f"{k}_count": k for k in kinds}, radius_m),
        Surroundings.of(sold, None, {"comps": "comps"}, comps_m, "nearest_sale_m"),
        Looked.of(mean(["region"], "region_encoded"), ["region"], {"region_encoded": usual["overall"]}),
        Looked.of(mean(["region", "letter"], "mix_encoded"), ["region", "letter"], {"mix_encoded": "region_encoded"}, {"letter": "substring(kind, 1, 1)"}),
        Looked.of(before, ["region"], {"price_lag4": usual["lag"]}),
        Looked.of(own, ["id"], {"own_sales": 0}),
    ]
    if scale_on is not None:
        scaled, _ = stored(PipelineModel(steps[:2]).transform(scale_on), "walk-subjects")
        steps.append(Walk({"kinds": kinds}, {"ends": fixed(features.fit_score(scaled, _walk(kinds)))}))
    return PipelineModel(steps)


def store_model(pipeline: PipelineModel, folder: str) -> PipelineModel:
    """Save to a new folder and load from it: what is returned reads nothing but the folder."""
    pipeline.write().save(folder)
    return PipelineModel.load(folder)
