"""CSV, Parquet and keyed-JSON readers, table sinks and versioned paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import drop_members

# ---- fixed values ----
NULL_TOKENS = ["NULL", "null", ""]
# ---- end of fixed values ----


def read_table(spark: SparkSession, path: str | list[str], schema: str | T.StructType, require: list[str] = (), sep: str = ",") -> DataFrame:
    """Typed CSV with a header; rows null in a required column are dropped."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.dropna(subset=list(require)) if require else df


def read_lenient_csv(spark: SparkSession, path: str | list[str], sep: str = ",", nulls: list[str] = NULL_TOKENS,
                     encoding: str = "UTF-8") -> DataFrame:
    """All-text CSV: several null tokens, byte-order mark in the header, blanks around names, malformed bytes kept."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    return clean_text_columns(raw, nulls)


def clean_text_columns(raw: DataFrame, nulls: list[str] = NULL_TOKENS) -> DataFrame:
    """Null tokens to null; header names without byte-order mark and with single, numbered duplicates."""
    names, seen = [], {}
    for c in raw.columns:
        name = c.lstrip("﻿").strip()
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    renamed = raw.toDF(*names)
    return renamed.select(*[F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) for c in names])


def resolve_columns(df: DataFrame, wanted: dict[str, list[str | tuple[str, ...]]], required: list[str] = ()) -> DataFrame:
    """Canonical columns found by header text: per name, patterns in order; a tuple needs all its parts, a name that
    equals a pattern beats one that only contains it. Unfound columns are null unless required."""
    picked = []
    for name, patterns in wanted.items():
        found = None
        for p in patterns:
            parts = (p,) if isinstance(p, str) else p
            hits = [c for c in df.columns if c.strip() == p] or [c for c in df.columns if all(x in c for x in parts)]
            if hits:
                found = hits[0]
                break
        if found is None and name in required:
            raise ValueError(f"no column for {name}")
        picked.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*picked)


def pick_numeric_column(df: DataFrame, candidates: list[str], max_null_share: float = 0.5) -> str:
    """First candidate that is mostly numeric (all candidates measured in one pass), else the first."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("double").isNull().cast("int")).alias(c) for c in candidates]).first()
    good = [c for c in candidates if shares[c] is not None and shares[c] < max_null_share]
    return good[0] if good else candidates[0]


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Tolerant casts: what does not parse is null."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast(t) for c, t in kinds.items()})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """Newest version of a table that is there: the first path that exists."""
    for p in paths:
        if _exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_first_existing(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.options(**options).format(fmt).load(first_existing(spark, paths))


def latest_file(spark: SparkSession, pattern: str) -> str:
    """Greatest path name that matches a glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(pattern)
    return max(f.getPath().toString() for f in found)


def read_glob(spark: SparkSession, pattern: str, latest: bool = False, sep: str = ",", with_file: str | None = None) -> DataFrame:
    """All CSV files of a glob as one text table, or only the newest by name."""
    df = read_lenient_csv(spark, latest_file(spark, pattern) if latest else pattern, sep)
    return df.withColumn(with_file, F.input_file_name()) if with_file else df


def keyed_json(df: DataFrame, json_col: str, value_type: str, root: str | None = None, key: str = "key",
               keep: list[str] = ()) -> DataFrame:
    """JSON object of objects → one row per key, optionally below a dotted root."""
    text = F.get_json_object(json_col, f"$.{root}") if root else F.col(json_col)
    return df.select(*keep, F.explode(F.from_json(text, f"map<string,{value_type}>")).alias(key, "value")).select(
        *keep, key, "value.*" if value_type.startswith("struct") else "value")


def json_paths(df: DataFrame, json_col: str, paths: dict[str, tuple[str, str]], keep: list[str] = ()) -> DataFrame:
    """Named scalars out of a nested JSON text: name → (dotted path, type)."""
    return df.select(*keep, *[F.get_json_object(json_col, f"$.{p}").try_cast(t).alias(n) for n, (p, t) in paths.items()])


def write_csv(df: DataFrame, path: str, mark: bool = False, sep: str = ",") -> None:
    """CSV with header; ``mark`` puts a byte-order mark before the first header name (for spreadsheets)."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if mark else df
    out.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_version(table: DataFrame, new_rows: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Old rows plus those new rows whose key is not there yet; written as a new version if a path is given."""
    grown = table.unionByName(drop_members(new_rows, table, keys), allowMissingColumns=True)
    if path:
        grown.write.mode("errorifexists").parquet(path)
        return table.sparkSession.read.parquet(path)
    return grown


def save_params(params: dict[str, DataFrame], folder: str) -> None:
    """Fitted parameter tables, one Parquet table per name."""
    for name, table in params.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_params(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
