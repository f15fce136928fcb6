"""Map layers, area pages and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.aggregates import median_by, monthly_trend
from ..operators.quantiles import group_agg
from ..operators.ranking import stratified_sample, top_per_key
from ..sources.places import geojson_lines, point_geometry, polygon_geometry

# ---- fixed values: windows and sizes of the area page ----
COMP_DAYS, TREND_DAYS = 548, 730
MIN_COMP_PRICE = 100_000
# ---- end of fixed values ----


def region_layer(sales: DataFrame, regions: DataFrame, key: str, columns: list[str], code: str = "code") -> DataFrame:
    """Polygons with the region's medians, one feature text per row; regions without sales keep empty properties."""
    stats = median_by(sales, [key], columns).withColumnRenamed(key, "_key")
    joined = regions.join(stats, regions[code] == stats["_key"], "left")
    props = {"code": F.col(code), "n_rows": F.col("n_rows"), **{c: F.round(f"{c}_median", 2) for c in columns}}
    return geojson_lines(joined, polygon_geometry("parts"), props)


def district_layer(sales: DataFrame, centroids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """District points with medians, one feature text per row."""
    stats = median_by(sales, [key], columns).withColumnRenamed(key, "district")
    return geojson_lines(stats.join(centroids, "district"), point_geometry("lat", "lon"),
                         {"district": F.col("district"), "n_rows": F.col("n_rows"), **{c: F.round(f"{c}_median", 2) for c in columns}})


def listings_layer(listings: DataFrame, lat: str, lon: str, inside: Column, psqm: str, props: dict[str, Column]) -> DataFrame:
    """Listings inside the study area with a positive unit price, one feature text per row."""
    return geojson_lines(listings.filter(inside & (F.col(psqm) > 0)), point_geometry(lat, lon), props)


def recent_sales(sales: DataFrame, as_of: Column, ts: str, price: str, sqft: str) -> DataFrame:
    """All comparable sales of the last 18 months with price per square foot."""
    recent = sales.filter((F.to_date(ts) >= F.date_sub(as_of, COMP_DAYS)) & (F.col(price) > MIN_COMP_PRICE))
    return recent.withColumn("psf", F.when(F.col(sqft) > 0, F.bround(F.col(price) / F.col(sqft))))


def area_comps(recent: DataFrame, area_key: str, ts: str, ids: list[str], n: int = 5) -> DataFrame:
    """Per area the ``n`` newest of the recent sales, numbered."""
    return top_per_key(recent, [area_key], [F.desc(ts), *ids], n, rank="rank")


def area_summary(recent: DataFrame, area_key: str, price: str) -> DataFrame:
    """Per area over all recent sales: their number, median price and median price per square foot (whole units)."""
    s = group_agg(recent, [area_key], [F.count(F.lit(1)).alias("n_comps")], {"median_price": (price, 0.5), "median_psf": ("psf", 0.5)})
    return s.withColumns({c: F.col(c).cast("bigint") for c in ("median_price", "median_psf")})


def area_trend(sales: DataFrame, area_key: str, as_of: Column, ts: str, price: str, sqft: str) -> DataFrame:
    """Monthly medians over the last 24 months; months with one sale are left out."""
    window = sales.filter((F.to_date(ts) >= F.date_sub(as_of, TREND_DAYS)) & (F.col(price) > MIN_COMP_PRICE) & (F.col(sqft) > 0))
    return monthly_trend(window, [area_key], ts, price)


def quality_report(df: DataFrame, actual: str, predicted: str, segments: dict[str, Column], stratum: str, ids: list[str],
                   n: int = 400) -> tuple[DataFrame, DataFrame]:
    """(metrics per segment, sample of predicted against actual with the error in percent, at most n per stratum)."""
    table = evaluate.segment_metrics(df, actual, predicted, segments)
    sample = stratified_sample(df, [stratum], ids, n)
    return table, sample.withColumn("error_pct", (F.col(predicted) / F.col(actual) - 1) * 100)
