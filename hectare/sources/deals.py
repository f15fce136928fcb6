"""Landed transaction records, raw deed tables and listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import listing_id, parse_listing_text
from ..operators.clean import plausible_listings

# ---- fixed values: field names of the landed records and of the embedded listing document ----
TX_RECORD = ("struct<neighborhoodId:string,neighborhood:string,provinceName:string,transactionDate:string,"
             "transactionPrice:double,priceOfMeter:double,totalArea:double,propertyType:string,landUseGroup:string,"
             "parcelNo:string,blockNo:string,transactionNumber:string>")
TX_COLUMNS = {
    "nh_id": "neighborhoodId", "district_ar": "neighborhood", "province_name": "provinceName", "price_sar": "transactionPrice",
    "psqm": "priceOfMeter", "area_sqm": "totalArea", "property_type": "propertyType", "land_use": "landUseGroup",
    "parcel_no": "parcelNo", "block_no": "blockNo", "tx_number": "transactionNumber",
}
LISTING_SCRIPT = r'(?s)<script[^>]*id="json-ld-posts-list"[^>]*>(.*?)</script>'
LISTING_DOC = ("struct<mainEntity:struct<itemListElement:array<struct<item:struct<`@type`:string,"
               "address:struct<addressLocality:string>,url:string,description:string,datePosted:string>>>>>")
LISTING_TYPE = "RealEstateListing"
RIYADH = "الرياض"
# ---- end of fixed values ----


def parse_transactions(df: DataFrame, json_col: str, many: bool = False) -> DataFrame:
    """Flat deal rows from API records (one object per row, or an array with ``many``); only rows with a unit price."""
    if many:
        rows = df.select(F.explode(F.from_json(json_col, f"array<{TX_RECORD}>")).alias("t"))
    else:
        rows = df.select(F.from_json(json_col, TX_RECORD).alias("t"))
    flat = rows.select(*[F.col(f"t.{s}").alias(n) for n, s in TX_COLUMNS.items()],
                       F.substring(F.coalesce(F.col("t.transactionDate"), F.lit("")), 1, 10).alias("date"))
    return flat.filter(F.col("psqm") > 0)


def listings_from_pages(pages: DataFrame, html: str, type_hint: str | None = None, locality: str | None = RIYADH,
                        source: str = "web", keep: list[str] = ()) -> DataFrame:
    """Listing rows from the JSON-LD list embedded in each page; implausible or incomplete listings are dropped.

    A type the text does not give, or gives as unknown, takes the page's hint column.
    """
    doc = F.from_json(F.regexp_extract(html, LISTING_SCRIPT, 1), LISTING_DOC)
    hint = F.col(type_hint) if type_hint else F.lit(None).cast("string")
    items = pages.select(*keep, hint.alias("_hint"), F.explode(doc["mainEntity"]["itemListElement"]).alias("e")).select(*keep, "_hint", "e.item.*")
    items = items.filter(F.col("@type") == LISTING_TYPE)
    if locality:
        items = items.filter(F.col("address.addressLocality") == locality)
    rows = parse_listing_text(items, "description").filter((F.col("price_sar") > 0) & (F.col("area_sqm") > 0))
    rows = rows.withColumn("_kind", F.coalesce("property_type_en", "_hint"))
    rows = plausible_listings(rows, "price_sar", "area_sqm", "_kind")
    return rows.select(
        *keep, F.lit(source).alias("source"), listing_id("url").alias("listing_id"), F.coalesce("district", F.lit("")).alias("district"),
        "lat", "lon", F.coalesce("property_type_ar", F.lit("")).alias("property_type_ar"),
        F.when(F.col("_kind") == "other", F.col("_hint")).otherwise(F.col("_kind")).alias("property_type_en"),
        "price_sar", "area_sqm", F.bround(F.col("price_sar") / F.col("area_sqm"), 2).alias("price_per_sqm"),
        "bedrooms", "bathrooms", "age_years", F.nullif(F.substring("datePosted", 1, 10), F.lit("")).alias("listing_date"), "url")
