"""Text normalisation, flags and listing-text fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import col

# ---- fixed values: characters, labels and units of the listing texts ----
TATWEEL_AND_HARAKAT = "[ـً-ٟ]"
ARABIC_LETTER = "[؀-ۿ]"
DISTRICT_PREFIX = "حي "
NEW_BUILD_WORDS = ["New", "new", "جديد", "جديدة"]
PRICE_UNITS = {"ألف": 1e3, "الف": 1e3, "مليون": 1e6, "مليار": 1e9}
BARE_PRICE_LIMIT = 50_000
LISTING_LABELS = {
    "price": r"(?:سعر(?:\s*الوحدة)?|السعر)\s*[:\-–]\s*([\d,\.]+)\s*(ألف|الف|مليون|مليار)?",
    "area": r"مساحة(?:\s*العقار)?\s*[:\-–]\s*([\d,\.]+)",
    "rooms": r"عدد\s*الغرف\s*[:\-–]\s*([\d]+)",
    "baths": r"(?:عدد\s*)?(?:الحمامات?|دورات?\s*المياه)\s*[:\-–]\s*([\d]+)",
    "type": r"نوع\s*العقار\s*[:\-–]\s*([^\n\r,،]+)",
    "age": r"عمر\s*العقار\s*[:\-–]\s*([^\n\r,،]+)",
    "city": r"المدينة\s*[:\-–]\s*([^\n\r,،]+)",
    "district": r"الحي\s*[:\-–]\s*([^\n\r,،]+)",
    "map": r"maps\.google\.com/\?q=([\-\d\.]+),([\-\d\.]+)",
}
LISTING_TYPES = [
    ("Apartment", "apartment"), ("apartment", "apartment"), ("شقة", "apartment"), ("شقق", "apartment"),
    ("Villa", "villa"), ("villa", "villa"), ("فيلا", "villa"), ("فلل", "villa"),
    ("Residential_Land", "plot"), ("Land", "plot"), ("land", "plot"),
    ("أرض", "plot"), ("ارض", "plot"), ("أراضي", "plot"),
    ("Building", "building"), ("building", "building"), ("عمارة", "building"), ("عمائر", "building"),
]
# ---- end of fixed values ----


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def normalize_ar(text) -> Column:
    """NFKC, then drop tatweel and harakat, then trim; null becomes ''.

    Only texts that hold non-ASCII characters change under NFKC, but Spark has no built-in for it: this is the one
    Arrow-batched Python call in the library. Apply it to distinct names, not to fact rows.
    """
    return F.coalesce(F.trim(F.regexp_replace(_nfkc(col(text)), TATWEEL_AND_HARAKAT, "")), F.lit(""))


def strip_district_prefix(text) -> Column:
    """Trim, drop the leading word for "district", collapse blanks."""
    bare = F.regexp_replace(F.trim(col(text)), "^" + DISTRICT_PREFIX, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def has_arabic(text) -> Column:
    return F.coalesce(col(text).rlike(ARABIC_LETTER), F.lit(False))


def zip5(value) -> Column:
    """Postal code from text or number: integer part, zero-padded to five, never truncated."""
    digits = col(value).cast("string").try_cast("double").try_cast("bigint").cast("string")
    return F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)


def route_count(routes) -> Column:
    """Number of blank-separated routes; empty or null gives 0."""
    bare = F.trim(F.coalesce(col(routes), F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def is_express(routes, express: list[str], min_routes: int = 2) -> Column:
    """1 if any route is an express route and the stop serves at least ``min_routes``."""
    parts = F.split(F.trim(F.coalesce(col(routes), F.lit(""))), r"\s+")
    known = F.array(*[F.lit(r) for r in express])
    return (F.arrays_overlap(parts, known) & (route_count(routes) >= min_routes)).cast("int")


def text_bool(value) -> Column:
    return F.coalesce((F.lower(col(value).cast("string")) == "true").cast("int"), F.lit(0))


def class_flags(df: DataFrame, class_col: str, rules: dict[str, str]) -> DataFrame:
    """0/1 columns from anchored regular expressions on the upper-cased class code."""
    code = F.upper(F.coalesce(F.col(class_col), F.lit("")))
    return df.withColumns({name: code.rlike(pattern).cast("int") for name, pattern in rules.items()})


def map_type(text, rules: list[tuple[str, str]], mode: str = "contains", default: str | None = None) -> Column:
    """First rule that matches wins: substring (``contains``) or whole value (``equals``)."""
    t = col(text)
    out = F
    for token, label in rules:
        hit = t.contains(token) if mode == "contains" else t == token
        out = out.when(hit, label)
    return out.otherwise(F.lit(default).cast("string"))


def _found(text, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    value = F.regexp_replace(text, r"[,\s]", "").try_cast("double")
    return F.when(value > 0, value)


def parse_listing_text(df: DataFrame, text_col: str, labels: dict[str, str] = LISTING_LABELS,
                       units: dict[str, float] = PRICE_UNITS, new_words: list[str] = NEW_BUILD_WORDS,
                       types: list[tuple[str, str]] = LISTING_TYPES) -> DataFrame:
    """Add price, area, rooms, baths, type, age, city, district and coordinates read from a free text.

    A price with a unit word is multiplied by it; a bare price below the limit is taken as thousands.
    """
    # every label is searched once per text; what follows works on the short matches. The one-element explodes keep the steps apart:
    # neither later rules nor later filters then search the text again
    found = [F.regexp_extract(text_col, labels[n], 0 if n in ("price", "map") else 1).alias(n) for n in labels]
    found = df.withColumn("_found", F.explode(F.array(F.struct(*found))))
    hit = lambda name: F.col(f"_found.{name}")
    said = lambda name: F.nullif(hit(name), F.lit(""))
    short = {"_amount": _number(_found(hit("price"), labels["price"])), "_unit": F.regexp_extract(hit("price"), labels["price"], 2), "_type": F.trim(said("type")),
             "_age": F.trim(said("age")), "_lat": _found(hit("map"), labels["map"], 1), "_lon": _found(hit("map"), labels["map"], 2)}
    found = found.withColumn("_short", F.explode(F.array(F.struct(*[c.alias(n) for n, c in short.items()]))))
    amount, raw_type, age_text = F.col("_short._amount"), F.col("_short._type"), F.col("_short._age")
    price = F
    for word, factor in units.items():
        price = price.when(F.col("_short._unit") == word, amount * factor)
    price = price.when(amount < BARE_PRICE_LIMIT, amount * 1e3).otherwise(amount)
    fields = {
        "price_sar": price,
        "area_sqm": _number(said("area")),
        "bedrooms": said("rooms").try_cast("int"),
        "bathrooms": said("baths").try_cast("int"),
        "property_type_ar": raw_type,
        "property_type_en": F.when(raw_type.isNotNull(), map_type(raw_type, types, default="other")),
        "age_years": F.when(age_text.isin(new_words), 0).otherwise(_found(age_text, r"(\d+)").try_cast("int")),
        "city": F.trim(said("city")),
        "district": F.trim(said("district")),
        "lat": F.col("_short._lat").try_cast("double"),
        "lon": F.col("_short._lon").try_cast("double"),
    }
    parsed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return found.withColumn("_parsed", parsed).select(*df.columns, "_parsed.*")


def listing_id(url, pattern: str = r"/(\d+)/") -> Column:
    """Numeric id in the URL, else its last path segment."""
    u = col(url)
    return F.coalesce(_found(u, pattern), F.element_at(F.split(F.regexp_replace(u, r"^/+|/+$", ""), "/"), -1))
