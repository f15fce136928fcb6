"""Small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values ----
BOROUGHS = {1: "Manhattan", 2: "Bronx", 3: "Brooklyn", 4: "Queens", 5: "Staten Island"}
EXPRESS_ROUTES = ["A", "C", "E", "B", "D", "F", "M", "N", "Q", "R", "W", "J", "Z", "2", "3", "4", "5", "6", "7", "L"]
RIYADH_CENTRE = (24.7136, 46.6753)
AIR_STATIONS = {
    "At-Taawun": (24.762272, 46.650878),
    "Al-Muruj": (24.758315, 46.671171),
    "Al-Jazeera": (24.700139, 46.678500),
    "Al-Uraija": (24.685105, 46.703063),
    "Al-Khalidiya": (24.766047, 46.761886),
    "Ar-Rawabi": (24.751314, 46.868278),
    "Ad-Dhubbat": (24.723857, 46.756673),
    "Al-Ghurabi": (24.648444, 46.721056),
    "Al-Khaleej": (24.598469, 46.744378),
}
FALLBACK_CENTROIDS = {
    "الخزامى": (24.8350, 46.6950),
    "الخير": (24.8600, 46.7800),
    "الراية": (24.7900, 46.6300),
    "الرسالة": (24.7150, 46.5900),
    "الزاهر": (24.6500, 46.7600),
    "الزهور": (24.8100, 46.7200),
    "الشعلة": (24.7400, 46.6100),
    "النخبة": (24.8200, 46.6500),
    "عريض": (24.8800, 46.8200),
    "مغرزات": (24.7600, 46.5600),
}
OVERRIDE_CENTROIDS = {
    "ظهره العودة غرب": (24.7389, 46.5165),
    "ظهرة العودة شرق": (24.7530, 46.5454),
    "الشفاء": (24.5608, 46.6930),
    "الصفاء": (24.6717, 46.7700),
    "المنصورة": (24.6091, 46.7444),
    "الوسام": (24.6275, 46.6800),
    "وادي لبن": (24.6200, 46.5650),
    "الرابية": (24.8000, 46.6600),
    "السحاب": (24.7700, 46.7150),
    "الملك سلمان": (24.7630, 46.6440),
    "المرجان": (24.6600, 46.7500),
    "سدرة": (24.7650, 46.7000),
    "أخرى": (99.0, 0.0),  # any other district: far outside, so that it is never the nearest
}
HEALTH_AREAS = {
    101: (40.877, -73.910), 102: (40.858, -73.897), 103: (40.850, -73.882), 104: (40.843, -73.848), 105: (40.833, -73.930),
    106: (40.820, -73.912), 107: (40.812, -73.920), 201: (40.672, -73.935), 202: (40.650, -73.959), 203: (40.638, -73.962),
    204: (40.630, -73.946), 205: (40.645, -73.980), 206: (40.660, -73.975), 207: (40.656, -73.955), 208: (40.634, -73.918),
    209: (40.600, -73.960), 210: (40.587, -73.967), 211: (40.575, -73.988), 212: (40.680, -74.003), 213: (40.697, -73.928),
    214: (40.710, -73.900), 301: (40.843, -73.943), 302: (40.829, -73.949), 303: (40.796, -73.938), 304: (40.793, -73.977),
    305: (40.775, -73.980), 306: (40.760, -73.994), 307: (40.745, -73.989), 308: (40.734, -73.991), 309: (40.718, -73.999),
    310: (40.707, -74.009), 401: (40.756, -73.930), 402: (40.740, -73.880), 403: (40.730, -73.850), 404: (40.725, -73.820),
    405: (40.715, -73.800), 406: (40.695, -73.860), 407: (40.695, -73.820), 408: (40.680, -73.870), 409: (40.678, -73.860),
    410: (40.665, -73.840), 411: (40.672, -73.810), 412: (40.715, -73.760), 501: (40.618, -74.078), 502: (40.584, -74.110),
    503: (40.580, -74.155),
}
DEED_TYPES = [
    ("شقة", "شقة"), ("فيلا", "فيلا"), ("مبنى سكني", "عمارة"), ("قطعة أرض", "قطعة أرض-سكنى"), ("أرض فضاء", "قطعة أرض-سكنى"),
]
# ---- end of fixed values ----


def dim_points(spark: SparkSession, points: dict, key: str = "district") -> DataFrame:
    """(key, lat, lon) table from a fixed mapping."""
    rows = [(str(k), lat, lon) for k, (lat, lon) in points.items()]
    return spark.createDataFrame(rows, f"`{key}` string, lat double, lon double")


def dim_map(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    rows = [(str(k), v) for k, v in mapping.items()]
    return spark.createDataFrame(rows, f"`{key}` string, `{value}` string")
