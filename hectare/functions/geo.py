"""Distance formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_000.0
EARTH_RADIUS_M = 6_371_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flat_m(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees times 111 000; longitude is deliberately not scaled by latitude."""
    dy, dx = col(lat1) - col(lat2), col(lon1) - col(lon2)
    return F.sqrt(dy * dy + dx * dx) * F.lit(METRES_PER_DEGREE)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dy, dx = F.sin((b - a) / 2), F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(dy * dy + F.cos(a) * F.cos(b) * dx * dx))


METRICS = {"flat": flat_m, "haversine": haversine_m}


def near_flag(distance, metres: float, inclusive: bool = False) -> Column:
    """1 where the distance is under the threshold; null distance gives 0."""
    d = col(distance)
    hit = d <= metres if inclusive else d < metres
    return F.coalesce(hit.cast("int"), F.lit(0))


def centre_distances(df, centres: dict[str, tuple[float, float]], lat: str, lon: str, log: bool = False):
    """Flat distance to each fixed centre as ``dist_<name>_m`` (and its log1p); expressions only, no join."""
    out = {}
    for name, (clat, clon) in centres.items():
        d = flat_m(lat, lon, F.lit(clat), F.lit(clon))
        out[f"dist_{name}_m"] = d
        if log:
            out[f"log_dist_{name}_m"] = F.log1p(d)
    return df.withColumns(out)
