"""Spatial kernels against brute force on awkward point sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hectare.operators import regions, spatial


def flat(a, b):
    return math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) * 111_000


def arc(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


DISTANCE = {"flat": flat, "haversine": arc}


def crowded(seed, n):
    """A third of the points in one tiny block, a third at one single spot, the rest anywhere."""
    r = random.Random(seed)
    out = [(40.7 + r.random() * 1e-3, -74.0 + r.random() * 1e-3) for _ in range(n // 3)]
    out += [(40.71, -74.01)] * (n // 3)
    out += [(40.4 + r.random() * 0.6, -74.3 + r.random() * 0.7) for _ in range(n - 2 * (n // 3))]
    return out


def frames(spark, subjects, points):
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(subjects)], "sid int, lat double, lon double")
    p = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lon double")
    return s, p


@pytest.mark.parametrize("metric", ["flat", "haversine"])
@pytest.mark.parametrize("radius", [5.0, 900.0, 20_000.0])
def test_counts_match_brute_force(spark, metric, radius):
    subjects, points = crowded(1, 60), crowded(2, 240)
    s, p = frames(spark, subjects, points)
    got = {r.sid: r.n_within for r in spatial.count_within(s, p, radius, metric=metric, leaf_size=4).collect()}
    assert got == {i: sum(DISTANCE[metric](a, b) <= radius for b in points) for i, a in enumerate(subjects)}


@pytest.mark.parametrize("metric", ["flat", "haversine"])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_matches_brute_force(spark, metric, k):
    subjects, points = crowded(3, 60), crowded(4, 240)
    s, p = frames(spark, subjects, points)
    got = spatial.nearest_k(s, p, k, metric, leaf_size=4).collect()
    want = set()
    for a in set(subjects):
        best = sorted((round(DISTANCE[metric](a, b), 6), i) for i, b in enumerate(points))[:k]
        want |= {(a, rank, d, i) for rank, (d, i) in enumerate(best, 1)}
    assert {((r.lat, r.lon), r["rank"], round(r.distance_m, 6), r.id) for r in got} == want


def test_fewer_points_than_k_and_missing_coordinates(spark):
    s, p = frames(spark, [(40.7, -74.0), (None, -74.0)], [(40.8, -74.0), (None, None), (float("nan"), 1.0)])
    assert [r.id for r in spatial.nearest_k(s, p, 3).collect()] == [0]
    near = {r.sid: r.d for r in spatial.nearest_distance(s, p, "d").collect()}
    assert near[1] is None and abs(near[0] - 11_100) < 1e-6
    assert {r.sid: r.n_within for r in spatial.count_within(s, p, 50_000).collect()} == {0: 1, 1: 0}


def test_no_points_at_all(spark):
    s, p = frames(spark, [(40.7, -74.0)], [(None, None)])
    assert spatial.nearest_k(s, p).collect() == []
    assert spatial.count_within(s, p, 10).first().n_within == 0


def test_radius_is_inclusive_and_exact(spark):
    s, p = frames(spark, [(0.0, 0.0)], [(0.0, 0.5), (0.5, 0.0), (0.5, 0.5)])
    assert spatial.count_within(s, p, 55_500.0, metric="flat").first().n_within == 2


def test_result_does_not_depend_on_partitioning(spark):
    s, p = frames(spark, crowded(5, 40), crowded(6, 90))
    one = sorted(map(tuple, spatial.count_within(s.coalesce(1), p.coalesce(1), 700).collect()))
    many = sorted(map(tuple, spatial.count_within(s.repartition(7), p.repartition(5, "lat"), 700).collect()))
    assert one == many


def test_far_latitude_uses_wide_enough_cells(spark):
    subjects = [(69.0, 20.0 + i * 0.03) for i in range(20)]
    points = [(69.0 + j * 0.002, 20.0 + i * 0.011) for i in range(40) for j in range(5)]
    s, p = frames(spark, subjects, points)
    got = {r.sid: r.n_within for r in spatial.count_within(s, p, 1500, leaf_size=3).collect()}
    assert got == {i: sum(arc(a, b) <= 1500 for b in points) for i, a in enumerate(subjects)}


def test_idw_floors_distance(spark):
    s, _ = frames(spark, [(0.0, 0.0)], [(0.0, 0.0)])
    st = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 0.0, 1.0, 20.0)], "id int, lat double, lon double, v double")
    w = [1.0, 1 / 111_000]
    assert abs(spatial.idw(s, st, ["v"]).first().v_idw - (10 * w[0] + 20 * w[1]) / sum(w)) < 1e-9


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


SHAPES = [
    ("rect", [[ring((0, 0), (1, 0), (1, 1), (0, 1))]]),
    ("next", [[ring((1, 0), (2, 0), (2, 1), (1, 1))]]),
    ("holed", [[ring((0, 2), (3, 2), (3, 5), (0, 5), (0, 2)), ring((1, 3), (2, 3), (2, 4), (1, 4))]]),
    ("concave", [[ring((4, 0), (6, 0), (6, 2), (5, 0.5), (4, 2))]]),
    ("two", [[ring((7, 0), (8, 0), (8, 1), (7, 1))], [ring((7, 3), (8, 3), (8, 4), (7, 4))]]),
]


def test_regions_hold_their_points(spark):
    polys = spark.createDataFrame(SHAPES, f"code string, parts {regions.PARTS_TYPE}")
    cases = [((0.5, 0.5), "rect"), ((1.5, 0.5), "next"), ((0.5, 2.5), "holed"), ((1.5, 3.5), None), ((2.5, 3.5), "holed"), ((5.0, 1.5), None), ((5.0, 0.2), "concave"),
             ((7.5, 0.5), "two"), ((7.5, 2.0), None), ((7.5, 3.5), "two"), ((1.0, 0.5), "next"), ((9.0, 9.0), None), ((-0.5, 0.5), None)]
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, ((x, y), _) in enumerate(cases)] + [(99, None, 0.5)], "id int, lon double, lat double")
    for step in (0.3, 1.0, 50.0):
        got = {r.id: r.code for r in regions.assign_region(pts, polys, step=step).collect()}
        assert got == {**{i: code for i, (_, code) in enumerate(cases)}, 99: None}, step


def test_overlapping_regions_give_smallest_code(spark):
    polys = spark.createDataFrame([("b", SHAPES[0][1]), ("a", SHAPES[0][1])], f"code string, parts {regions.PARTS_TYPE}")
    pts = spark.createDataFrame([(1, 0.5, 0.5)], "id int, lon double, lat double")
    assert regions.assign_region(pts, polys).first().code == "a"


def test_random_polygon_against_even_odd(spark):
    r = random.Random(7)
    pts = [(r.random() * 4, r.random() * 4) for _ in range(300)]
    star = [(2 + (1.9 if i % 2 else 0.6) * math.cos(i * math.pi / 9), 2 + (1.9 if i % 2 else 0.6) * math.sin(i * math.pi / 9)) for i in range(18)]

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(star, star[1:] + star[:1]):
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
        return odd

    polys = spark.createDataFrame([("s", [[ring(*star)]])], f"code string, parts {regions.PARTS_TYPE}")
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id int, lon double, lat double")
    got = {x.id for x in regions.assign_region(df, polys, step=0.17).filter(F.col("code").isNotNull()).collect()}
    assert got == {i for i, (x, y) in enumerate(pts) if inside(x, y)}


def test_outline_skips_gaps_and_counts_along_the_ring(spark):
    def square(x, y, clockwise):
        ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        return [[[{"lon": float(a), "lat": float(b)} for a, b in (ring[::-1] if clockwise else ring)]]]

    # eight squares round a gap, and one that touches them in a corner only
    cells = [(3 * x + y, square(x, y, (x + y) % 2 == 0)) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(99, square(3, 3, False))]
    df = spark.createDataFrame(cells, f"code int, parts {regions.PARTS_TYPE}")
    got = {(r.lon, r.lat) for r in regions.boundary_vertices(df, stride=1).collect()}
    outer = {(x, y) for x in range(4) for y in range(4) if x in (0, 3) or y in (0, 3)}
    assert got == outer | {(4, 3), (4, 4), (3, 4)}
    assert len(outer) == 12
    every_third = {(r.lon, r.lat) for r in regions.boundary_vertices(df.filter("code <> 99"), stride=3).collect()}
    assert every_third == {(0, 0), (3, 0), (3, 3), (0, 3)}
    assert regions.boundary_vertices(df.filter("code < 0")).count() == 0


def test_distances_wrap_at_180_degrees(spark):
    r = random.Random(12)
    lon = lambda: r.choice([179.99, -179.99, 179.5, -179.6, 0.0]) + r.random() * 0.009
    subjects, points = [(r.random() * 0.01, lon()) for _ in range(40)], [(r.random() * 0.01, lon()) for _ in range(160)]
    s, p = frames(spark, subjects, points)
    got = {x.sid: x.n_within for x in spatial.count_within(s, p, 3000.0, metric="haversine", leaf_size=4).collect()}
    assert got == {i: sum(DISTANCE["haversine"](a, b) <= 3000 for b in points) for i, a in enumerate(subjects)}
    near = {(x.lat, x.lon): x.distance_m for x in spatial.nearest_k(s, p, 1, "haversine", leaf_size=4).collect()}
    for a in subjects:
        assert abs(near[a] - min(DISTANCE["haversine"](a, b) for b in points)) < 1e-6


def test_windows_of_the_nearest_walk_carry_no_points(spark):
    """Sorts hold cells and distances; rows of points are taken up by the winners, ties included."""
    at = [(i, 40.0 + i % 40 * 0.001, 20.0 + i // 40 % 30 * 0.001, float(i)) for i in range(3600)]
    points = spark.createDataFrame(at, "id int, lat double, lon double, price double")
    subjects = spark.createDataFrame([(1, 40.0105, 20.0105), (2, 40.0, 20.0), (3, 41.0, 21.0)], "sid int, lat double, lon double")
    found = spatial.nearest_k(subjects, points, 5, p_id="id", cols=["price"])
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line and "Group" not in line]
    assert windows and not any("pts" in line or "rows#" in line for line in windows)
    plan = found._jdf.queryExecution().optimizedPlan()

    def carried(node):
        out = [a.name() for a in (node.output().apply(i) for i in range(node.output().size()))] if node.nodeName() == "Window" else []
        return out + [c for i in range(node.children().size()) for c in carried(node.children().apply(i))]

    assert not {"pts", "rows", "p"} & set(carried(plan))
    got = {(r.lat, r.lon, r["rank"]): r.id for r in found.collect()}
    for _, y, x in subjects.collect():
        best = sorted(((round(((p[1] - y) ** 2 + (p[2] - x) ** 2) ** 0.5, 9), p[0]) for p in at))[:5]
        near = [round(((at[got[y, x, k]][1] - y) ** 2 + (at[got[y, x, k]][2] - x) ** 2) ** 0.5, 9) for k in range(1, 6)]
        assert near == [d for d, _ in best]
