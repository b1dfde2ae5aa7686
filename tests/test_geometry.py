"""Plane geometry against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import geometry, roads, spatial

SCHEMA = "cluster_id long, x0 double, y0 double, x1 double, y1 double"


def test_outlines_of_separate_lines_have_their_closed_form(spark):
    """Straight lines of 1 m to 50 km, slanted and not; widened by r a line has the area 2rL + pi r^2 and the perimeter 2L + 2 pi r."""
    r, rows, want = 50.0, [], {}
    for i, (length, angle) in enumerate([(1.0, 0.3), (1_000.0, 0.0), (5_000.0, 0.7), (20_000.0, 1.1), (40_000.0, math.pi / 2), (50_000.0, 2.5)]):
        rows.append((i, 13.0, -7.0, 13.0 + length * math.cos(angle), -7.0 + length * math.sin(angle)))
        want[i] = length
    rows += [(6, 0.0, 0.0, 100.0, 0.0), (6, 0.0, 5_000.0, 100.0, 5_000.0), (7, 0.0, 0.0, 300.0, 0.0), (7, 300.0, 0.0, 1000.0, 0.0), (7, None, 0.0, 1.0, 1.0)]
    got = {x.cluster_id: x for x in geometry.shapes(spark.createDataFrame(rows, SCHEMA), r).collect()}
    for i, length in want.items():
        assert math.isclose(got[i].area, 2 * r * length + math.pi * r * r, rel_tol=2e-3), i
        assert math.isclose(got[i].perimeter, 2 * length + 2 * math.pi * r, rel_tol=2e-3), i
        assert math.isclose(got[i].elongation, (length + 2 * r) / (2 * r), rel_tol=1e-6) and abs(got[i].hull_ratio - 1) < 2e-3
    assert math.isclose(got[6].area, 2 * (2 * r * 100 + math.pi * r * r), rel_tol=2e-3) and math.isclose(got[6].perimeter, 2 * (200 + 2 * math.pi * r), rel_tol=2e-3)
    assert math.isclose(got[7].area, 2 * r * 1000 + math.pi * r * r, rel_tol=2e-3)


def test_outline_of_crossing_lines(spark):
    r, n = 50.0, 1_000.0
    x = geometry.shapes(spark.createDataFrame([(1, -n, 0.0, n, 0.0), (1, 0.0, -n, 0.0, n)], SCHEMA), r).first()
    assert math.isclose(x.area, 2 * (4 * r * n + math.pi * r * r) - 4 * r * r, rel_tol=2e-3)
    assert math.isclose(x.perimeter, 8 * n + 4 * math.pi * r - 8 * r, rel_tol=4e-3)


@pytest.mark.parametrize("tolerance", [0.0, 30.0])
def test_length_inside_a_polygon(tolerance):
    """Against points sampled along each leg; the polygon is not convex."""
    r = np.random.default_rng(1)
    ring = np.array([(0, 0), (400, 0), (400, 300), (250, 100), (100, 400), (0, 300)], float)
    legs = r.uniform(-150, 550, (60, 4))
    legs[0] = (10, 10, 10, 10)
    t = (np.arange(4000) + 0.5) / 4000
    for leg, got in zip(legs, geometry.inside_lengths(legs, ring, tolerance)):
        x, y = leg[0] + t * (leg[2] - leg[0]), leg[1] + t * (leg[3] - leg[1])
        odd, near = np.zeros(len(t), bool), np.full(len(t), np.inf)
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            if a[1] != b[1]:
                odd ^= ((a[1] > y) != (b[1] > y)) & (x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]))
            k = np.clip(((x - a[0]) * (b - a)[0] + (y - a[1]) * (b - a)[1]) / ((b - a) ** 2).sum(), 0, 1)
            near = np.minimum(near, np.hypot(x - a[0] - k * (b - a)[0], y - a[1] - k * (b - a)[1]))
        length = math.hypot(leg[2] - leg[0], leg[3] - leg[1])
        assert abs(got - length * (odd | (near <= tolerance) if tolerance else odd).mean()) <= length * 2e-3 + 1e-9


LINES = "seg_id string, name string, geom array<struct<x:double,y:double>>"


def test_polylines(spark):
    rows = [("a", "x", [(0.0, 0.0), (10.0, 0.0), (10.0, 30.0)]), ("b", "x", [(5.0, 5.0)]), ("c", None, None), ("d", "x", [])]
    lines = spark.createDataFrame(rows, LINES)
    assert sorted(tuple(r)[1:] for r in geometry.legs(lines).select("seg_id", "x0", "y0", "x1", "y1").collect()) == [(0.0, 0.0, 10.0, 0.0), (5.0, 5.0, 5.0, 5.0), (10.0, 0.0, 10.0, 30.0)]
    assert {r.seg_id: r.n for r in lines.select("seg_id", geometry.length_of().alias("n")).collect()} == {"a": 40.0, "b": 0.0, "c": 0.0, "d": 0.0}
    assert {r.seg_id: (r.x, r.y) for r in geometry.centroids(lines, ["seg_id"]).collect()} == {"a": (8.75, 11.25), "b": (5.0, 5.0)}
    points = spark.createDataFrame([(1, 9.0, 20.0), (2, 5.0, 4.0), (3, 100.0, 100.0), (4, None, 1.0)], "point_id long, px double, py double")
    legs = geometry.legs(lines).select("seg_id", "x0", "y0", "x1", "y1")
    assert {r.point_id: (r.seg_id, r.distance) for r in spatial.nearest_segment(points, legs, 10.0).collect()} == {1: ("a", 1.0), 2: ("b", 1.0), 3: (None, None), 4: (None, None)}
    assert sorted(map(tuple, spatial.within_distance(points, legs, 10.0).collect())) == [(1, "a", 1.0), (2, "a", 4.0), (2, "b", 1.0)]


def test_scope_mask(spark):
    """Lines inside by share of length, and ring roads by name within the corridor of the ring."""
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    rows = [("in", "x", [(10.0, 10.0), (90.0, 90.0)]), ("half", "x", [(50.0, 50.0), (150.0, 50.0)]), ("edge", "x", [(0.0, 105.0), (100.0, 105.0)]), ("ring", "Fifth Ring", [(0.0, 140.0), (100.0, 140.0)]), ("far ring", "Fifth Ring", [(0.0, 900.0), (9.0, 900.0)]), ("other", "x", [(0.0, 140.0), (100.0, 140.0)]), ("none", None, None), ("auxiliary", "Fifth Ring auxiliary", [(0.0, 140.0), (100.0, 140.0)])]
    lines = spark.createDataFrame(rows, LINES)
    ring = lines.where("seg_id = 'ring'")
    got = {r.seg_id: (r.inside, r.on_ring, r.in_scope) for r in roads.scope_mask(lines, ring, square, ["Fifth Ring"], ["auxiliary"], threshold=0.98, tolerance=10.0, corridor=20.0).collect()}
    assert got["in"] == (True, False, True) and got["half"] == (False, False, False) and got["edge"] == (True, False, True)
    assert got["ring"] == (False, True, True) and got["far ring"] == (False, False, False) and got["other"] == (False, False, False)
    assert got["none"] == (False, False, False) and got["auxiliary"] == (False, False, False)
    without = {r.seg_id for r in roads.scope_mask(lines, ring, square, ["Fifth Ring"], threshold=0.98, tolerance=10.0, corridor=20.0, keep_ring=False).where("in_scope").collect()}
    assert without == {"in", "edge"}
    kept = roads.highway_filter(spark.createDataFrame([("a", "primary"), ("b", "footway"), ("c", None), ("d", "service")], "seg_id string, highway string"), ["primary", "service"], ["service"])
    assert [r.seg_id for r in kept.collect()] == ["a"]


def test_faces_of_lines():
    """A square with a cross inside has four faces; loose ends and a line outside bound none."""
    square = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)]
    cross = [(5, -2, 5, 12), (0, 5, 10, 5)]
    faces = geometry.polygonize(np.array([*square, *cross, (20, 0, 30, 0)], float))
    assert sorted(geometry._area(f) for f in faces) == [25.0] * 4
    (one,) = geometry.polygonize(np.array(square, float))
    assert geometry._area(one) == 100.0 and geometry.polygonize(np.array(square[:3], float)) == []
    overlap = geometry.polygonize(np.array([*square, (2, 0, 7, 0)], float))
    assert [geometry._area(f) for f in overlap] == [100.0]


def test_boundary():
    ring = np.array([(0, 0, 1000, 0), (1000, 0, 1000, 1000), (1000, 1000, 0, 1000), (0, 1000, 0, 0), (-500, 500, 1500, 500)], float)
    assert geometry._area(geometry.boundary_polygon(ring, (500.0, 700.0), (-2000, -2000, 3000, 3000), 40.0)) == 500_000.0
    opened = ring.copy()[:4]
    opened[3] = (0, 1000, 0, 30)  # a gap that the corridor closes
    inner = geometry.boundary_polygon(opened, (500.0, 700.0), (-2000, -2000, 3000, 3000), 40.0)
    assert abs(geometry._area(inner) / 920**2 - 1) < 0.03
    with pytest.raises(ValueError):
        geometry.boundary_polygon(opened, (5000.0, 700.0), (-2000, -2000, 3000, 3000), 40.0)


def test_smallest_polygon(spark):
    r = np.random.default_rng(5)
    rings = {i: [(float(x + w * math.cos(t)), float(y + w * math.sin(t))) for t in np.sort(r.uniform(0, 2 * math.pi, 7))] for i, (x, y, w) in enumerate(r.uniform(0, 400, (30, 3)))}
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 400, (200, 2)))] + [(999, None, 1.0)]
    polygons = spark.createDataFrame([*rings.items(), (77, [(0.0, 0.0)])], "poly_id long, ring array<struct<x:double,y:double>>").withColumn("cy", F.lit(1))
    got = {p.point_id: p.poly_id for p in geometry.smallest_polygon(spark.createDataFrame(points, "point_id long, px double, py double"), polygons, 100.0).collect()}
    for i, x, y in points:
        own = [(geometry._area(np.array(ring)), k) for k, ring in rings.items() if x is not None and geometry._has(np.array(ring), x, y)]
        assert got[i] == (min(own)[1] if own else None)


def test_equal_areas_go_to_the_smaller_id(spark):
    """Squares of one size at places with many digits: their computed areas differ after the ninth digit, which decides nothing."""
    r = np.random.default_rng(3)
    corners = [(round(float(x), 2), round(float(y), 2)) for x, y in r.uniform(100, 120, (40, 2))]
    squares = [[(x, y), (x + 100.0, y), (x + 100.0, y + 100.0), (x, y + 100.0)] for x, y in corners]
    rough = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    rings = list(enumerate(sorted(squares, key=rough, reverse=True)))  # the least id has the greatest computed area
    points = [(i, 125.0 + i, 130.0) for i in range(30)]
    got = geometry.smallest_polygon(spark.createDataFrame(points, "point_id long, px double, py double"), spark.createDataFrame(rings, "poly_id long, ring array<struct<x:double,y:double>>"), 50.0).collect()
    assert {p.poly_id for p in got} == {0}


def test_smallest_polygon_meets_few(spark, monkeypatch):
    """400 squares over one cell: a place that the smallest hold is not tried against all; places that only the last ones hold, or none, are."""
    seen, real = spark.sparkContext.accumulator(0), geometry.inside
    count = F.udf(lambda x, poly: seen.add(1) is None, "boolean")  # of both, or it is counted before they meet
    monkeypatch.setattr(geometry, "inside", lambda px, py: real(px, py) & count(F.col(px), F.col("poly_id")))
    square = lambda x, w: [(x, x), (x + w, x), (x + w, x + w), (x, x + w)]
    rings = [(i, square(10.0, 50.0 + (i * 7) % 400 / 10)) for i in range(400)] + [(1000 + i, ring) for i, ring in enumerate([square(5.0, 94.9), square(5.0, 94.9)])]
    points = [(i, 15.0 + i % 40 + i / 1000, 20.0 + i % 30) for i in range(500)] + [(900, 7.0, 7.0), (901, 99.5, 99.5), (902, 1.0, 1.0), (903, 99.95, 99.95), (904, 99.5, 99.5), (905, math.nan, 1.0), (906, None, 1.0), (907, 99.0, 75.0)]
    got = {p.point_id: p.poly_id for p in geometry.smallest_polygon(spark.createDataFrame(points, "point_id long, px double, py double"), spark.createDataFrame(rings, "poly_id long, ring array<struct<x:double,y:double>>"), 100.0).collect()}
    for i, x, y in points:
        own = [(geometry._area(np.array(ring)), k) for k, ring in rings if x is not None and geometry._has(np.array(ring), x, y)]
        assert got[i] == (min(own)[1] if own else None), i
    assert len(got) == len(points) and 0 < seen.value < 50 * len(points), seen.value


def test_nearest_segment_against_brute_force(spark):
    """Crowded and empty places, equal legs, points at one place, and a mirror pair whose tie must not fall to rounding."""
    r = np.random.default_rng(9)
    legs = [(i, float(x), float(y), float(x) + 100.0, float(y) + 50.0) for i, (x, y) in enumerate([*r.uniform(0, 60, (150, 2)), *r.uniform(800, 3000, (30, 2))])]
    legs += [(500 + i, *leg[1:]) for i, leg in enumerate(legs[:50])]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([*r.uniform(-100, 200, (150, 2)), *r.uniform(600, 3200, (150, 2)), *[(50.0, 30.0)] * 40])] + [(999, None, 1.0), (999, 5.0, 5.0), (998, math.nan, 1.0)]
    placed, lines = spark.createDataFrame(points, "point_id long, px double, py double"), spark.createDataFrame(legs, "seg_id long, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for x in spatial.nearest_segment(placed, spatial.with_offsets(lines), 120.0).collect():
        got.setdefault(x.point_id, set()).add((x.seg_id, x.distance))

    def off(x, y, leg):
        k = min(1.0, max(0.0, ((x - leg[1]) * 100.0 + (y - leg[2]) * 50.0) / 12500.0))
        a, b = x - (leg[1] + k * 100.0), y - (leg[2] + k * 50.0)
        return math.sqrt(a * a + b * b)

    for i in {p[0] for p in points}:
        own = [(d, leg[0]) for _, x, y in (p for p in points if p[0] == i) for leg in legs if x is not None and not math.isnan(x) and (d := off(x, y, leg)) <= 120.0]
        assert got[i] == ({(min(own)[1], min(own)[0])} if own else {(None, None)}), i


def test_offsets_are_free_of_their_place(spark):
    lines = spark.createDataFrame([(i, x, 0.0, x + 100.0, 50.0) for i, x in enumerate((-737.13, 0.1, 4711.07, 9999.99))], "seg_id long, x0 double, y0 double, x1 double, y1 double")
    assert {(x.dx, x.dy) for x in spatial.with_offsets(lines).collect()} == {(100.0, 50.0)}
