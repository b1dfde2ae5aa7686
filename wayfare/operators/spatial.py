"""Spatial joins on a grid: no index, no cross join.

A segment goes to every cell its box, padded by the radius, touches; a point to its own cell. Candidates meet by
an equi-join on the cell, and the exact distance decides. A segment may have several rows, one for each straight leg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfare.plans.shared import cut


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point to a straight segment."""
    return _offset_distance(px, py, x0, y0, x1 - x0, y1 - y0)


def _offset_distance(px: Column, py: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    square = dx * dx + dy * dy
    along = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x0) * dx + (py - y0) * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x0 + along * dx), 2) + F.pow(py - (y0 + along * dy), 2))


def _candidates(points: DataFrame, segments: DataFrame, radius: float, cell: float | None) -> DataFrame:
    size = cell or max(4 * radius, 1e-9)
    low = lambda a, b: _cell(F.least(a, b) - radius, size)
    high = lambda a, b: _cell(F.greatest(a, b) + radius, size)
    placed = (
        segments.withColumn("cx", F.explode(F.sequence(low(F.col("x0"), F.col("x1")), high(F.col("x0"), F.col("x1")))))
        .withColumn("cy", F.explode(F.sequence(low(F.col("y0"), F.col("y1")), high(F.col("y0"), F.col("y1")))))
    )
    located = points.where("px is not null and py is not null and not isnan(px) and not isnan(py)").withColumns({"cx": _cell(F.col("px"), size), "cy": _cell(F.col("py"), size)})
    if "dx" in segments.columns:
        distance = _offset_distance(*(F.col(c) for c in ("px", "py", "x0", "y0", "dx", "dy")))
    else:
        distance = point_segment_distance(*(F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")))
    return located.join(placed, ["cx", "cy"]).withColumn("distance", distance)


def within_distance(points: DataFrame, segments: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """(point_id, seg_id, distance) of every pair nearer than the radius. ``points``: (point_id, px, py); ``segments``: (seg_id, x0, y0, x1, y1)."""
    near = _candidates(points, segments, radius, cell).where(F.col("distance") < radius)
    return near.groupBy("point_id", "seg_id").agg(F.min("distance").alias("distance"))


def with_offsets(segments: DataFrame, digits: int = 9) -> DataFrame:
    """Legs with dx and dy, free of the rounding that their place adds: legs of one shape measure alike wherever they lie."""
    return segments.withColumns({"dx": F.round(F.col("x1") - F.col("x0"), digits), "dy": F.round(F.col("y1") - F.col("y0"), digits)})


def nearest_segment(points: DataFrame, segments: DataFrame, radius: float, cell: float | None = None, steps: tuple[float, ...] = (1 / 16, 1 / 4)) -> DataFrame:
    """(point_id, seg_id, distance) of each point: the nearest segment within the radius, ties by id, else null.

    Places are looked up, not points, and of equal legs the one of least id. A place with a segment within a sixteenth
    of the radius has its nearest there; only the others go on to a quarter of it, then to the whole. So a crowded
    place meets few segments, and an empty one has few to meet. ``segments`` may have dx and dy (see :func:`with_offsets`).
    """
    shape = [c for c in ("x0", "y0", "x1", "y1", "dx", "dy") if c in segments.columns]
    legs = cut(segments.groupBy(*shape).agg(F.min("seg_id").alias("seg_id")))
    left, found = points.where("px is not null and py is not null").select("px", "py").distinct(), None
    for share in (*steps, 1.0):
        near = _candidates(left, legs, radius * share, cell and cell * share).where(F.col("distance") <= radius * share)
        best = cut(near.groupBy("px", "py").agg(F.min(F.struct("distance", "seg_id")).alias("b")))
        found = best if found is None else found.union(best)
        left = left.join(best, ["px", "py"], "left_anti")
    each = points.join(found, ["px", "py"]).groupBy("point_id").agg(F.min("b").alias("b"))
    return points.join(each, "point_id", "left").select("point_id", "b.seg_id", "b.distance")


def lines_within(left: DataFrame, right: DataFrame, distance: float, cell: float | None = None) -> DataFrame:
    """Rows of ``left`` with a leg of ``right`` at most ``distance`` away; both have x0, y0, x1, y1. They meet by cells."""
    size = cell or max(4 * distance, 200.0)

    def placed(df: DataFrame, pad: float) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(_cell(F.least(a, b) - pad, size), _cell(F.greatest(a, b) + pad, size)))
        return df.withColumn("cx", span(F.col("x0"), F.col("x1"))).withColumn("cy", span(F.col("y0"), F.col("y1")))

    other = placed(right.select("x0", "y0", "x1", "y1"), 0.0).select("cx", "cy", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    joined = placed(left, distance).join(other, ["cx", "cy"])
    a, b = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"r{c}") for c in ("x0", "y0", "x1", "y1")]
    turn = lambda p, q, x, y: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    apart = lambda s, t: turn(s[:2], s[2:], t[0], t[1]) * turn(s[:2], s[2:], t[2], t[3])
    crossing = (apart(a, b) < 0) & (apart(b, a) < 0)
    gap = F.least(*(point_segment_distance(x, y, *s) for s, (x, y) in ((b, a[:2]), (b, a[2:]), (a, b[:2]), (a, b[2:]))))
    return joined.where(crossing | (gap <= distance)).drop("cx", "cy", "rx0", "ry0", "rx1", "ry1")
