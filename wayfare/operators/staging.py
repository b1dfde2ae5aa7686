"""From raw orders to labelled trips between clusters: checks, projection, nearest segments, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfare.functions.scalars import slot_floor, utm_xy
from wayfare.operators.geometry import legs
from wayfare.operators.intervals import service_labels
from wayfare.operators.spatial import nearest_segment
from wayfare.plans.shared import cut

_ENDS = ("pickup", "dropoff")


def project(lines: DataFrame, zone: int, points: str = "geom") -> DataFrame:
    """Polylines in degrees to metres of a UTM zone."""
    def at(p: Column) -> Column:
        x, y = utm_xy(p["x"], p["y"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return lines.withColumn(points, F.transform(points, at))


def _finite(c: str) -> Column:
    return F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def match_points(points: DataFrame, lines: DataFrame, max_match_m: float, zone: int) -> DataFrame:
    """(point_id, seg_id, distance) of the nearest segment of points (point_id, lon, lat); null if none is near enough."""
    x, y = utm_xy("lon", "lat", zone)
    placed = points.select("point_id", F.when(_finite("lon") & _finite("lat"), x).alias("px"), F.when(_finite("lon") & _finite("lat"), y).alias("py"))
    return nearest_segment(placed, legs(lines).select("seg_id", "x0", "y0", "x1", "y1"), max_match_m)


def checked(raw: DataFrame, start: str, end: str) -> DataFrame:
    """``raw`` orders with what each check says: valid_time, in_window, valid_driver, valid_coordinates; pinned, with a number ``row``."""
    valid = F.coalesce(F.col("finish_time") > F.col("departure_time"), F.lit(False))
    inside = (F.col("departure_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("departure_time") < F.lit(end).cast("timestamp_ntz"))
    driver = F.trim(F.col("driver_id").cast("string"))
    sound = _finite("starting_lng") & _finite("starting_lat") & _finite("dest_lng") & _finite("dest_lat")
    return cut(raw.select("order_id", driver.alias("driver_id"), "departure_time", "finish_time", "starting_lng", "starting_lat", "dest_lng", "dest_lat", valid.alias("valid_time"), (valid & F.coalesce(inside, F.lit(False))).alias("in_window"), F.coalesce(driver != "", F.lit(False)).alias("valid_driver"), sound.alias("valid_coordinates"), F.monotonically_increasing_id().alias("row")))


def matched(rows: DataFrame, lines: DataFrame, max_match_m: float, zone: int) -> DataFrame:
    """``rows`` of :func:`checked` with the segment and distance of either end; only rows that pass all checks are matched."""
    good = rows.where("in_window and valid_driver and valid_coordinates")
    ends = good.select("row", F.explode(F.array(*(F.struct(F.lit(i).alias("end"), F.col(x).alias("lon"), F.col(y).alias("lat")) for i, (x, y) in enumerate((("starting_lng", "starting_lat"), ("dest_lng", "dest_lat")))))).alias("e"))
    found = match_points(ends.select((F.col("row") * 2 + F.col("e.end")).alias("point_id"), "e.lon", "e.lat"), lines, max_match_m, zone)
    of = lambda i, c: F.max(F.when(F.col("point_id") % 2 == i, F.col(c)))
    pairs = found.groupBy(F.shiftright("point_id", 1).alias("row")).agg(*(x for i, end in enumerate(_ENDS) for x in (of(i, "seg_id").alias(f"{end}_seg_id"), of(i, "distance").alias(f"{end}_match_distance_m"))))
    return rows.join(pairs, "row", "left")


def staging_report(rows: DataFrame) -> DataFrame:
    """How many rows of :func:`matched` each check leaves, in one pass."""
    window, driver, place = (F.col(c) for c in ("in_window", "valid_driver", "valid_coordinates"))
    pickup, dropoff = (F.col(f"{e}_seg_id").isNotNull() for e in _ENDS)
    n = F.count_if
    return rows.agg(
        F.count("*").alias("rows_read"), n(~F.col("valid_time")).alias("invalid_time_rows"), n(window).alias("rows_after_time_window"), n(window & ~driver).alias("invalid_driver_rows"), n(window & ~place).alias("invalid_coordinate_rows"),
        n(pickup).alias("pickup_matched_rows"), n(dropoff).alias("dropoff_matched_rows"), n(pickup & dropoff).alias("both_matched_rows"), n(pickup & dropoff).alias("staged_rows"),
    )


def assigned_orders(rows: DataFrame, partition: DataFrame, minutes: int = 15) -> DataFrame:
    """Labelled orders between clusters, of rows of :func:`matched` with both ends; ``partition``: (seg_id, cluster_id)."""
    staged = rows.where("pickup_seg_id is not null and dropoff_seg_id is not null")
    for end, name in zip(_ENDS, ("origin_cluster_id", "destination_cluster_id"), strict=True):
        staged = staged.join(partition.select(F.col("seg_id").alias(f"{end}_seg_id"), F.col("cluster_id").cast("string").alias(name)), f"{end}_seg_id")
    kept = staged.select("order_id", "driver_id", "departure_time", "finish_time", slot_floor("departure_time", minutes).alias("slot_start"), "pickup_seg_id", "dropoff_seg_id", "origin_cluster_id", "destination_cluster_id", "pickup_match_distance_m", "dropoff_match_distance_m")
    return service_labels(kept)


def enriched(segments: DataFrame, *features: DataFrame) -> DataFrame:
    """``segments`` with the columns of feature tables by seg_id: missing counts are 0, and columns they share stay as the segments have them."""
    out = segments
    for table in features:
        fresh = [c for c in table.columns if c not in out.columns]
        out = out.join(table.select("seg_id", *fresh), "seg_id", "left").fillna(0, [c for c, kind in table.dtypes if c in fresh and kind in ("bigint", "int", "double")])
    return out
