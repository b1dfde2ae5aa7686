"""Supply on fixed slots: available vehicles, vehicles in service, fleet lower bounds, and the join with demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wayfare.functions.scalars import seconds_between
from wayfare.operators.intervals import calendar, chain_segments, cover_all, days_of, driver_chains, expand_slots, idle_windows, trip_segments


def available(idle: DataFrame, minutes: int = 15) -> DataFrame:
    """Distinct idle drivers by slot and cluster."""
    return expand_slots(idle, "idle_start", "idle_end", minutes).groupBy(*days_of(idle), "slot_start", "cluster_id").agg(F.count_distinct("driver_id").alias("available_vehicles"))


def in_service(segments: DataFrame, minutes: int = 15) -> DataFrame:
    """Distinct driving drivers by slot, origin and destination."""
    return expand_slots(segments, "trip_start", "trip_end", minutes).groupBy(*days_of(segments), "slot_start", "origin_cluster_id", "destination_cluster_id").agg(F.count_distinct("driver_id").alias("in_service_vehicles"))


def activity(chained: DataFrame, max_gap_min: float = 60.0, minutes: int = 15) -> DataFrame:
    """(slot_start, cluster_id, driver_id) once each: where drivers leave, arrive or wait. One pass over the chained segments."""
    days = days_of(chained)
    by = Window.partitionBy(*days, "driver_id", "chain_id").orderBy("trip_start", "trip_end", "segment_id")
    span = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("cluster_id"))
    waits = (F.col("_next") > F.col("trip_end")) & (seconds_between("trip_end", "_next") <= 60 * max_gap_min)
    spans = F.array(span("trip_start", "trip_end", "origin_cluster_id"), span("trip_start", "trip_end", "destination_cluster_id"), F.when(waits, span("trip_end", "_next", "destination_cluster_id")))
    each = chained.withColumn("_next", F.lead("trip_start").over(by)).select(*days, "driver_id", F.explode(spans).alias("x")).where("x is not null").select(*days, "driver_id", "x.*")
    return expand_slots(each.where("cluster_id is not null"), "a", "b", minutes).select(*days, "slot_start", "cluster_id", "driver_id").distinct()


def fleet(seen: DataFrame) -> DataFrame:
    """Distinct drivers seen in a cluster by slot, and by slot alone; ``seen`` as :func:`activity` gives it."""
    key = [*days_of(seen), "slot_start"]
    local = seen.groupBy(*key, "cluster_id").agg(F.count("driver_id").alias("fleet_lower_bound"))
    return local.join(fleet_anywhere(seen), key)


def fleet_anywhere(seen: DataFrame) -> DataFrame:
    return seen.groupBy(*days_of(seen), "slot_start").agg(F.count_distinct("driver_id").alias("global_fleet_lower_bound"))


def fleet_bound(idle: DataFrame, segments: DataFrame, minutes: int = 15) -> DataFrame:
    """:func:`fleet` of idle windows and segments given apart."""
    days = days_of(segments)
    waiting = expand_slots(idle, "idle_start", "idle_end", minutes).select(*days, "slot_start", "cluster_id", "driver_id")
    moving = expand_slots(segments, "trip_start", "trip_end", minutes)
    seen = moving.select(*days, "slot_start", F.explode(F.array("origin_cluster_id", "destination_cluster_id")).alias("cluster_id"), "driver_id").unionByName(waiting)
    return fleet(seen.where("cluster_id is not null").distinct())


def axes(segments: DataFrame, minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """The slots from the first trip to the last, and the clusters where trips end; idle windows are between trips, so they add none."""
    days = days_of(segments)
    ends = segments.select(*days, F.explode(F.array("origin_cluster_id", "destination_cluster_id")).alias("cluster_id"))
    bounds = segments.groupBy(*days).agg(F.min("trip_start").alias("a"), F.max("trip_end").alias("b"))
    return calendar(bounds, "a", "b", minutes, closed=False), ends.where("cluster_id is not null").distinct()


def supply_tables(labelled: DataFrame, max_gap_min: float = 60.0, gap_s: float = 0.0, minutes: int = 15, mode: str = "global") -> dict[str, DataFrame]:
    """All supply tables of labelled trips, each lazy. In daily mode every table is made for each ``proc_date`` apart and has that column."""
    segments = trip_segments(labelled, gap_s, mode)
    chained = chain_segments(segments, max_gap_min, ("driver_id",) if mode == "global" else ("proc_date", "driver_id"))
    idle = idle_windows(chained, max_gap_min)
    return {"segments": segments, "chains": driver_chains(chained), "idle": idle, "available": available(idle, minutes), "in_service": in_service(segments, minutes), "fleet": fleet(activity(chained, max_gap_min, minutes))}


def whole_grid(tables: dict[str, DataFrame], minutes: int = 15) -> dict[str, DataFrame]:
    """``tables`` with available and fleet for every slot and cluster, 0 where there are none; a slot's whole fleet in each of its rows."""
    slots, places = axes(tables["segments"], minutes)
    key = [*days_of(slots), "slot_start"]
    spread = cover_all(tables["fleet"], slots, places, ["fleet_lower_bound", "global_fleet_lower_bound"])
    top = spread.groupBy(*key).agg(F.max("global_fleet_lower_bound").alias("global_fleet_lower_bound"))
    return tables | {"available": cover_all(tables["available"], slots, places, ["available_vehicles"]), "fleet": spread.drop("global_fleet_lower_bound").join(top, key)}


def available_grid(labelled: DataFrame, minutes: int = 15, mode: str = "global") -> DataFrame:
    """Available vehicles for every slot and cluster, 0 where there are none."""
    return whole_grid(supply_tables(labelled, minutes=minutes, mode=mode), minutes)["available"]


def with_demand(demand: DataFrame, free: DataFrame, fleet: DataFrame) -> DataFrame:
    """Demand rows with the supply of their slot and origin; missing supply is null. Keys of supply must be unique."""
    key = lambda df: df.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return demand.join(key(free), ["slot_start", "cluster_id"], "left").join(key(fleet), ["slot_start", "cluster_id"], "left")


def day_slice(trips: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Trips that depart on days from ``start`` to ``end``, both included."""
    day = F.to_date("departure_time")
    if start:
        trips = trips.where(day >= F.lit(start).cast("date"))
    return trips.where(day <= F.lit(end).cast("date")) if end else trips


def departure_dates(trips: DataFrame, first: int | None = None) -> DataFrame:
    """The distinct departure dates in order, the first few if asked."""
    dates = trips.where("departure_time is not null").select(F.to_date("departure_time").alias("date_")).distinct().orderBy("date_")
    return dates.limit(first) if first else dates
