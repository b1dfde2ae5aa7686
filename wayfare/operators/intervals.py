"""Interval algebra over driver trips: islands, labels, carpool groups, chains, idle windows, slot expansion.

Everything up to the chains partitions by driver, so one shuffle on the driver serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayfare.functions.scalars import col, seconds_between, slot_floor


def valid_trips(trips: DataFrame) -> DataFrame:
    """Trips with both times that end after they begin."""
    return trips.where("departure_time is not null and finish_time is not null and finish_time > departure_time")


def with_islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap_s: float = 0.0) -> DataFrame:
    """Number the groups of rows of a key that overlap, from 1, as ``island``.

    A row begins a new group if it starts at or after the latest end before it; with a gap, if it starts more
    than the gap after it.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    last = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) >= last if gap_s == 0 else seconds_between(last, start) > gap_s
    fresh = F.when(last.isNull() | apart, 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def service_labels(trips: DataFrame, keys: tuple[str, ...] = ("driver_id",)) -> DataFrame:
    """``trips`` with service_type: carpool where a driver's trips overlap, exclusive where one stands alone."""
    found = with_islands(trips, list(keys), "departure_time", "finish_time", ["departure_time", "finish_time", "order_id"])
    together = F.count("*").over(Window.partitionBy(*keys, "island"))
    return found.withColumn("service_type", F.when(together > 1, "carpool").otherwise("exclusive")).drop("island")


#: The order of a driver's trips.
ORDER = ["departure_time", "finish_time", "order_id"]


def _grouped(placed: DataFrame, keys: list[str]) -> DataFrame:
    """One trip segment for each ``island`` of a key and service type; daily keys are part of its name."""
    first = F.struct(*ORDER)
    last = F.struct("finish_time", *(_descending(c) for c in ORDER))
    grouped = placed.groupBy(*keys, "service_type", "island").agg(
        F.min("departure_time").alias("trip_start"),
        F.max("finish_time").alias("trip_end"),
        F.min_by("origin_cluster_id", first).alias("origin_cluster_id"),
        F.max_by("destination_cluster_id", last).alias("destination_cluster_id"),
        F.transform(F.array_sort(F.collect_list(first)), lambda x: x["order_id"]).alias("order_ids"),
    )
    day = [F.date_format("proc_date", "yyyy-MM-dd")] if "proc_date" in keys else []
    together = F.concat_ws("_", F.lit("carpool"), F.col("driver_id").cast("string"), *day, F.col("island").cast("string"))
    label = F.when(F.col("service_type") == "carpool", together).otherwise(F.concat(F.lit("order_"), F.get("order_ids", F.lit(0)).cast("string")))
    return grouped.select(label.alias("segment_id"), *keys, "trip_start", "trip_end", "origin_cluster_id", "destination_cluster_id", "service_type", "order_ids")


def carpool_groups(trips: DataFrame, gap_s: float = 0.0, keys: tuple[str, ...] = ("driver_id",)) -> DataFrame:
    """One trip segment for each group of overlapping carpool trips.

    It begins with its first trip, ends with the latest end, leaves from the first trip's origin and arrives at the
    destination of the trip that ends last (the first such). Groups are numbered from 1 for each driver, or for each
    driver and day, which is then part of the name.
    """
    return _grouped(with_islands(trips.where("service_type = 'carpool'"), list(keys), "departure_time", "finish_time", ORDER, gap_s), list(keys))


def _descending(c: str) -> Column:
    """A number that falls as the column rises, so that the first of equals wins a maximum."""
    zero = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (-F.timestamp_diff("MICROSECOND", zero, F.col(c)) if c.endswith("_time") else -F.col(c)).alias(f"less_{c}")


def exclusive_segments(trips: DataFrame, keys: tuple[str, ...] = ("driver_id",)) -> DataFrame:
    """One trip segment for each exclusive trip."""
    return trips.where("service_type = 'exclusive'").select(
        F.concat(F.lit("order_"), F.col("order_id").cast("string")).alias("segment_id"),
        *keys,
        F.col("departure_time").alias("trip_start"),
        F.col("finish_time").alias("trip_end"),
        "origin_cluster_id",
        "destination_cluster_id",
        F.lit("exclusive").alias("service_type"),
        F.array("order_id").alias("order_ids"),
    )


def trip_segments(trips: DataFrame, gap_s: float = 0.0, mode: str = "global") -> DataFrame:
    """Exclusive and carpool segments. In ``daily`` mode each departure date is a world of its own (``proc_date``).

    Both kinds are grouped in one pass, each exclusive trip alone, so rows stay where the driver's other windows put them.
    """
    if mode not in ("global", "daily"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "daily":
        trips = trips.withColumn("proc_date", F.to_date("departure_time"))
    keys = ["driver_id"] if mode == "global" else ["proc_date", "driver_id"]
    kinds = [*keys, "service_type"]
    found = with_islands(trips.where("service_type in ('carpool', 'exclusive')"), kinds, "departure_time", "finish_time", ORDER, gap_s)
    number = F.row_number().over(Window.partitionBy(*kinds).orderBy(*ORDER))
    return _grouped(found.withColumn("island", F.when(F.col("service_type") == "exclusive", number).otherwise(F.col("island"))), keys)


def days_of(df: DataFrame) -> list[str]:
    """The key that parts days, where there is one."""
    return ["proc_date"] if "proc_date" in df.columns else []


def chain_segments(segments: DataFrame, max_gap_min: float = 60.0, keys: tuple[str, ...] = ("driver_id",)) -> DataFrame:
    """Segments with date_, chain_seq and chain_id: a chain breaks after a gap of more than the limit, or with the date."""
    by = Window.partitionBy(*keys).orderBy("trip_start", "trip_end", "segment_id")
    date = F.date_format("trip_start", "yyyy-MM-dd")
    dated = segments.withColumn("date_", date)
    gap = seconds_between(F.lag("trip_end").over(by), "trip_start") / 60
    before = F.lag("date_").over(by)
    fresh = F.when(before.isNull() | (gap > max_gap_min) | (F.col("date_") != before), 1).otherwise(0)
    in_day = Window.partitionBy(*keys, "date_").orderBy("trip_start", "trip_end", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = dated.withColumn("_new", fresh).withColumn("chain_seq", F.sum("_new").over(in_day)).drop("_new")
    return numbered.withColumn("chain_id", F.concat_ws("_", F.col("driver_id").cast("string"), "date_", F.col("chain_seq").cast("string")))


def driver_chains(chained: DataFrame) -> DataFrame:
    """One row for each chain; it ends where its last segment ends, which need not be the latest end."""
    order = F.struct("trip_start", "trip_end", "segment_id")
    return chained.groupBy(*days_of(chained), "chain_id", "driver_id", "date_", "chain_seq").agg(
        F.min("trip_start").alias("chain_start"),
        F.max_by("trip_end", order).alias("chain_end"),
        F.min_by("origin_cluster_id", order).alias("start_cluster_id"),
        F.max_by("destination_cluster_id", order).alias("end_cluster_id"),
        F.count("*").alias("num_segments"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["segment_id"]).alias("segment_ids"),
    )


def idle_windows(chained: DataFrame, max_gap_min: float = 60.0) -> DataFrame:
    """Waiting times between segments of a chain, at the place where the earlier one arrived. A negative gap is an error."""
    by = Window.partitionBy(*days_of(chained), "driver_id", "chain_id").orderBy("trip_start", "trip_end", "segment_id")
    after = chained.withColumn("idle_end", F.lead("trip_start").over(by)).where("idle_end is not null")
    minutes = seconds_between("trip_end", "idle_end") / 60
    timed = after.withColumn("idle_minutes", minutes)
    sure = timed.withColumn("idle_minutes", F.when(F.col("idle_minutes") < 0, F.raise_error("segments of a chain overlap").cast("double")).otherwise(F.col("idle_minutes")))
    return sure.where((F.col("idle_minutes") > 0) & (F.col("idle_minutes") <= max_gap_min)).select(
        *days_of(chained), "chain_id", "driver_id", F.col("destination_cluster_id").alias("cluster_id"), F.col("trip_end").alias("idle_start"), "idle_end", "idle_minutes"
    )


def expand_slots(df: DataFrame, start: str, end: str, minutes: int = 15) -> DataFrame:
    """One row for each slot that the half-open interval touches, as ``slot_start``; empty intervals have none."""
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    last = slot_floor(F.timestamp_add("MICROSECOND", F.lit(-1), F.col(end)), minutes)
    return df.where(F.col(end) > F.col(start)).withColumn("slot_start", F.explode(F.sequence(slot_floor(start, minutes), last, step)))


def calendar(bounds: DataFrame, low: str, high: str, minutes: int = 15, closed: bool = True) -> DataFrame:
    """All slots from the one that holds ``low`` to the one that holds ``high`` (or ends at it); ``bounds`` has one row, or one for each day."""
    step = F.expr(f"INTERVAL '{minutes}' MINUTE")
    to = F.col(high) if closed else F.timestamp_add("MICROSECOND", F.lit(-1), F.col(high))
    return bounds.where(F.col(low).isNotNull()).select(*days_of(bounds), F.explode(F.sequence(slot_floor(low, minutes), slot_floor(to, minutes), step)).alias("slot_start"))


def cover_all(df: DataFrame, slots: DataFrame, places: DataFrame, values: list[str], keys: tuple[str, ...] = ("slot_start", "cluster_id")) -> DataFrame:
    """Every slot with every place, of one day where there are days; missing values are 0. The two axes are the wanted grid."""
    days = days_of(slots)
    grid = slots.join(places, days) if days else slots.crossJoin(places)
    return grid.join(df, [*days, *keys], "left").select(*days, *keys, *(F.coalesce(col(v), F.lit(0)).alias(v) for v in values))
