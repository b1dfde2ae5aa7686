"""Origin-destination demand on fixed slots, segment order features, and staging counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayfare.functions.scalars import slot_floor

OD = ["slot_start", "origin_cluster_id", "destination_cluster_id"]


def od_slots(labelled: DataFrame, minutes: int = 15) -> DataFrame:
    """Trips by slot, origin and destination, of either service type and together. Conditional counts, so one shuffle."""
    count = lambda kind: F.count_if(F.col("service_type") == kind)
    return (
        labelled.withColumn("slot_start", slot_floor("departure_time", minutes))
        .groupBy(*OD)
        .agg(count("exclusive").alias("exclusive_count"), count("carpool").alias("carpool_count"))
        .withColumn("total_count", F.col("exclusive_count") + F.col("carpool_count"))
    )


def slot_bounds(trips: DataFrame, minutes: int = 15) -> DataFrame:
    return trips.agg(F.min(slot_floor("departure_time", minutes)).alias("first_slot"), F.max(slot_floor("departure_time", minutes)).alias("last_slot"))


def cluster_order(clusters: DataFrame) -> DataFrame:
    """(cluster_index, cluster_id) with numeric ids first by value, then the others as text.

    Ranks a small dimension: the distinct clusters.
    """
    from pyspark.sql import Window

    text = F.col("cluster_id").cast("string")
    number = F.expr("try_cast(cluster_id AS BIGINT)")
    distinct = clusters.select(text.alias("cluster_id")).where("cluster_id is not null").distinct()
    by = Window.orderBy(number.isNull(), number, "cluster_id")
    return distinct.select((F.row_number().over(by) - 1).cast("long").alias("cluster_index"), "cluster_id")


def od_tensor(od: DataFrame, slots: DataFrame, index: DataFrame) -> DataFrame:
    """The dense tensor in long form: (slot_start, o, d, exclusive, carpool, total) for every slot and pair of clusters."""
    o = index.select(F.col("cluster_index").alias("o"), F.col("cluster_id").alias("o_id"))
    d = index.select(F.col("cluster_index").alias("d"), F.col("cluster_id").alias("d_id"))
    named = od.select("slot_start", F.col("origin_cluster_id").cast("string").alias("o_id"), F.col("destination_cluster_id").cast("string").alias("d_id"), "exclusive_count", "carpool_count", "total_count")
    cells = slots.crossJoin(o).crossJoin(d).join(named, ["slot_start", "o_id", "d_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return cells.select("slot_start", "o", "d", zero("exclusive_count").alias("y_exclusive"), zero("carpool_count").alias("y_carpool"), zero("total_count").alias("y_total"))


def od_rows(tensor: DataFrame) -> DataFrame:
    """One array of totals for each slot and origin, in the order of destinations."""
    return tensor.groupBy("slot_start", "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "y_total"))), lambda x: x["y_total"]).alias("row"))


def staging_counters(raw: DataFrame, start: str, end: str) -> DataFrame:
    """How many raw orders each check of staging turns away, in one pass; checks after the window are independent."""
    ok_time = F.coalesce(F.col("finish_time") > F.col("departure_time"), F.lit(False))
    inside = ok_time & (F.col("departure_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("departure_time") < F.lit(end).cast("timestamp_ntz"))
    driver = F.coalesce(F.trim(F.col("driver_id").cast("string")) != "", F.lit(False))
    placed = F.col("origin_cluster_id").isNotNull() & F.col("destination_cluster_id").isNotNull()
    n = lambda test: F.count_if(test)
    return raw.agg(
        F.count("*").alias("rows_read"),
        n(~ok_time).alias("invalid_time"),
        n(ok_time & ~inside).alias("outside_window"),
        n(inside).alias("in_window"),
        n(inside & ~driver).alias("invalid_driver"),
        n(inside & ~placed).alias("unmatched"),
        n(inside & driver & placed).alias("staged"),
    )


def order_features(trips: DataFrame, origin: str, destination: str) -> DataFrame:
    """Pickup and dropoff features of each segment: peaks, nights, weekdays. Trips are unpivoted and grouped once."""
    hour, week = F.hour("departure_time"), F.weekday("departure_time") < 5
    ends = trips.select(
        F.explode(F.array(F.struct(F.col(origin).alias("seg_id"), F.lit(1).alias("p")), F.struct(F.col(destination).alias("seg_id"), F.lit(0).alias("p")))).alias("e"), hour.alias("h"), week.alias("w")
    ).select("e.seg_id", (F.col("e.p") == 1).alias("p"), "h", "w")
    n = F.count_if
    p, h = F.col("p"), F.col("h")
    return (
        ends.where("seg_id is not null")
        .groupBy("seg_id")
        .agg(
            n(p).alias("pickup_count"),
            n(~p).alias("dropoff_count"),
            F.count("*").alias("order_total"),
            n(p & h.between(7, 9)).alias("morning_peak_pickups"),
            n(p & h.between(17, 18)).alias("evening_peak_pickups"),
            n(p & ((h >= 22) | (h < 6))).alias("night_pickups"),
            n(p & F.col("w")).alias("weekday_pickups"),
            n(p & ~F.col("w")).alias("weekend_pickups"),
        )
        .withColumn("pickup_dropoff_imbalance", F.col("pickup_count") - F.col("dropoff_count"))
        .withColumn("weekday_weekend_diff", F.col("weekday_pickups") - F.col("weekend_pickups"))
    )


def od_pairs(trips: DataFrame) -> DataFrame:
    return trips.groupBy("origin_cluster_id", "destination_cluster_id").agg(F.count("*").alias("order_count"))


def hourly_od(trips: DataFrame) -> DataFrame:
    """Weekday trips by hour, origin and destination, where both ends are known."""
    known = trips.where("origin_cluster_id is not null and destination_cluster_id is not null").where(F.weekday("departure_time") < 5)
    return known.groupBy(slot_floor("departure_time", 60).alias("slot_start"), "origin_cluster_id", "destination_cluster_id").agg(F.count("*").alias("order_count"))
