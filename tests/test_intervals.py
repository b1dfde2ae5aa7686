import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfare.operators import demand, intervals, supply


def at(text, day="2017-06-01"):
    return dt.datetime.fromisoformat(f"{day} {text}")


TRIP = "order_id long, driver_id long, departure_time timestamp_ntz, finish_time timestamp_ntz, origin_cluster_id long, destination_cluster_id long"
SEGMENT = "segment_id string, driver_id long, trip_start timestamp_ntz, trip_end timestamp_ntz, origin_cluster_id long, destination_cluster_id long, service_type string, order_ids array<long>"


def trips(spark, rows):
    return spark.createDataFrame([(i, d, at(a), at(b), o, t) for i, d, a, b, o, t in rows], TRIP)


@pytest.mark.parametrize(
    "spans, labels",
    [
        ((("08:00", "08:10"), ("08:10", "08:20")), "ee"),
        ((("08:00", "08:10"), ("08:09", "08:20"), ("08:19", "08:30")), "ccc"),
        ((("08:00", "08:10"), ("08:05", "08:08")), "cc"),
        ((("08:00", "08:10"),), "e"),
    ],
)
def test_labels(spark, spans, labels):
    df = trips(spark, [(i, 1, a, b, 1, 2) for i, (a, b) in enumerate(spans)])
    got = {r.order_id: r.service_type[0] for r in intervals.service_labels(df).collect()}
    assert "".join(got[i] for i in range(len(spans))) == labels


def test_od_slots_and_bounds(spark):
    times = ["08:00:00", "08:07:00", "08:14:59", "08:15:00", "08:44:59", "08:45:00"]
    kinds = ["exclusive", "carpool"] * 3
    df = spark.createDataFrame([(at(t), 1, 2 if i < 2 else 3, k) for i, (t, k) in enumerate(zip(times, kinds))], "departure_time timestamp_ntz, origin_cluster_id long, destination_cluster_id long, service_type string")
    got = {(r.slot_start, r.destination_cluster_id): (r.exclusive_count, r.carpool_count, r.total_count) for r in demand.od_slots(df).collect()}
    assert got[at("08:00"), 2] == (1, 1, 2) and got[at("08:00"), 3] == (1, 0, 1) and (at("08:45"), 3) in got
    slots = intervals.calendar(demand.slot_bounds(df), "first_slot", "last_slot").collect()
    assert [r.slot_start for r in slots] == [at("08:00"), at("08:15"), at("08:30"), at("08:45")]


def test_carpool_groups(spark):
    df = trips(spark, [(1, 10, "08:00", "08:20", 1, 2), (2, 10, "08:10", "08:30", 3, 4), (3, 10, "08:30", "08:45", 5, 6), (4, 20, "09:00", "09:15", 7, 8)]).withColumn("service_type", F.lit("carpool"))
    got = {tuple(r.order_ids): (r.segment_id, r.origin_cluster_id, r.destination_cluster_id) for r in intervals.carpool_groups(df).collect()}
    assert got == {(1, 2): ("carpool_10_1", 1, 4), (3,): ("carpool_10_2", 5, 6), (4,): ("carpool_20_1", 7, 8)}


def test_chains_break_after_the_gap_and_with_the_date(spark):
    rows = [("s1", at("08:00"), at("08:30")), ("s2", at("09:30"), at("10:00")), ("s3", at("11:01"), at("11:30")), ("s4", at("00:10", "2017-06-02"), at("00:20", "2017-06-02"))]
    df = spark.createDataFrame([(i, 1, a, b, 1, 2, "exclusive", [1]) for i, a, b in rows], SEGMENT)
    chained = intervals.chain_segments(df)
    assert {r.segment_id: r.chain_seq for r in chained.collect()} == {"s1": 1, "s2": 1, "s3": 2, "s4": 1}
    assert sorted(tuple(r.segment_ids) for r in intervals.driver_chains(chained).collect()) == [("s1", "s2"), ("s3",), ("s4",)]
    (idle,) = intervals.idle_windows(chained).collect()
    assert idle.idle_minutes == 60 and idle.cluster_id == 2


def test_overlapping_segments_of_a_chain_are_an_error(spark):
    df = spark.createDataFrame([("a", 1, at("08:00"), at("08:30"), 1, 2, "exclusive", [1]), ("b", 1, at("08:10"), at("08:40"), 1, 2, "exclusive", [2])], SEGMENT)
    with pytest.raises(Exception, match="overlap"):
        intervals.idle_windows(intervals.chain_segments(df)).collect()


def test_slots_are_half_open(spark):
    df = spark.createDataFrame([(1, at("08:01"), at("08:14")), (2, at("08:14"), at("08:16")), (3, at("08:15"), at("08:30")), (4, at("08:15"), at("08:15"))], "driver_id long, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r.driver_id, r.slot_start) for r in intervals.expand_slots(df, "a", "b").collect())
    assert got == [(1, at("08:00")), (2, at("08:00")), (2, at("08:15")), (3, at("08:15"))]


def test_fleet_bound(spark):
    idle = spark.createDataFrame([("c", 1, 2, at("08:00"), at("08:10"), 10.0)], "chain_id string, driver_id long, cluster_id long, idle_start timestamp_ntz, idle_end timestamp_ntz, idle_minutes double")
    moving = spark.createDataFrame([("a", 1, at("08:00"), at("08:10"), 1, 2, "exclusive", [1]), ("b", 2, at("08:00"), at("08:10"), 2, 3, "exclusive", [2])], SEGMENT)
    got = {r.cluster_id: (r.fleet_lower_bound, r.global_fleet_lower_bound) for r in supply.fleet_bound(idle, moving).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 2)}


def test_daily_mode_keeps_days_apart(spark):
    df = spark.createDataFrame([(1, 1, at("23:50"), at("00:20", "2017-06-02"), 1, 2), (2, 1, at("00:05", "2017-06-02"), at("00:30", "2017-06-02"), 2, 3)], TRIP)
    found = intervals.service_labels(df)
    assert intervals.trip_segments(found, mode="global").count() == 1 and intervals.trip_segments(found, mode="daily").count() == 2
    assert [r.order_id for r in supply.day_slice(df, "2017-06-02", "2017-06-02").collect()] == [2]
    with pytest.raises(ValueError):
        intervals.trip_segments(found, mode="weekly")


def test_empty_input(spark):
    t = supply.supply_tables(intervals.service_labels(spark.createDataFrame([], TRIP)))
    assert all(df.count() == 0 for df in t.values())
