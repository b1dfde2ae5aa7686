"""Whole runs on tiny files."""

import json

from pyspark.sql import functions as F

from wayfare import jobs
from wayfare.operators import staging
from wayfare.sources import tables
from wayfare.sources.config import Demand, Supply

ORDERS = """order_id,driver_id,departure_time,finish_time,origin_cluster_id,destination_cluster_id,service_type
1,1,2017-06-01 23:50:00,2017-06-02 00:20:00,1,2,exclusive
2,1,2017-06-02 00:30:00,2017-06-02 00:45:00,2,3,exclusive
3,2,2017-06-02 08:00:00,2017-06-02 08:20:00,4,5,carpool
4,2,2017-06-02 08:10:00,2017-06-02 08:30:00,6,7,carpool
5,2,2017-06-02 09:10:00,2017-06-02 09:00:00,6,7,carpool
"""


def test_daily_supply(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS)
    orders = jobs.read_labelled(spark, str(tmp_path / "orders.csv"))
    out = jobs.run_supply(spark, orders, str(tmp_path / "supply"), text=True)
    assert out["days_processed"] == 2 and out["segments_rows"] == 3 and (out["orders_loaded"], out["valid_orders"], out["invalid_orders"]) == (5, 4, 1)
    assert json.loads((tmp_path / "supply/run_summary.json").read_text())["days_processed"] == 2
    read = lambda name: spark.read.parquet(str(tmp_path / "supply" / name))
    assert {str(r.proc_date) for r in read("segments").collect()} == {"2017-06-01", "2017-06-02"}
    assert {r.date_ for r in read("chains").collect()} == {"2017-06-01", "2017-06-02"}
    assert "2017-06-02 00:15:00" in {str(r.slot_start) for r in read("in_service").collect()}
    for name in set(tables.SUPPLY_COLUMNS) - {"idle"}:  # no driver waits
        assert (tmp_path / "supply" / name / "proc_date=2017-06-02").exists() and "proc_date" in read(name).columns
    days = {str(r.proc_date): r.n for r in read("fleet").groupBy("proc_date").agg(F.count("*").alias("n")).collect()}
    assert days == {"2017-06-01": 3 * 2, "2017-06-02": 32 * 4}
    assert spark.read.csv(str(tmp_path / "supply/segments.csv.gz"), header=True).count() == 3
    part = jobs.run_supply(spark, orders, str(tmp_path / "part"), start="2017-06-02", end="2017-06-02")
    assert part["days_processed"] == 1 and {r.date_ for r in spark.read.parquet(str(tmp_path / "part/chains")).collect()} == {"2017-06-02"}
    first = jobs.run_supply(spark, orders, str(tmp_path / "first"), sample_days=1)
    assert first["days_processed"] == 1 and first["orders_loaded"] == 1
    one = jobs.run_supply(spark, orders, str(tmp_path / "one"), Supply(mode="global"))
    assert one["idle_rows"] == 0 and "proc_date" not in spark.read.parquet(str(tmp_path / "one/idle")).columns


def test_daily_names_are_unique(spark):
    rows = [(10 * d + i, 7, f"2017-06-0{d} 08:{i}0:00", f"2017-06-0{d} 08:{i}5:00" if i else f"2017-06-0{d} 08:15:00", 1, 2) for d in (1, 2) for i in (0, 1)]
    df = spark.createDataFrame(rows, "order_id long, driver_id long, a string, b string, origin_cluster_id long, destination_cluster_id long")
    trips = df.select("order_id", "driver_id", F.expr("cast(a as timestamp_ntz)").alias("departure_time"), F.expr("cast(b as timestamp_ntz)").alias("finish_time"), "origin_cluster_id", "destination_cluster_id", F.lit("carpool").alias("service_type"))
    found = jobs.supply.supply_tables(trips, mode="daily")
    assert sorted(r.segment_id for r in found["segments"].collect()) == ["carpool_7_2017-06-01_1", "carpool_7_2017-06-02_1"]
    assert all("proc_date" in t.columns for t in found.values())


RAW = """order_id,note,driver_id,starting_lng,starting_lat,dest_lng,dest_lat,departure_time,finish_time
o1,,d1,0.0002,0.0,0.0102,0.0,2017-10-16 08:01:00,2017-10-16 08:20:00
o2,,d1 ,0.0003,0.0,0.0103,0.0,2017-10-16 08:05:00,2017-10-16 08:25:00
o3,,d2,0.0102,0.0,0.0002,0.0,2017-10-16 08:15:00,2017-10-16 08:30:00
o4,,d3,0.0102,0.0,0.0002,0.0,2017-10-16 08:15:00,2017-10-16 08:10:00
o5,,d3,0.0102,0.0,0.0002,0.0,2017-10-18 08:15:00,2017-10-18 08:30:00
o6,,  ,0.0102,0.0,0.0002,0.0,2017-10-16 08:15:00,2017-10-16 08:30:00
o7,,d4,0.0102,x,0.0002,0.0,2017-10-16 08:15:00,2017-10-16 08:30:00
o8,,d5,0.0102,0.0,0.5,0.0,2017-10-16 08:15:00,2017-10-16 08:30:00
"""


def test_regions_from_raw_orders(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(RAW)
    (tmp_path / "poi.csv").write_text("lon,lat,cat\n0.0002,0.0,food\n0.0102,0.0,office\n0.9,0.0,far\n")
    lines = spark.createDataFrame([("s1", "1", 100.0, [(0.0, 0.0), (0.0005, 0.0), (0.001, 0.0)]), ("s2", "2", 100.0, [(0.01, 0.0), (0.011, 0.0)])], "seg_id string, cluster_id string, length double, geom array<struct<x:double,y:double>>")
    lines.write.parquet(str(tmp_path / "partition"))
    spark.createDataFrame([("s1", "s2", 2.0)], "seg_id_a string, seg_id_b string, base_weight double").write.parquet(str(tmp_path / "relation"))
    config = {
        "inputs": {"orders": [str(tmp_path / "orders.csv")], "poi": str(tmp_path / "poi.csv"), "partition": str(tmp_path / "partition"), "relation": str(tmp_path / "relation")}, "poi_columns": {"category": "cat"},
        "window": {"start": "2017-10-16 00:00:00", "end": "2017-10-17 00:00:00"}, "zone": 31, "degrees": True, "output": str(tmp_path / "out"), "demand": {"poi_match_m": 250.0, "poi_top_k": 1, "distance_top_k": 1, "decay_m": 1000.0},
    }
    paths = jobs.run_regions(spark, config)
    read = lambda name: spark.read.parquet(paths[name])
    od = read("cluster_od").agg(F.sum("carpool_count").alias("c"), F.sum("exclusive_count").alias("x")).first()
    assert (od.c, od.x) == (2, 1)
    assigned = {r.order_id: r for r in read("orders_region_assigned").collect()}
    assert set(assigned) == {"o1", "o2", "o3"} and assigned["o1"].origin_cluster_id == "1" and assigned["o1"].pickup_seg_id == "s1" and assigned["o1"].driver_id == "d1" and assigned["o2"].driver_id == "d1"
    assert {str(r.slot_start) for r in read("od_tensor").collect()} == {"2017-10-16 08:00:00", "2017-10-16 08:15:00"} and read("od_tensor").count() == 2 * 2 * 2
    assert [(r.a, r.b, r.weight, r.edge_count) for r in read("cluster_graph_road_edges").collect()] == [("1", "2", 2.0, 1)] and read("cluster_graph_distance_edges").count() == 1
    assert read("cluster_index").count() == 2 and read("cluster_graph_road_adjacency_normalized").count() == 4 and read("cluster_graph_poi_edges").count() == 0
    meta = json.loads((tmp_path / "out/metadata.json").read_text())["staging"]
    assert meta == {"rows_read": 8, "invalid_time_rows": 1, "rows_after_time_window": 6, "invalid_driver_rows": 1, "invalid_coordinate_rows": 1, "pickup_matched_rows": 4, "dropoff_matched_rows": 3, "both_matched_rows": 3, "staged_rows": 3}
    assert (tmp_path / "out/orders_region_assigned.csv.gz").exists()


def test_manifest_goes_on(spark, tmp_path):
    path, keys = str(tmp_path / "manifest"), ["run"]
    rows = lambda *x: spark.createDataFrame(list(x), "run string, value double")
    tables.append_manifest(spark, path, rows(("a", 1.0), ("b", 2.0)), keys)
    last = tables.append_manifest(spark, path, rows(("a", 3.0)), keys)
    assert {r.run: r.value for r in last.collect()} == {"a": 3.0, "b": 2.0}
    assert [r.run for r in tables.unfinished(rows(("a", 0.0), ("c", 0.0)), last, keys).collect()] == ["c"]


def test_enrichment(spark):
    segments = spark.createDataFrame([(1, 10.0), (2, 20.0)], "seg_id long, length double")
    got = staging.enriched(segments, spark.createDataFrame([(1, 5, "x", 99.0)], "seg_id long, n long, kind string, length double"))
    assert {tuple(r) for r in got.collect()} == {(1, 10.0, 5, "x"), (2, 20.0, 0, None)}
    assert Demand().slot_minutes == 15
