import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wayfare.functions import scalars as s
from wayfare.operators import regions, roads, selection
from wayfare.plans.components import connected_components
from wayfare.sources import config, tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert value(spark, s.bearing(lit(0.0), lit(-1.0))) == 90 and value(spark, s.angle_between(lit(170.0), lit(10.0))) == 20
    assert value(spark, s.ratio(lit(1.0), lit(0.0))) is None and value(spark, s.ratio(lit(1.0), lit(2.0))) == 0.5
    assert [value(spark, s.truth(lit(x))) for x in ("TRUE", "1", "yes", "1.0", "no")] == [True, True, True, False, False] and value(spark, s.truth(lit(None))) is False
    assert value(spark, s.road_name(lit(None))) == "" and value(spark, s.road_name(lit(" a b "))) == "ab"
    assert value(spark, s.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0 and abs(value(spark, s.cosine(F.array(lit(1.0), lit(1.0)), F.array(lit(2.0), lit(2.0)))) - 1) < 1e-12
    assert value(spark, s.inverse_difference(lit(1.0), lit(9.0), 4.0)) == 0 and value(spark, s.setting_label(lit(0.2))) == "0p2"
    assert [round(value(spark, s.capacity_hinge(lit(float(v)), lit(10.0))), 9) for v in (10, 3, 17)] == [0, 0.04, 0.04]
    with pytest.raises(ValueError):
        s.slot_floor("x", 0)


def test_projection(spark):
    """Beijing's centre in zone 50; the known values are of the standard transverse Mercator projection."""
    x, y = s.utm_xy(F.lit(117.0), F.lit(0.0))
    assert abs(value(spark, x) - 500000) < 1e-3 and abs(value(spark, y)) < 1e-3
    x, y = s.utm_xy(F.lit(116.3975), F.lit(39.9087))
    assert abs(value(spark, x) - 448500) < 300 and abs(value(spark, y) - 4417800) < 1500


def test_seg_ids_follow_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    got = roads.with_seg_ids(df, ["k"]).orderBy("k").collect()
    assert [r.seg_id for r in got] == [f"seg_{i:07d}" for i in range(1000)]


def test_road_edges_and_adjacency(spark):
    edges = spark.createDataFrame([("s1", "s2", 1.5), ("s1", "s3", 2.5), ("s2", "s3", 10.0), ("s3", "s4", 3.0)], "seg_id_a string, seg_id_b string, base_weight double")
    where = spark.createDataFrame([("s1", "1"), ("s2", "2"), ("s3", "2"), ("s4", "3")], "seg_id string, cluster_id string")
    got = {(r.cluster_a, r.cluster_b): (r.weight, r.edge_count) for r in regions.cluster_road_edges(edges, where).collect()}
    assert got == {("1", "2"): (4.0, 2), ("2", "3"): (3.0, 1)}
    with pytest.raises(ValueError):
        regions.cluster_road_edges(edges.drop("base_weight"), where)
    cells = regions.normalized_adjacency(spark.createDataFrame([(1, 2, 3.0)], "a long, b long, weight double"), spark.createDataFrame([(1,), (2,)], "node long"), symmetric=False).collect()
    assert {(r.row, r.col): r.value for r in cells} == {(1, 1): 0.25, (1, 2): 0.75, (2, 2): 0.25, (2, 1): 0.75}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 2)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    text = edges.select(*(F.col(c).cast("string").alias(c) for c in "ab"))
    assert {(r.node, r.component) for r in connected_components(text).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "4")}
    chain = spark.range(300).select("id", (F.col("id") + 1).alias("b"))
    assert connected_components(chain, "id", "b").select("component").distinct().count() == 1
    assert connected_components(edges.limit(0)).count() == 0


def test_names_and_tags(spark):
    df = spark.createDataFrame([(["x", "y"], 1, 2)], "`a:b` array<string>, c long, `C-d` long").withColumnRenamed("C-d", "a-b")
    assert roads.safe_names(df).columns == ["a_b", "c", "a_b_1"] and roads.safe_names(df).first()["a_b"] == "x"
    assert roads.ensure_columns(df, {"z": "string"}).first()["z"] is None


def test_keep_last_and_front(spark):
    m = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 1, None)], "k string, n long, v double")
    assert {(r.k, r.n) for r in selection.keep_last(m, ["k"], "n").collect()} == {("a", 2), ("b", 1)}
    assert {r.n for r in selection.pareto(m, "k", {"v": "min"}).collect()} == {1}


def test_csv_and_cache(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,driver_id,starting_lng,starting_lat,dest_lng,dest_lat,departure_time,finish_time\n1,d,1.5,x,2,3,2017-06-01 08:00:00,bad\n")
    (row,) = tables.read_orders_csv(spark, str(tmp_path / "o.csv")).collect()
    assert row.departure_time == dt.datetime(2017, 6, 1, 8) and row.finish_time is None and row.starting_lat is None and row.starting_lng == 1.5
    tables.write_csv_gz(spark.createDataFrame([(1, [1, 2])], "a long, b array<long>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().b == "[1,2]"
    assert tables.try_read(spark, str(tmp_path / "none"), "a long").count() == 0
    built = []
    for _ in range(2):
        df = tables.cached(spark, str(tmp_path / "cache"), lambda: built.append(1) or spark.range(3))
        assert df.count() == 3
    assert built == [1]
    tables.write_json({"a": float("nan"), "b": [1, {"c": float("inf")}]}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": None, "b": [1, {"c": None}]}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("supply: {mode: global}\npartitioning: {clusters: 5, lambda_c: [1.0]}\n")
    c = config.load_config(tmp_path / "c.yaml")
    assert c.supply.mode == "global" and c.partitioning.clusters == 5 and c.demand.slot_minutes == 15
    (tmp_path / "c.yaml").write_text("scopes: {default: {edges: raw/e, label: all}, ring: {label: ring, out: 's3://b/x'}}\nactive_scope: ring\n")
    c = config.load_config(tmp_path / "c.yaml")
    assert c.scope["label"] == "ring" and c.path("edges", "/data/") == "/data/raw/e" and c.path("out", "/data") == "s3://b/x"
    with pytest.raises(ValueError):
        c.path("none")
    for text in ("supply: {mode: weekly}", "demand: {slot: 1}", "active_scope: none", "partitioning: {lambda_r: []}"):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.load_config(tmp_path / "c.yaml")


def test_scratch(spark, tmp_path):
    from wayfare.plans import shared

    path = shared.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    shared.drop_path(spark, path)
    assert tables.try_read(spark, path, "id long").count() == 0 and path not in shared._scratch

    class Cluster:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_chain_numbers_go_on_after_a_chain_was_given_out(spark, tmp_path):
    """The watermark closes a driver's first chain before the second arrives; the second is number 2."""
    from wayfare.streaming import twins

    schema = "driver_id long, a string, b string"
    batches = [[(1, "08:00", "08:30")], [(2, "10:30", "10:40")], [(2, "10:45", "10:50")], [(1, "11:00", "11:10")], [(2, "14:00", "14:10")], [(2, "14:20", "14:30")]]
    q = None
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).select("driver_id", *(F.to_timestamp(F.concat(F.lit("2017-06-01 "), c)).alias(name) for c, name in (("a", "trip_start"), ("b", "trip_end"))))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = twins.chain_stream(stream, late="10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination(120)
    got = sorted((r.chain_seq, r.num_segments) for r in spark.read.parquet(str(tmp_path / "out")).where("driver_id = 1").collect())
    assert got == [(1, 1), (2, 1)]


def test_streams(spark, tmp_path):
    from wayfare.streaming import twins

    rows = [(1, f"2017-06-01 {a}:00", f"2017-06-01 {b}:00", 1, 2) for a, b in (("08:00", "08:30"), ("09:00", "09:10"), ("11:00", "11:05"))] + [(2, "2017-06-03 00:00:00", "2017-06-03 00:10:00", 1, 2)]
    df = spark.createDataFrame(rows, "driver_id long, a string, b string, origin_cluster_id long, destination_cluster_id long").select(
        "driver_id", F.to_timestamp("a").alias("trip_start"), F.to_timestamp("b").alias("trip_end"), F.to_timestamp("a").alias("departure_time"), "origin_cluster_id", "destination_cluster_id"
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, build in (("od", twins.od_stream), ("chains", twins.chain_stream)):
        q = build(stream()).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("od").where("slot_start < '2017-06-02'").count() == 3
    got = {(r.chain_seq, r.num_segments) for r in spark.table("chains").where("driver_id = 1").collect()}
    assert (1, 2) in got
