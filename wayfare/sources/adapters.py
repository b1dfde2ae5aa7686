"""The domain's tables over the driver tables, so that every operator runs on given data.

Trips come from ``events``, road segments from ``part``, points and lines from ``customer`` and ``supplier``,
flows between nations from the order tables, and run tables for selection from ``part`` by brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CLUSTERS = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, driver_id, departure_time, finish_time, origin_cluster_id, destination_cluster_id."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    finish = F.expr("ts + make_dt_interval(0, 0, 0, CAST(value * 60 AS DECIMAL(18, 6)))")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("driver_id"), F.col("ts").alias("departure_time"), finish.alias("finish_time"), (F.col("event_id") % CLUSTERS).alias("origin_cluster_id"), (k % CLUSTERS).alias("destination_cluster_id")
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.operators.intervals import valid_trips

    return valid_trips(raw_trips(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.operators.intervals import service_labels

    return service_labels(trips(spark, sf_dir))


def segment_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips whose ends are segments."""
    return trips(spark, sf_dir).withColumns({"origin_seg_id": F.col("order_id") % 500, "destination_seg_id": F.col("driver_id")})


def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("seg_id"), F.expr("p_partkey div 3").alias("u"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_partkey div 6 ELSE p_partkey div 3 + 1 END").alias("v"), F.col("p_brand").alias("name"), (key % 11).alias("osmid"), F.col("p_type").alias("highway"),
        F.col("p_retailprice").cast("double").alias("length"), ((key * 37) % 180).cast("double").alias("bearing"), (key % 10).alias("cluster_id"), ((key * 7919) % 1000).cast("double").alias("x"), ((key * 104729) % 1000).cast("double").alias("y"), (F.col("p_size") <= 5).alias("is_connector"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_segments(spark, sf_dir).where("not is_connector").drop("is_connector")


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_segments(spark, sf_dir).where("is_connector").drop("is_connector")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.operators.relation import relation_edges

    return relation_edges(segments(spark, sf_dir), connectors(spark, sf_dir))


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("seg_id"), F.col("event_type").alias("category"))


def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.operators.demand import order_features

    return order_features(segment_trips(spark, sf_dir), "origin_seg_id", "destination_seg_id")


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments by day between nations, as flows."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("destination_cluster_id"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("origin_cluster_id"))
    return line.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").groupBy(F.col("l_shipdate").alias("slot_start"), "origin_cluster_id", "destination_cluster_id").agg(F.count("*").alias("order_count"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").cast("double").alias("px"), (F.col("c_custkey") % 1000).cast("double").alias("py"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("s_acctbal").cast("double"), ((F.col("s_suppkey") * 37) % 1000).cast("double")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seg_id"), x.alias("x0"), y.alias("y0"), (x + 100.0).alias("x1"), (y + 50.0).alias("y1"))


#: A rectangle that parts the polylines.
BOUNDARY = [(0.0, 0.0), (5000.0, 0.0), (5000.0, 600.0), (0.0, 600.0)]


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two legs, one up and one down."""
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return lines(spark, sf_dir).select("seg_id", F.array(at(0.0, 0.0), at(100.0, 50.0), at(160.0, -30.0)).alias("geom"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of three sizes."""
    wide = (F.col("seg_id") % 3 + 1) * 100.0
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return lines(spark, sf_dir).select(F.col("seg_id").alias("poly_id"), F.array(corner(F.lit(0.0), F.lit(0.0)), corner(wide, F.lit(0.0)), corner(wide, wide), corner(F.lit(0.0), wide)).alias("ring"))


def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up run for each brand, size and setting, with its two parameters."""
    n = F.col("p_partkey")
    pick = lambda at, values: F.element_at(F.array(*map(F.lit, values)), (at % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("init_"), (F.col("p_size") % 3).cast("string")).alias("initialization"), pick(n, (0.2, 0.5, 1.0, 2.0)).alias("lambda_c"), pick(F.expr("p_partkey div 4"), (0.5, 1.0, 2.0, 4.0)).alias("lambda_r"), (n % 97 / 97.0).alias("od_sparsity"), (n % 79 / 79.0).alias("order_count_cv"), (n % 5 > 0).alias("is_regularized")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up run for each brand, with the metrics that selection looks at."""
    n = F.col("p_partkey")
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("run_id")).agg(
        F.round(F.avg((n % 97) / 97.0), 6).alias("od_sparsity"), F.round(F.avg((n % 89) / 89.0), 6).alias("connector_cut_ratio"), F.round(F.avg((n % 83) / 83.0), 6).alias("continuity_cut_ratio"), F.round(F.avg((n % 79) / 79.0), 6).alias("order_count_cv"),
        F.round(F.avg((n % 73) / 73.0), 6).alias("poi_similarity"), F.round(F.avg((n % 71) / 71.0), 6).alias("order_similarity"), (F.sum(n % 2) % 4 != 0).cast("double").alias("connected_cluster_ratio"), (1 + F.sum(n) % 3).cast("double").alias("mean_components"),
        (F.count("*") % 2 == 0).alias("is_regularized"), F.lit(10).cast("long").alias("num_clusters"), F.concat(F.lit("init_"), (F.sum(n) % 3).cast("string")).alias("initialization"),
    )


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each initialisation's baseline: the means of its runs."""
    names = ("od_sparsity", "connector_cut_ratio", "continuity_cut_ratio", "order_count_cv")
    return runs(spark, sf_dir).groupBy("initialization").agg(*(F.round(F.avg(c), 6).alias(c) for c in names))
