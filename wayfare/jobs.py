"""Whole runs from files to files: the region data set of raw orders, and the supply tables of labelled orders.

    python -m wayfare.jobs supply --orders-path ORDERS --output-dir FOLDER [--execution-mode daily] ...
    python -m wayfare.jobs regions CONFIG.yaml
"""

from __future__ import annotations

import argparse
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfare.operators import demand, features, geometry, intervals, regions, staging, supply
from wayfare.plans.shared import cut
from wayfare.sources import tables
from wayfare.sources.config import Demand, Supply


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled orders from (compressed) CSV or Parquet; times that do not parse are null."""
    if path.rstrip("/").endswith((".parquet", "/parquet")):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True)
    times = {c: F.expr(f"try_cast({c} AS TIMESTAMP_NTZ)") for c in ("departure_time", "finish_time")}
    return raw.withColumns(times | {"order_id": F.expr("try_cast(order_id AS BIGINT)"), "driver_id": F.expr("try_cast(driver_id AS BIGINT)")})


def run_supply(spark: SparkSession, orders: DataFrame, folder: str, settings: Supply = Supply(), start: str | None = None, end: str | None = None, sample_days: int | None = None, text: bool = False) -> dict[str, Any]:
    """Write the supply tables of labelled orders below ``folder``; counts by day and of rows, also as run_summary.json.

    In daily mode all days run at once, each a partition of the tables. ``sample_days``: the first so many dates alone.
    ``text``: compressed CSV beside Parquet.
    """
    taken = supply.day_slice(orders, start, end)
    if sample_days:
        taken = taken.join(F.broadcast(supply.departure_dates(taken, sample_days)), F.to_date("departure_time") == F.col("date_"), "left_semi")
    valid = intervals.valid_trips(taken)
    found = supply.whole_grid(supply.supply_tables(valid, settings.max_gap_minutes, settings.merge_gap_s, settings.slot_minutes, settings.mode), settings.slot_minutes)
    written = tables.write_supply(found, folder, settings.mode == "daily", text)
    ok = F.coalesce(F.col("finish_time") > F.col("departure_time"), F.lit(False))
    by_day = taken.where("departure_time is not null").groupBy(F.to_date("departure_time").cast("string").alias("date")).agg(F.count("*").alias("orders_loaded"), F.count_if(ok).alias("valid_orders"), F.count_if(~ok).alias("invalid_orders"))
    days = [r.asDict() for r in by_day.orderBy("date").collect()]  # a row for each day
    rows = {f"{name}_rows": table.count() for name, table in written.items()}
    out = {"execution_mode": settings.mode, "days_processed": len(days)} | {k: sum(d[k] for d in days) for k in ("orders_loaded", "valid_orders", "invalid_orders")} | rows | {"daily_summaries": days}
    tables.write_json(asdict(settings) | {"start_date": start, "end_date": end, "sample_days": sample_days}, f"{folder}/config_used.json", spark)
    tables.write_json(out, f"{folder}/run_summary.json", spark)
    return out


def region_tables(orders: DataFrame, lines: DataFrame, relation: DataFrame, poi: DataFrame, start: str, end: str, zone: int, settings: Demand = Demand(), weight: str = "base_weight") -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The region data set, and the counts of its staging.

    ``orders``: raw, as :func:`read_orders_csv` gives them; ``lines``: (seg_id, cluster_id, length, geom in metres of the
    zone); ``relation``: (seg_id_a, seg_id_b, weight); ``poi``: (lon, lat, category).
    """
    matched = cut(staging.matched(staging.checked(orders, start, end), lines, settings.max_match_m, zone))
    assigned = cut(staging.assigned_orders(matched, lines, settings.slot_minutes))
    od = demand.od_slots(assigned, settings.slot_minutes)
    slots = intervals.calendar(demand.slot_bounds(assigned, settings.slot_minutes), "first_slot", "last_slot", settings.slot_minutes)
    order = demand.cluster_order(lines)
    index = regions.cluster_index(lines.select("seg_id", F.col("cluster_id").cast("string").alias("cluster_id"), "length").join(geometry.centroids(lines, ["seg_id"]), "seg_id")).join(order, "cluster_id")
    named = lines.select("seg_id", F.col("cluster_id").cast("string").alias("cluster_id"))
    road = regions.cluster_road_edges(relation, named, weight)
    places = cut(poi.select(F.monotonically_increasing_id().alias("point_id"), "lon", "lat", "category"))
    near = staging.match_points(places, lines, settings.poi_match_m, zone).where("seg_id is not null").join(places.select("point_id", "category"), "point_id").join(named, "seg_id")
    counts = near.where("category is not null").groupBy("cluster_id", F.col("category").alias("key")).agg(F.count("*").cast("double").alias("value"))
    nodes = named.select(F.col("cluster_id").alias("node")).distinct()
    edges = {
        "road": road.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b"), "weight", "edge_count"),
        "poi": regions.similarity_topk(counts, "cluster_id", settings.poi_top_k),
        "distance": regions.distance_topk(index, settings.distance_top_k, settings.decay_m),
    }
    out = {"orders_region_assigned": assigned, "cluster_od": od, "od_tensor": demand.od_tensor(od, slots, order), "cluster_index": index, "poi_categories": features.category_mapping(poi)}
    for name, table in edges.items():
        out[f"cluster_graph_{name}_edges"] = table
        out[f"cluster_graph_{name}_adjacency_normalized"] = regions.normalized_adjacency(table.select("a", "b", "weight"), nodes)
    return out, staging.staging_report(matched).first().asDict()


def write_regions(spark: SparkSession, found: dict[str, DataFrame], report: dict[str, int], folder: str, settings: Demand = Demand()) -> dict[str, str]:
    """The tables as Parquet and as compressed CSV, with metadata.json."""
    paths = {}
    for name, table in found.items():
        paths[name] = f"{folder}/{name}"
        table.write.mode("overwrite").parquet(paths[name])
        tables.write_csv_gz(spark.read.parquet(paths[name]), f"{paths[name]}.csv.gz")
    tables.write_json({"staging": report, "settings": asdict(settings), "tables": sorted(paths)}, f"{folder}/metadata.json", spark)
    return paths


def run_regions(spark: SparkSession, config: dict[str, Any]) -> dict[str, str]:
    """:func:`region_tables` of files that a configuration names; partition and relation as Parquet, orders and places as CSV."""
    inputs, window = config["inputs"], config["window"]
    settings = Demand(**config.get("demand", {}))
    orders = None
    for path in inputs["orders"]:
        part = tables.read_orders_csv(spark, path, config.get("columns"))
        orders = part if orders is None else orders.unionByName(part)
    poi = spark.read.csv(inputs["poi"], header=True).select(*(F.expr(f"try_cast({config.get('poi_columns', {}).get(c, c)} AS {kind})").alias(c) for c, kind in (("lon", "DOUBLE"), ("lat", "DOUBLE"), ("category", "STRING"))))
    lines = spark.read.parquet(inputs["partition"])
    if config.get("degrees"):
        lines = staging.project(lines, config["zone"])
    found, report = region_tables(orders, lines, spark.read.parquet(inputs["relation"]), poi, window["start"], window["end"], config["zone"], settings)
    return write_regions(spark, found, report, config["output"], settings)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfare.jobs")
    kinds = parser.add_subparsers(dest="kind", required=True)
    s = kinds.add_parser("supply", help="supply tables of labelled orders")
    s.add_argument("--orders-path", required=True)
    s.add_argument("--output-dir", required=True)
    s.add_argument("--max-gap", type=float, default=60.0, help="minutes")
    s.add_argument("--carpool-merge-gap-s", type=float, default=0.0)
    s.add_argument("--slot-duration", type=int, default=15, help="minutes")
    s.add_argument("--execution-mode", choices=["daily", "global"], default="daily")
    s.add_argument("--start-date")
    s.add_argument("--end-date")
    s.add_argument("--sample-days", type=int)
    s.add_argument("--csv", action="store_true", help="compressed CSV beside Parquet")
    r = kinds.add_parser("regions", help="region data set of raw orders")
    r.add_argument("config")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"wayfare {a.kind}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.kind == "supply":
        settings = Supply(a.max_gap, a.carpool_merge_gap_s, a.slot_duration, a.execution_mode)
        print(run_supply(spark, read_labelled(spark, a.orders_path), a.output_dir, settings, a.start_date, a.end_date, a.sample_days, a.csv))
    else:
        import yaml

        with open(a.config) as f:
            print(run_regions(spark, yaml.safe_load(f)))


if __name__ == "__main__":
    main()
