"""Times the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH"))))

from pyspark.sql import SparkSession  # noqa: E402

from wayfare import queries  # noqa: E402
from wayfare.queries import CATALOG  # noqa: E402

HEADLINE = (
    "service_labels od_slots_15min trip_segments driver_chains idle_windows supply_available supply_in_service_od fleet_lower_bound supply_demand_merge segment_order_features relation_edges edge_variants cluster_road_edges "
    "nearest_segment point_in_buffer embedding_cosine_topk edge_cut_metrics od_metrics historical_average objective_components connectivity pareto_2d balanced_score skater demand_region_growing metric_row evaluation_row regularized_search_run"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 8))
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["od_slots_15min"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in names:
        began = time.time()
        (CATALOG.get(name) or getattr(queries, name))(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
