"""The query catalog over the driver tables: one entry for each operator. ``wayfare.sql`` has their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayfare.functions.scalars import bearing, name_matches, road_name, slot_floor
from wayfare.operators import demand, features, geometry, intervals, metrics, partitioning, regions, relation, roads, selection, spatial, supply
from wayfare.plans.components import connected_components
from wayfare.plans.shared import cut
from wayfare.sources import adapters as src
from wayfare.sql import RADIUS

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(f: Query) -> Query:
    CATALOG[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to the digits that both engines agree on."""
    return df.withColumns({c: F.round(c, digits) for c in columns or [c for c, t in df.dtypes if t == "double"]})


def _text(c: str) -> Column:
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)


def _flat(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, _text(c))


def _tables(spark, d, mode="global"):
    return supply.supply_tables(src.labelled(spark, d), mode=mode)


# --- demand --------------------------------------------------------------------------------------------


@query
def valid_trips(spark, d):
    return src.trips(spark, d)


@query
def staging_counters(spark, d):
    return demand.staging_counters(src.raw_trips(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query
def service_labels(spark, d):
    return src.labelled(spark, d).select("order_id", "service_type")


@query
def service_type_counts(spark, d):
    return src.labelled(spark, d).groupBy("service_type").agg(F.count("*").alias("n"), F.count_distinct("driver_id").alias("drivers"))


@query
def assigned_orders(spark, d):
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    text = lambda c: F.col(c).cast("string").alias(c)
    return src.labelled(spark, d).select("order_id", "driver_id", when("departure_time"), when("finish_time"), text("origin_cluster_id"), text("destination_cluster_id"), "service_type")


@query
def od_slots_15min(spark, d):
    return demand.od_slots(src.labelled(spark, d))


@query
def od_bounds(spark, d):
    return demand.slot_bounds(src.trips(spark, d))


@query
def slot_calendar(spark, d):
    return intervals.calendar(demand.slot_bounds(src.trips(spark, d)), "first_slot", "last_slot")


@query
def od_tensor_dense(spark, d):
    found = src.labelled(spark, d)
    slots = intervals.calendar(demand.slot_bounds(src.trips(spark, d)), "first_slot", "last_slot")
    index = demand.cluster_order(found.select(F.col("origin_cluster_id").alias("cluster_id")))
    return demand.od_tensor(demand.od_slots(found), slots, index)


@query
def carpool_groups(spark, d):
    return _flat(intervals.carpool_groups(src.labelled(spark, d)), "order_ids")


@query
def exclusive_segments(spark, d):
    return _flat(intervals.exclusive_segments(src.labelled(spark, d)), "order_ids")


@query
def trip_segments(spark, d):
    return _flat(intervals.trip_segments(src.labelled(spark, d)), "order_ids")


@query
def driver_chains(spark, d):
    return _flat(_tables(spark, d)["chains"], "segment_ids")


@query
def idle_windows(spark, d):
    return rounded(_tables(spark, d)["idle"])


@query
def driver_slot_expansion(spark, d):
    return intervals.expand_slots(intervals.trip_segments(src.labelled(spark, d)), "trip_start", "trip_end").select("segment_id", "driver_id", "slot_start")


@query
def supply_available(spark, d):
    return supply.available_grid(src.labelled(spark, d))


@query
def supply_in_service_od(spark, d):
    return _tables(spark, d)["in_service"]


@query
def fleet_lower_bound(spark, d):
    return _tables(spark, d)["fleet"]


@query
def supply_demand_merge(spark, d):
    t = _tables(spark, d)
    wanted = src.labelled(spark, d).groupBy(slot_floor("departure_time", 15).alias("slot_start"), F.col("origin_cluster_id").cast("string").alias("cluster_id")).agg(F.count("*").alias("demand"))
    return supply.with_demand(wanted, t["available"], t["fleet"])


@query
def supply_daily_mode(spark, d):
    return _flat(_tables(spark, d, "daily")["segments"], "order_ids")


@query
def supply_daily_chains(spark, d):
    return _flat(_tables(spark, d, "daily")["chains"], "segment_ids")


@query
def supply_daily_idle(spark, d):
    return rounded(_tables(spark, d, "daily")["idle"])


@query
def supply_daily_available(spark, d):
    return supply.available_grid(src.labelled(spark, d), mode="daily")


@query
def supply_daily_in_service(spark, d):
    return _tables(spark, d, "daily")["in_service"]


@query
def supply_daily_fleet(spark, d):
    return supply.whole_grid(_tables(spark, d, "daily"))["fleet"]


@query
def departure_dates(spark, d):
    return supply.departure_dates(src.trips(spark, d))


# --- features ------------------------------------------------------------------------------------------


@query
def segment_order_features(spark, d):
    return src.segment_features(spark, d)


@query
def segment_od_pairs(spark, d):
    return demand.od_pairs(src.trips(spark, d))


@query
def hourly_od_weekday(spark, d):
    return demand.hourly_od(src.trips(spark, d))


@query
def category_mapping(spark, d):
    return features.category_mapping(src.poi(spark, d))


@query
def poi_counts(spark, d):
    return features.poi_counts(src.poi(spark, d))


@query
def poi_counts_wide(spark, d):
    return features.poi_counts_wide(src.segments(spark, d), src.poi(spark, d), ["click", "error", "purchase", "signup", "view"])


@query
def poi_features(spark, d):
    return rounded(features.poi_features(src.segments(spark, d), src.poi(spark, d)))


# --- roads ---------------------------------------------------------------------------------------------


@query
def segment_roles(spark, d):
    part = src.read(spark, d, "part")
    tagged = part.select(F.col("p_partkey").alias("seg_id"), F.when(F.col("p_type").endswith("STEEL"), "primary_link").otherwise("primary").alias("highway"), F.col("p_retailprice").alias("length"))
    return tagged.select("seg_id", roads.segment_role(1200.0).alias("segment_role"))


@query
def name_match(spark, d):
    named = src.read(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), road_name("p_brand").alias("normalized_name"))
    return named.where(name_matches(F.col("normalized_name"), ["1"], ["3"]))


@query
def access_filter(spark, d):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    tags = src.read(spark, d, "part").select(
        F.col("p_partkey").alias("seg_id"), F.when(size % 5 == 0, "Private").alias("access"), none.alias("vehicle"), F.when(size % 3 == 1, "no; yes").when(size % 3 == 0, "designated").alias("motor_vehicle"), none.alias("psv"), none.alias("motorcar"), none.alias("taxi")
    )
    verdict = roads.access_verdict(["yes", "permissive"], ["no", "private"], ["motor_vehicle"])
    return tags.select("seg_id", verdict.alias("v")).select("seg_id", "v.allowed", "v.reason")


@query
def service_filter(spark, d):
    size = F.col("p_size")
    tags = src.read(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), F.when(size % 4 == 0, "service").otherwise("primary").alias("highway"), F.when(size % 3 == 0, "driveway").alias("service"))
    return tags.where(roads.service_allowed(["driveway", "parking_aisle"], tags.columns)).select("seg_id")


@query
def bearing_angle(spark, d):
    s = src.read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("seg_id"), F.round(bearing(F.col("s_acctbal").cast("double"), ((F.col("s_suppkey") * 37) % 1000).cast("double") - 500.0), 6).alias("bearing"))


# --- relation graph ------------------------------------------------------------------------------------


@query
def incident_pairs(spark, d):
    return relation.incident_pairs(src.segments(spark, d))


@query
def connector_pairs(spark, d):
    return relation.connector_pairs(src.connectors(spark, d), src.segments(spark, d))


@query
def relation_edges(spark, d):
    return src.edges(spark, d)


def _poi_similarity(spark, d):
    segments = src.segments(spark, d)
    return relation.poi_similarity(src.edges(spark, d), relation.poi_inputs(segments, src.poi(spark, d)))


@query
def poi_similarity(spark, d):
    return rounded(_poi_similarity(spark, d))


@query
def order_similarity(spark, d):
    return rounded(relation.order_similarity(src.edges(spark, d), src.segment_features(spark, d)))


@query
def edge_variants(spark, d):
    return rounded(relation.edge_variants(_full_edges(spark, d), VARIANTS))


# --- regions -------------------------------------------------------------------------------------------


@query
def cluster_road_edges(spark, d):
    return rounded(regions.cluster_road_edges(src.edges(spark, d), src.segments(spark, d)))


@query
def cluster_index(spark, d):
    return rounded(regions.cluster_index(src.segments(spark, d)))


@query
def cluster_summary(spark, d):
    return rounded(regions.cluster_summary(src.segments(spark, d)))


@query
def road_name_diagnostics(spark, d):
    return rounded(regions.road_name_diagnostics(src.segments(spark, d)))


@query
def cluster_poi_topk(spark, d):
    long = features.poi_counts(src.poi(spark, d)).groupBy((F.col("seg_id") % 50).alias("id"), F.col("category").alias("key")).agg(F.sum("n").cast("double").alias("value"))
    return rounded(regions.similarity_topk(long, "id", 10))


@query
def distance_topk(spark, d):
    return rounded(regions.distance_topk(regions.cluster_index(src.segments(spark, d)), 3))


@query
def adjacency_normalized(spark, d):
    segments = src.segments(spark, d)
    pairs = regions.cluster_road_edges(src.edges(spark, d), segments).select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b"), "weight")
    return rounded(regions.normalized_adjacency(pairs, segments.select(F.col("cluster_id").alias("node")).distinct()))


@query
def embedding_cosine_topk(spark, d):
    vectors = src.read(spark, d, "embeddings")
    return rounded(regions.embedding_topk(vectors, vectors.where("vec_id % 100 = 0"), 10))


@query
def nearest_segment(spark, d):
    return rounded(spatial.nearest_segment(src.points(spark, d), spatial.with_offsets(src.lines(spark, d)), RADIUS))


@query
def nearest_polyline(spark, d):
    legs = geometry.legs(src.polylines(spark, d)).select("seg_id", "x0", "y0", "x1", "y1")
    return rounded(spatial.nearest_segment(src.points(spark, d), spatial.with_offsets(legs), RADIUS))


@query
def polyline_centroids(spark, d):
    lines = src.polylines(spark, d)
    return rounded(geometry.centroids(lines, ["seg_id"]).join(lines.select("seg_id", geometry.length_of().alias("length")), "seg_id"))


@query
def inside_ratio(spark, d):
    return rounded(geometry.inside_ratio(src.polylines(spark, d), "seg_id", src.BOUNDARY))


@query
def smallest_polygon(spark, d):
    return rounded(geometry.smallest_polygon(src.points(spark, d), src.polygons(spark, d), 200.0))


@query
def point_in_buffer(spark, d):
    return rounded(spatial.within_distance(src.points(spark, d), src.lines(spark, d), RADIUS))


# --- metrics -------------------------------------------------------------------------------------------


def _cut(spark, d):
    return metrics.with_cut(src.edges(spark, d), src.segments(spark, d))


def _table(spark, d):
    return metrics.cluster_table(src.segments(spark, d), src.segment_features(spark, d).select("seg_id", "order_total"))


@query
def edge_cut_metrics(spark, d):
    return rounded(metrics.cut_metrics(_cut(spark, d), {p: (f"has_{p}", f"{p}_weight") for p in ("direct", "connector", "continuity")}))


@query
def connector_type_metrics(spark, d):
    return rounded(metrics.connector_types(_cut(spark, d)))


@query
def road_integrity(spark, d):
    return rounded(metrics.road_integrity(src.segments(spark, d), _cut(spark, d)))


@query
def cluster_table(spark, d):
    return rounded(_table(spark, d))


@query
def cluster_cv(spark, d):
    return rounded(metrics.balance(_table(spark, d)))


@query
def length_spread(spark, d):
    return rounded(metrics.spread(src.segments(spark, d), "length", "length"))


@query
def small_clusters(spark, d):
    return rounded(metrics.small_clusters(_table(spark, d)))


@query
def capacity_metrics(spark, d):
    return rounded(metrics.capacity(_table(spark, d)))


@query
def wss(spark, d):
    found = metrics.within_squares(src.segment_features(spark, d), src.segments(spark, d), ["pickup_count", "dropoff_count"], "order")
    return rounded(rounded(found, "order_wss", digits=4), "order_wss_per_segment")


@query
def poi_cluster_entropy(spark, d):
    return rounded(metrics.poi_cluster_metrics(features.poi_counts(src.poi(spark, d)), src.segments(spark, d)))


@query
def imbalance_var(spark, d):
    return rounded(metrics.imbalance(src.segment_features(spark, d), src.segments(spark, d)))


@query
def od_metrics(spark, d):
    found = metrics.od_metrics(src.nation_flows(spark, d), src.CLUSTERS)
    return rounded(rounded(found, "od_sparsity", "mean_nonzero_flow"), "od_hhi", digits=9)


@query
def od_pair_sparsity(spark, d):
    return rounded(metrics.od_pair_sparsity(src.nation_flows(spark, d), src.CLUSTERS))


@query
def historical_average(spark, d):
    return rounded(metrics.historical_average(demand.hourly_od(src.trips(spark, d)), src.CLUSTERS))


@query
def intra_similarity(spark, d):
    cut = metrics.with_cut(_poi_similarity(spark, d), src.segments(spark, d))
    return rounded(metrics.intra_similarity(cut, "poi_similarity"))


@query
def objective_components(spark, d):
    return rounded(metrics.objective_components(src.edges(spark, d), src.segments(spark, d), src.segment_features(spark, d).select("seg_id", "order_total")))


@query
def move_delta(spark, d):
    first = src.segments(spark, d).agg(F.min("seg_id")).first()[0]
    return rounded(metrics.move_delta(src.edges(spark, d), src.segments(spark, d), src.segment_features(spark, d).select("seg_id", "order_total"), first, 3))


@query
def components(spark, d):
    segments = src.segments(spark, d)
    inner = metrics.with_cut(relation.incident_pairs(segments), segments).where("not is_cut")
    return connected_components(inner, "seg_id_a", "seg_id_b")


def _whole_row(spark, d):
    segments, edges, features_, hourly = map(cut, (src.segments(spark, d), _full_edges(spark, d), src.segment_features(spark, d), demand.hourly_od(src.trips(spark, d))))
    return segments, edges, features_, hourly, features.poi_counts(src.poi(spark, d))


@query
def metric_row(spark, d):
    """Every metric of the partition that has no geometry, in one row."""
    segments, edges, features_, hourly, poi = _whole_row(spark, d)
    parts = metrics.metric_parts(segments, edges, features_, poi, hourly, src.CLUSTERS)
    digits = {"order_wss": 4, "od_hhi": 9}
    return metrics.together({name: part.withColumns({c: F.round(c, digits.get(c, 6)) for c, kind in part.dtypes if kind == "double"}) for name, part in parts.items()})


@query
def evaluation_row(spark, d):
    segments, edges, _, hourly, _ = _whole_row(spark, d)
    return rounded(metrics.evaluation_row(segments, edges, hourly, src.CLUSTERS))


@query
def heatmap_lambda(spark, d):
    return rounded(metrics.heatmaps(src.grid_runs(spark, d), ["od_sparsity", "order_count_cv"]))


@query
def connectivity(spark, d):
    return rounded(metrics.connectivity(src.edges(spark, d), src.segments(spark, d)))


# --- selection -----------------------------------------------------------------------------------------

WEIGHTS = {"od_sparsity": 0.30, "connector_cut_ratio": 0.30, "order_count_cv": 0.20, "continuity_cut_ratio": 0.20}


@query
def pareto_2d(spark, d):
    return selection.pareto(src.runs(spark, d), "run_id", {"od_sparsity": "min", "connector_cut_ratio": "min"}).select("run_id", "od_sparsity", "connector_cut_ratio")


@query
def pareto_nd(spark, d):
    return selection.pareto(src.runs(spark, d), "run_id", dict.fromkeys(("od_sparsity", "connector_cut_ratio", "order_count_cv"), "min")).select("run_id")


@query
def pareto_summary(spark, d):
    return selection.pareto_summary(src.runs(spark, d), "run_id", [("od_sparsity", "order_count_cv"), ("connector_cut_ratio", "continuity_cut_ratio")])


@query
def pareto_frontier(spark, d):
    return selection.pareto_frontier(src.runs(spark, d), "run_id", "od_sparsity", "order_count_cv").select("run_id", "od_sparsity", "order_count_cv")


@query
def balanced_score(spark, d):
    return rounded(selection.balanced_score(src.runs(spark, d), WEIGHTS).select("run_id", "balanced_score"))


@query
def best_run(spark, d):
    scored = selection.balanced_score(src.runs(spark, d), WEIGHTS)
    return rounded(selection.best_run(scored, "run_id", ["od_sparsity", "connector_cut_ratio"], 10).select("run_id", "balanced_score"))


@query
def ranked_summary(spark, d):
    return rounded(selection.ranked_summary(src.runs(spark, d), "run_id").select("run_id", "structure_score", "semantic_score", "balance_score", "rank"))


@query
def candidate_gates(spark, d):
    gates = selection.candidate_gates(src.runs(spark, d), src.baselines(spark, d), ["connector_cut_ratio"], {"od_sparsity": 0.02, "order_count_cv": 0.1})
    return gates.select("run_id", *(c for c in gates.columns if c.startswith(("improves_", "holds_"))), "passes")


@query
def heatmap_pivot(spark, d):
    mean = lambda test, name: F.round(F.avg(F.when(test, F.col("od_sparsity"))), 6).alias(name)
    return src.runs(spark, d).groupBy("initialization").agg(mean(F.col("is_regularized"), "regularized"), mean(~F.col("is_regularized"), "baseline"))


@query
def coverage_gaps(spark, d):
    partition = src.all_segments(spark, d).where("is_connector or seg_id % 13 <> 0").select("seg_id")
    return selection.coverage_gaps(src.segments(spark, d).select("seg_id"), partition)


# --- graph kernels -------------------------------------------------------------------------------------

K = 10


VARIANTS = {"road": (0.0, 0.0), "road_poi": (1.0, 0.0), "road_poi_order": (1.0, 1.0)}


def _full_edges(spark, d):
    """Relation edges with both similarities."""
    edges = src.edges(spark, d)
    return edges.join(_poi_similarity(spark, d).select("seg_id_a", "seg_id_b", "poi_similarity"), ["seg_id_a", "seg_id_b"]).join(relation.order_similarity(edges, src.segment_features(spark, d)).select("seg_id_a", "seg_id_b", "order_similarity"), ["seg_id_a", "seg_id_b"])


def _graph(spark, d, variants=tuple(VARIANTS)):
    """The nodes and edges of the variants; each counts the similarities of its own, and region growing sees those alone."""
    names = F.explode(F.array(*map(F.lit, variants))).alias("variant")
    demand_of = src.segment_features(spark, d).select("seg_id", F.col("order_total").alias("demand"))
    nodes = src.segments(spark, d).join(demand_of, "seg_id", "left").select(names, "seg_id", "demand", "length", "x", "y")
    return nodes, relation.edge_variants(_full_edges(spark, d), {v: VARIANTS[v] for v in variants}, ("continuity_weight", "connector_weight", "poi_similarity", "order_similarity"))


def _partition_query(name: str) -> Query:
    def run(spark, d):
        return partitioning.partition(*_graph(spark, d), [name], K)

    run.__name__ = name
    return query(run)


for _name in partitioning.ALGORITHMS:
    _partition_query(_name)


def _search(spark, d, lambda_c, lambda_r, algorithms):
    nodes, edges = map(cut, _graph(spark, d, ("road_poi_order",)))  # for the first partitions and for the search
    initial = partitioning.partition(nodes, edges, list(algorithms), K)
    return partitioning.search(nodes, edges, initial, selection.setting_grid(spark, lambda_c=lambda_c, lambda_r=lambda_r), None)


@query
def regularized_search(spark, d):
    """All settings of the grid from three initial partitions."""
    return _search(spark, d, [0.2, 0.5, 1.0, 2.0], [0.5, 1.0, 2.0, 4.0], ("demand_region_growing", "louvain", "leiden"))


def regularized_search_run(spark, d):
    """One run, which is what the published time is of."""
    return _search(spark, d, [1.0], [1.0], ("demand_region_growing",))


@query
def setting_grid(spark, d):
    return selection.setting_grid(spark, lambda_c=[0.2, 0.5, 1.0, 2.0], lambda_r=[0.5, 1.0, 2.0, 4.0])


@query
def network_diameter(spark, d):
    return rounded(partitioning.diameter_metrics(src.edges(spark, d), src.segments(spark, d)))


@query
def shape_metrics(spark, d):
    segments = src.segments(spark, d).select("cluster_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 30.0).alias("x1"), (F.col("y") + 40.0).alias("y1"))
    return rounded(partitioning.shape_metrics(segments), digits=6)


@query
def colour_diagnostics(spark, d):
    return rounded(partitioning.colour_diagnostics(regions.cluster_road_edges(src.edges(spark, d), src.segments(spark, d))))
