"""Diagnostics of a partition. Each operator gives one row (or one for each group) and is plain aggregation.

Inputs: ``clusters`` (seg_id, cluster_id, length, ...), ``edges`` (seg_id_a, seg_id_b, weights, flags).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayfare.functions.scalars import EPS, capacity_hinge, nonempty, ratio


@dataclass(frozen=True)
class Thresholds:
    """Limits the metrics use. Fixed default values."""

    small_segments: int = 5
    small_length_m: float = 1000.0
    small_orders: float = 100.0
    capacity_low: float = 0.5
    capacity_high: float = 1.5
    effective_flow: int = 10
    elongation: float = 10.0
    large_diameter_m: float = 30_000.0
    buffer_m: float = 50.0


def variation(value: str) -> Column:
    """Population standard deviation over mean; null where the mean is next to nothing."""
    return F.when(F.abs(F.avg(value)) > EPS, F.stddev_pop(value) / F.avg(value))


def spread(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Mean, least, most and interpolated median."""
    return df.agg(F.avg(value).alias(f"{prefix}_mean"), F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"), F.percentile(value, F.lit(0.5)).alias(f"{prefix}_median"))


def with_cut(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges with both clusters known, and whether they differ (``is_cut``)."""
    side = lambda s: partition.select(F.col("seg_id").alias(f"seg_id_{s}"), F.col("cluster_id").alias(f"c_{s}"))
    return edges.join(side("a"), "seg_id_a").join(side("b"), "seg_id_b").withColumn("is_cut", F.col("c_a") != F.col("c_b"))


def cut_metrics(cut: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """For each (prefix: flag, weight): edges flagged, edges cut, and the weight's share that is cut; all in one pass."""
    out = []
    for prefix, (flag, weight) in parts.items():
        w = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
        cut_w = F.sum(F.when(F.col(flag) & F.col("is_cut"), w).otherwise(0.0))
        out += [F.count_if(F.col(flag)).alias(f"{prefix}_edges"), F.count_if(F.col(flag) & F.col("is_cut")).alias(f"{prefix}_cut_edges"), ratio(cut_w, F.sum(F.when(F.col(flag), w).otherwise(0.0))).alias(f"{prefix}_cut_ratio")]
    return cut.agg(*out, F.avg(F.col("is_cut").cast("double")).alias("edge_cut_ratio"))


def connector_types(cut: DataFrame) -> DataFrame:
    """Cut shares of connector edges by connector highway; an edge of several counts for each, of none as unknown."""
    kinds = F.when(F.coalesce(F.col("connector_highways"), F.lit("")) == "", F.array(F.lit("unknown"))).otherwise(F.split("connector_highways", r"\|"))
    each = cut.where("has_connector").withColumn("connector_type", F.explode(kinds))
    weight = F.sum(F.when(F.col("is_cut"), F.col("connector_weight")).otherwise(0.0))
    return each.groupBy("connector_type").agg(F.count("*").alias("edges"), F.count_if("is_cut").alias("cut_edges"), F.avg(F.col("is_cut").cast("double")).alias("cut_ratio"), ratio(weight, F.sum("connector_weight")).alias("weight_cut_ratio"))


def road_integrity(clusters: DataFrame, cut: DataFrame) -> DataFrame:
    """How whole named roads stay: clusters for each name, share of length in the main one, cut share of same-name edges."""
    parts = clusters.where(nonempty("name")).groupBy("name", "cluster_id").agg(F.sum("length").alias("len"))
    names = parts.groupBy("name").agg(F.count("*").alias("k"), F.sum("len").alias("total"), (F.max("len") / (F.sum("len") + EPS)).alias("share"))
    road = names.agg(F.avg("k").alias("mean_clusters_per_name"), F.avg("share").alias("mean_dominant_share"), ratio(F.sum(F.col("share") * F.col("total")), F.sum("total")).alias("weighted_dominant_share"))
    same = cut.agg(F.avg(F.when(F.col("same_name"), F.col("is_cut").cast("double"))).alias("same_name_cut_ratio"))
    return road.crossJoin(same)  # one row each


def cluster_table(clusters: DataFrame, demand: DataFrame) -> DataFrame:
    """Segments, length and demand of each cluster; ``demand``: (seg_id, order_total)."""
    return clusters.join(demand, "seg_id", "left").groupBy("cluster_id").agg(F.count("*").alias("num_segments"), F.sum("length").alias("total_length"), F.sum(F.coalesce("order_total", F.lit(0))).alias("order_total"))


def balance(table: DataFrame) -> DataFrame:
    """Coefficients of variation of the cluster table."""
    return table.agg(F.count("*").alias("num_clusters"), variation("num_segments").alias("segment_count_cv"), variation("total_length").alias("length_cv"), variation("order_total").alias("order_count_cv"))


def small_clusters(table: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    small = (F.col("num_segments") < t.small_segments) | (F.col("total_length") < t.small_length_m) | (F.col("order_total") < t.small_orders)
    return table.agg(F.count_if(small).alias("small_clusters"), F.avg(small.cast("double")).alias("small_cluster_ratio"))


def capacity(table: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Share of clusters outside the band around the mean demand, and the mean squared hinge."""
    target = table.agg(F.avg("order_total").alias("target"))
    each = table.crossJoin(F.broadcast(target))  # one row
    outside = ~F.coalesce((F.col("order_total") >= t.capacity_low * F.col("target")) & (F.col("order_total") <= t.capacity_high * F.col("target")), F.lit(False))
    return each.agg(F.avg(outside.cast("double")).alias("capacity_violation_ratio"), F.avg(capacity_hinge("order_total", "target", t.capacity_low, t.capacity_high)).alias("capacity_hinge_loss"))


def within_squares(features: DataFrame, partition: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Sum over columns of squared distances to the cluster mean, and by segment. Two passes, for stability."""
    joined = features.join(partition.select("seg_id", "cluster_id"), "seg_id")
    means = joined.groupBy("cluster_id").agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    square = sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in columns), F.lit(0.0))
    return joined.join(means, "cluster_id").agg(F.sum(square).alias(f"{prefix}_wss"), ratio(F.sum(square), F.count("*").cast("double")).alias(f"{prefix}_wss_per_segment"))


def poi_cluster_metrics(counts: DataFrame, partition: DataFrame) -> DataFrame:
    """Entropy (natural, not normalised) and dominant share of clusters' categories, plain and weighted by count."""
    long = counts.join(partition.select("seg_id", "cluster_id"), "seg_id").groupBy("cluster_id", "category").agg(F.sum("n").alias("n"))
    total = long.groupBy("cluster_id").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    p = F.col("n") / F.col("total")
    entropy = long.join(total, "cluster_id").groupBy("cluster_id").agg((-F.sum(p * F.log(p + EPS))).alias("entropy"))
    each = total.join(entropy, "cluster_id").withColumn("purity", F.col("top") / F.col("total"))
    w = lambda c: ratio(F.sum(F.col(c) * F.col("total")), F.sum("total").cast("double"))
    return each.agg(F.avg("entropy").alias("poi_entropy_mean"), F.avg("purity").alias("poi_purity_mean"), w("entropy").alias("poi_entropy_weighted"), w("purity").alias("poi_purity_weighted"))


def imbalance(features: DataFrame, partition: DataFrame) -> DataFrame:
    """Mean over clusters of the population variance of (p - d) / (p + d)."""
    value = (F.col("pickup_count") - F.col("dropoff_count")) / (F.col("pickup_count") + F.col("dropoff_count") + EPS)
    each = features.join(partition.select("seg_id", "cluster_id"), "seg_id").groupBy("cluster_id").agg(F.var_pop(value).alias("v"))
    return each.agg(F.avg("v").alias("order_imbalance_variance"))


def od_metrics(od: DataFrame, n_clusters: int, t: Thresholds = Thresholds()) -> DataFrame:
    """Sparsity over the slots that are there, mean and median flow, effective pairs and concentration.

    ``od``: (slot_start, origin_cluster_id, destination_cluster_id, order_count).
    """
    slots = od.groupBy("slot_start").agg((F.count("*") / float(n_clusters**2)).alias("share")).agg((1 - F.avg("share")).alias("od_sparsity"))
    flow = od.where("order_count > 0").agg(F.avg("order_count").alias("mean_nonzero_flow"), F.percentile("order_count", F.lit(0.5)).alias("median_nonzero_flow"))
    pairs = od.groupBy("origin_cluster_id", "destination_cluster_id").agg(F.sum("order_count").alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    shares = pairs.crossJoin(F.broadcast(total))  # one row
    hhi = shares.agg(F.count_if(F.col("n") >= t.effective_flow).alias("effective_od_pairs"), F.sum(F.pow(F.col("n") / (F.col("total") + EPS), 2)).alias("od_hhi"))
    return slots.crossJoin(flow).crossJoin(hhi)


def od_pair_sparsity(od: DataFrame, n_clusters: int) -> DataFrame:
    """One less the share of all cluster pairs that ever have an order."""
    return od.agg((1 - F.count_distinct("origin_cluster_id", "destination_cluster_id") / float(n_clusters**2)).alias("od_pair_sparsity"))


def historical_average(od: DataFrame, n_clusters: int) -> DataFrame:
    """Error of predicting the last date's hourly flows by the mean of the first four dates (all but the last if fewer).

    Errors are over the full grid of 24 hours and all pairs; cells with neither flow nor prediction add nothing,
    so the grid is never built. Null with fewer than two dates.
    """
    day = F.to_date("slot_start")
    dates = od.select(day.alias("date_")).distinct()
    ranked = dates.withColumn("r", F.row_number().over(Window.orderBy("date_"))).withColumn("k", F.count("*").over(Window.partitionBy()))  # one row for each date
    n_train = F.when(F.col("k") >= 5, 4).otherwise(F.col("k") - 1)
    role = F.broadcast(ranked.select("date_", (F.col("r") <= n_train).alias("train"), (F.col("r") == F.col("k")).alias("test"), n_train.alias("n_train"), "k"))
    key = [F.hour("slot_start").alias("h"), "origin_cluster_id", "destination_cluster_id"]
    joined = od.withColumn("date_", day).join(role, "date_").where("k >= 2 and (train or test)")
    cells = joined.groupBy(*key).agg(
        (F.sum(F.when(F.col("train"), F.col("order_count")).otherwise(0)) / F.max("n_train")).alias("predicted"), F.sum(F.when(F.col("test"), F.col("order_count")).otherwise(0)).alias("actual")
    )
    error, grid = F.col("predicted") - F.col("actual"), F.lit(24.0 * n_clusters**2)
    return cells.agg((F.sum(F.abs(error)) / grid).alias("mae"), F.sqrt(F.sum(error * error) / grid).alias("rmse"), ratio(F.sum(F.abs(error)), F.sum(F.abs("actual")).cast("double")).alias("wape"))


def intra_similarity(cut: DataFrame, column: str) -> DataFrame:
    """Mean similarity of edges inside clusters."""
    return cut.where("not is_cut").agg(F.avg(column).alias(f"intra_{column}"))


def connectivity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Components of each cluster's own graph: share connected, surplus fragments, components, largest shares."""
    from wayfare.plans.components import connected_components

    inner = with_cut(edges, clusters).where("not is_cut").select(F.col("seg_id_a").alias("a"), F.col("seg_id_b").alias("b"))
    found = connected_components(inner)
    labelled = clusters.select("seg_id", "cluster_id").join(found, F.col("seg_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "seg_id"))
    parts = labelled.groupBy("cluster_id", "component").agg(F.count("*").alias("n"))
    each = parts.groupBy("cluster_id").agg(F.count("*").alias("c"), (F.max("n") / F.sum("n")).alias("share"))
    return each.agg(
        F.avg((F.col("c") == 1).cast("double")).alias("connected_cluster_ratio"), F.sum(F.col("c") - 1).alias("fragments"), F.avg("c").alias("mean_components"), F.max("c").alias("max_components"), F.avg("share").alias("mean_largest_share"), F.min("share").alias("min_largest_share")
    )


def objective_components(edges: DataFrame, clusters: DataFrame, demand: DataFrame, k: int | None = None, lambda_c: float = 1.0, lambda_g: float = 1.0, lambda_r: float = 1.0, alpha_cont: float = 1.0, alpha_conn: float = 1.0) -> DataFrame:
    """The regularised objective of a partition: capacity hinge and shares of cut weight, continuity and connectors."""
    table = cluster_table(clusters, demand)
    target = table.agg((F.sum("order_total") / (F.lit(float(k)) if k else F.count("*"))).alias("target"))
    cap = table.crossJoin(F.broadcast(target)).agg(F.avg(capacity_hinge("order_total", "target")).alias("r_cap"))
    cut = with_cut(edges, clusters)
    part = lambda w: F.sum(F.when(F.col("is_cut"), F.greatest(w, F.lit(0.0))).otherwise(0.0)) / F.greatest(F.sum(F.greatest(w, F.lit(0.0))), F.lit(1e-12))
    cuts = cut.agg(part("base_weight").alias("r_graph"), part("continuity_weight").alias("r_cont"), part("connector_weight").alias("r_conn"))
    total = lambda_c * F.col("r_cap") + lambda_g * F.col("r_graph") + lambda_r * (alpha_cont * F.col("r_cont") + alpha_conn * F.col("r_conn"))
    return cap.crossJoin(cuts).withColumn("objective", total)


def move_delta(edges: DataFrame, clusters: DataFrame, demand: DataFrame, node, target, k: int | None = None) -> DataFrame:
    """What moving one segment changes in the objective, part by part."""
    moved = clusters.withColumn("cluster_id", F.when(F.col("seg_id") == node, F.lit(target)).otherwise(F.col("cluster_id")))
    before, after = objective_components(edges, clusters, demand, k), objective_components(edges, moved, demand, k)
    names = before.columns
    return before.toDF(*(f"old_{c}" for c in names)).crossJoin(after).select(*((F.col(c) - F.col(f"old_{c}")).alias(f"delta_{c}") for c in names))


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of several one-row metrics; a metric that has no row leaves nulls."""
    out = None
    for part in parts.values():
        out = part if out is None else out.join(F.broadcast(part), F.lit(True), "full")  # one row each
    return out


def metric_parts(segments: DataFrame, edges: DataFrame, features: DataFrame, poi: DataFrame, od: DataFrame, n_clusters: int, t: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """The parts of a partition's whole row of metrics, each of one row, over shared inputs; see :func:`together`.

    ``segments``: (seg_id, cluster_id, length, name); ``edges``: relation edges with similarities; ``features``: order
    features of segments; ``poi``: (seg_id, category, n); ``od``: (slot_start, origin_cluster_id, destination_cluster_id,
    order_count), hourly. Edges and the clusters' table are used by several parts, so they should be written down before.
    """
    from wayfare.operators.partitioning import diameter_metrics

    table, cut = cluster_table(segments, features.select("seg_id", "order_total")), with_cut(edges, segments)
    low = F.col("order_total") < t.small_orders
    return {
        "sizes": table.agg(*(f(c).alias(f"{how}_{what}") for how, f in (("mean", F.avg), ("min", F.min), ("max", F.max)) for what, c in (("segments_per_cluster", "num_segments"), ("cluster_length_m", "total_length"))), F.count_if(low).alias("clusters_below_min_order"), F.avg(low.cast("double")).alias("ratio_clusters_below_min_order"), F.avg("order_total").alias("target_order_capacity")),
        "balance": balance(table),
        "small": small_clusters(table, t),
        "capacity": capacity(table, t),
        "cut": cut_metrics(cut, {p: (f"has_{p}", f"{p}_weight") for p in ("direct", "connector", "continuity")}),
        "road": road_integrity(segments, cut),
        "similarity": cut.where("not is_cut").agg(*(F.avg(c).alias(f"intra_{c}") for c in ("poi_similarity", "order_similarity") if c in cut.columns)),
        "orders": within_squares(features, segments, ["pickup_count", "dropoff_count"], "order"),
        "poi": poi_cluster_metrics(poi, segments),
        "imbalance": imbalance(features, segments),
        "od": od_metrics(od, n_clusters, t),
        "pairs": od_pair_sparsity(od, n_clusters),
        "forecast": historical_average(od, n_clusters),
        "connectivity": connectivity(edges, segments),
        "diameter": diameter_metrics(edges, segments, t.large_diameter_m),
    }


def evaluation_row(segments: DataFrame, edges: DataFrame, od: DataFrame, n_clusters: int) -> DataFrame:
    """The short row by which partitions of one graph are compared when they are made."""
    cut = with_cut(edges, segments)
    table = segments.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("length").alias("total_length"))
    roads = segments.where(nonempty("name")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("k")).where("n > 1")
    share = lambda flag: F.coalesce(F.avg(F.when(F.col(flag), F.col("is_cut").cast("double"))), F.lit(0.0))
    return together({
        "sizes": table.agg(F.count("*").alias("num_clusters"), F.sum("n").alias("num_segments"), F.avg("total_length").alias("mean_cluster_length_m"), F.coalesce(variation("total_length"), F.lit(0.0)).alias("size_balance_cv")),
        "connected": connectivity(edges, segments).select("connected_cluster_ratio", F.col("mean_components").alias("mean_components_per_cluster")),
        "cut": cut.agg(share("has_connector").alias("connector_edge_cut_ratio"), share("has_continuity").alias("continuity_edge_cut_ratio"), *(F.avg(F.when(~F.col("is_cut"), F.col(c))).alias(f"{c.split('_')[0]}_intra_edge_homogeneity") for c in ("poi_similarity", "order_similarity"))),
        "roads": roads.agg(F.coalesce(F.avg("k"), F.lit(0.0)).alias("mean_clusters_per_named_road"), F.coalesce(F.max("k"), F.lit(0).cast("long")).alias("max_clusters_per_named_road")),
        "od": od_pair_sparsity(od, n_clusters).select(F.col("od_pair_sparsity").alias("cluster_od_sparsity")),
    })


def heatmaps(runs: DataFrame, metrics: list[str], row: str = "lambda_c", column: str = "lambda_r", group: str = "initialization") -> DataFrame:
    """(group, metric, row, column, value): the means of regularised runs over a grid of two parameters, in long form."""
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")
    return runs.where("is_regularized").select(group, row, column, long).groupBy(group, "x.metric", row, column).agg(F.avg("x.v").alias("value"))
