"""The relation graph of road segments.

Pairs come from shared end nodes and from connectors; continuity is scored on pairs that exist; similarities
shift the weights of variants. Contributions are unioned and grouped once by the canonical pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayfare.functions.scalars import continuity, cosine, inverse_difference, signed_log

DIRECT, CONNECTOR, CONTINUITY = 1.0, 0.8, 2.0


def incidents(segments: DataFrame) -> DataFrame:
    """(node, seg_id) once for each end node of a segment."""
    return segments.select("seg_id", F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()


def incident_pairs(segments: DataFrame) -> DataFrame:
    """(seg_id_a, seg_id_b, n_nodes): pairs that share nodes, a before b."""
    at = incidents(segments)
    a, b = at.select("node", F.col("seg_id").alias("seg_id_a")), at.select("node", F.col("seg_id").alias("seg_id_b"))
    return a.join(b, "node").where("seg_id_a < seg_id_b").groupBy("seg_id_a", "seg_id_b").agg(F.count("*").alias("n_nodes"))


def connector_pairs(connectors: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each connector and each pair of different segments at its two ends."""
    at = incidents(segments)
    left = connectors.select(F.col("seg_id").alias("connector_id"), F.col("highway").alias("connector_highway"), "u", "v").join(at.select(F.col("node").alias("u"), F.col("seg_id").alias("l")), "u")
    both = left.join(at.select(F.col("node").alias("v"), F.col("seg_id").alias("r")), "v").where("l <> r")
    return both.select(F.least("l", "r").alias("seg_id_a"), F.greatest("l", "r").alias("seg_id_b"), "connector_id", "connector_highway")


def relation_edges(segments: DataFrame, connectors: DataFrame) -> DataFrame:
    """Edge records: component weights, base weight, flags, connectors as sorted text."""
    nothing = F.lit(None).cast("string")
    direct = incident_pairs(segments).select("seg_id_a", "seg_id_b", (F.col("n_nodes") * DIRECT).alias("d"), F.lit(0.0).alias("c"), nothing.alias("id"), nothing.alias("kind"))
    bridged = connector_pairs(connectors, segments).select("seg_id_a", "seg_id_b", F.lit(0.0).alias("d"), F.lit(CONNECTOR).alias("c"), F.col("connector_id").cast("string").alias("id"), F.col("connector_highway").alias("kind"))
    joined = (
        direct.union(bridged)
        .groupBy("seg_id_a", "seg_id_b")
        .agg(F.sum("d").alias("direct_weight"), F.round(F.sum("c"), 9).alias("connector_weight"), F.count("id").alias("connector_count"), F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    )
    named = joined
    for side in "ab":
        traits = segments.select(F.col("seg_id").alias(f"seg_id_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in ("name", "osmid", "highway", "bearing")))
        named = named.join(traits, f"seg_id_{side}")
    scored = named.withColumn("continuity_score", continuity("a", "b")).withColumn("continuity_weight", F.col("continuity_score") * CONTINUITY)
    base = F.col("direct_weight") + F.col("connector_weight") + F.col("continuity_weight")
    flags = {"has_direct": F.col("direct_weight") > 0, "has_connector": F.col("connector_count") > 0, "has_continuity": F.col("continuity_score") > 0}
    kinds = F.concat_ws("|", *(F.when(test, name) for name, test in (("connector", flags["has_connector"]), ("continuity", flags["has_continuity"]), ("direct", flags["has_direct"]))))
    same = F.coalesce((F.col("a_name") == F.col("b_name")) & (F.col("a_name") != ""), F.lit(False))
    return scored.select(
        "seg_id_a", "seg_id_b", "direct_weight", "connector_weight", "connector_count", "continuity_score", "continuity_weight", base.alias("base_weight"),
        *(test.alias(name) for name, test in flags.items()), same.alias("same_name"), kinds.alias("relation_types"), F.concat_ws("|", "ids").alias("connector_ids"), F.concat_ws("|", "kinds").alias("connector_highways"),
    )


def poi_inputs(segments: DataFrame, poi: DataFrame) -> DataFrame:
    """Count vectors by category, log density and entropy of each segment; segments without POI have zeros."""
    from wayfare.operators.features import poi_features

    cats = [r[0] for r in poi.select("category").where("category is not null").distinct().orderBy("category").collect()]
    wide = poi.groupBy("seg_id").pivot("category", cats).count().fillna(0)
    vector = F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("double") for c in cats)) if cats else F.array().cast("array<double>")
    own = segments.join(wide, "seg_id", "left").select("seg_id", vector.alias("poi_vector"))
    return own.join(poi_features(segments, poi).select("seg_id", "poi_total", F.log1p("poi_density").alias("log_density"), "poi_entropy"), "seg_id")


def poi_similarity(edges: DataFrame, inputs: DataFrame) -> DataFrame:
    """0.7 cosine + 0.2 density + 0.1 entropy closeness on the pairs of ``edges``; 0 if either segment has no POI."""
    span = inputs.agg(F.greatest(F.max("log_density") - F.min("log_density"), F.lit(1.0)).alias("d"), F.greatest(F.max("poi_entropy") - F.min("poi_entropy"), F.lit(1.0)).alias("e"))
    side = lambda s: inputs.select(F.col("seg_id").alias(f"seg_id_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in inputs.columns if c != "seg_id"))
    both = edges.select("seg_id_a", "seg_id_b").join(side("a"), "seg_id_a").join(side("b"), "seg_id_b").crossJoin(F.broadcast(span))  # one row
    value = 0.7 * cosine("a_poi_vector", "b_poi_vector") + 0.2 * inverse_difference("a_log_density", "b_log_density", F.col("d")) + 0.1 * inverse_difference("a_poi_entropy", "b_poi_entropy", F.col("e"))
    some = (F.col("a_poi_total") > 0) & (F.col("b_poi_total") > 0)
    return both.select("seg_id_a", "seg_id_b", F.when(some, value).otherwise(0.0).alias("poi_similarity"))


ORDER_COLUMNS = ("pickup_count", "dropoff_count", "order_total", "pickup_dropoff_imbalance", "morning_peak_pickups", "evening_peak_pickups", "night_pickups", "weekday_pickups", "weekend_pickups", "weekday_weekend_diff")


def order_similarity(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Cosine of the signed logarithms of ten order features on the pairs of ``edges``; 0 if either has no orders."""
    vector = signed_log(F.array(*(F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ORDER_COLUMNS)))
    side = lambda s: features.where("order_total > 0").select(F.col("seg_id").alias(f"seg_id_{s}"), vector.alias(f"{s}_v"))
    both = edges.select("seg_id_a", "seg_id_b").join(side("a"), "seg_id_a", "left").join(side("b"), "seg_id_b", "left")
    return both.select("seg_id_a", "seg_id_b", F.when(F.col("a_v").isNotNull() & F.col("b_v").isNotNull(), cosine("a_v", "b_v")).otherwise(0.0).alias("order_similarity"))


def edge_variants(edges: DataFrame, variants: dict[str, tuple[float, float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Each edge under each variant: base + w_poi * poi similarity + w_order * order similarity.

    ``keep``: further columns; a similarity among them is 0 where its variant does not count it.
    """
    rows = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(float(p)).alias("p"), F.lit(float(o)).alias("o")) for n, (p, o) in variants.items()))
    each = edges.withColumn("x", F.explode(rows))
    used = {"poi_similarity": F.col("x.p") > 0, "order_similarity": F.col("x.o") > 0}
    others = [F.when(used[c], F.col(c)).otherwise(0.0).alias(c) if c in used else F.col(c) for c in keep]
    return each.select("x.variant", "seg_id_a", "seg_id_b", (F.col("base_weight") + F.col("x.p") * F.col("poi_similarity") + F.col("x.o") * F.col("order_similarity")).alias("weight"), *others)
