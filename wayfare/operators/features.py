"""Point-of-interest features of segments and clusters, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def category_mapping(poi: DataFrame) -> DataFrame:
    """(category_col, category): a column name for each category in sorted order."""
    by = Window.orderBy("category")  # ranks a small dimension
    return poi.select("category").where("category is not null").distinct().select(F.format_string("poi_cat_%02d", F.row_number().over(by) - 1).alias("category_col"), "category")


def poi_counts(poi: DataFrame) -> DataFrame:
    return poi.where("category is not null").groupBy("seg_id", "category").agg(F.count("*").alias("n"))


def poi_counts_wide(segments: DataFrame, poi: DataFrame, categories: list[str]) -> DataFrame:
    """One count column for each category, 0 where a segment has none."""
    counts = [F.count_if(F.col("category") == c).alias(f"poi_cat_{i:02d}") for i, c in enumerate(categories)]
    return segments.select("seg_id").join(poi, "seg_id", "left").groupBy("seg_id").agg(*counts, F.count("category").alias("poi_total"))


def poi_features(segments: DataFrame, poi: DataFrame) -> DataFrame:
    """Total, density by km (length at least 1 m), entropy over all categories (0 to 1), commonest category (first by name)."""
    long = poi_counts(poi)
    n_categories = poi.agg(F.count_distinct("category").alias("k"))
    per = long.groupBy("seg_id").agg(
        F.sum("n").alias("poi_total"),
        F.count("*").alias("kinds"),
        F.sum(F.col("n") * F.log("n")).alias("nlogn"),
        F.min_by("category", F.struct((-F.col("n")).alias("n"), "category")).alias("dominant_poi_type"),
    )
    all_ = segments.select("seg_id", "length").join(per, "seg_id", "left").crossJoin(F.broadcast(n_categories))  # one row
    total = F.coalesce("poi_total", F.lit(0))
    entropy = F.when((F.col("kinds") > 1) & (F.col("k") > 1), (F.log("poi_total") - F.col("nlogn") / F.col("poi_total")) / F.log(F.col("k").cast("double"))).otherwise(0.0)
    return all_.select("seg_id", total.alias("poi_total"), (total / (F.greatest("length", F.lit(1.0)) / 1000)).alias("poi_density"), entropy.alias("poi_entropy"), "dominant_poi_type")
