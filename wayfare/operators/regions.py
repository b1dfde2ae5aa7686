"""Tables and graphs of clusters: index, summaries, road, similarity and distance edges, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wayfare.functions.scalars import nonempty


#: Query vectors sent to tasks at once.
QUERY_BLOCK = 2000


def cluster_road_edges(edges: DataFrame, partition: DataFrame, weight: str = "base_weight") -> DataFrame:
    """Weight and number of segment edges between clusters; inner edges and unknown segments fall out."""
    if weight not in edges.columns:
        if "weight" not in edges.columns:
            raise ValueError("edges have no weight")
        weight = "weight"
    side = lambda s: partition.select(F.col("seg_id").alias(f"seg_id_{s}"), F.col("cluster_id").alias(f"c_{s}"))
    joined = edges.join(side("a"), "seg_id_a").join(side("b"), "seg_id_b").where("c_a <> c_b")
    return joined.groupBy(F.least("c_a", "c_b").alias("cluster_a"), F.greatest("c_a", "c_b").alias("cluster_b")).agg(F.sum(F.greatest(weight, F.lit(0.0))).alias("weight"), F.count("*").alias("edge_count"))


def cluster_index(segments: DataFrame) -> DataFrame:
    """Number of segments, length, and length-weighted centre of the segments' middles (x, y)."""
    return segments.groupBy("cluster_id").agg(
        F.count("*").alias("num_segments"),
        F.sum("length").alias("total_length_m"),
        (F.sum(F.col("x") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0.0))).alias("centroid_x"),
        (F.sum(F.col("y") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0.0))).alias("centroid_y"),
    )


def cluster_summary(segments: DataFrame) -> DataFrame:
    """Count, length, distinct names, and the commonest highway (ties by name)."""
    kinds = segments.groupBy("cluster_id", "highway").agg(F.count("*").alias("n"), F.sum("length").alias("len"))
    most = kinds.groupBy("cluster_id").agg(F.sum("n").alias("num_segments"), F.sum("len").alias("total_length"), F.min_by("highway", F.struct((-F.col("n")).alias("n"), "highway")).alias("dominant_highway"))
    names = segments.groupBy("cluster_id").agg(F.count_distinct("name").alias("num_names"))
    return most.join(names, "cluster_id")


def road_name_diagnostics(segments: DataFrame) -> DataFrame:
    """Names of more than one segment and over how many clusters each is spread."""
    named = segments.where(nonempty("name")).groupBy("name").agg(F.count("*").alias("num_segments"), F.count_distinct("cluster_id").alias("num_clusters"), F.sum("length").alias("total_length"))
    return named.where("num_segments > 1")


def similarity_topk(vectors: DataFrame, id_col: str, k: int) -> DataFrame:
    """(a, b, weight): pairs among each row's k most similar others with a positive cosine, both directions joined.

    ``vectors`` is long: (id, key, value). The sum over shared keys is one join on the key, so rows without a
    common key never meet.
    """
    norm = vectors.groupBy(id_col).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).where("norm > 0")
    unit = vectors.join(norm, id_col).select(F.col(id_col).alias("i"), "key", (F.col("value") / F.col("norm")).alias("w"))
    score = unit.join(unit.select(F.col("i").alias("j"), "key", F.col("w").alias("w2")), "key").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("w2")).alias("score")).where("score > 0")
    return _best(score, F.desc("score"), k).groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("score").alias("weight"))


def distance_topk(index: DataFrame, k: int, decay: float = 3000.0) -> DataFrame:
    """(a, b, weight, distance): each cluster's k nearest by centre, weighted exp(-distance / decay)."""
    side = lambda s: index.select(F.col("cluster_id").alias(s), F.col("centroid_x").alias(f"x{s}"), F.col("centroid_y").alias(f"y{s}"))
    apart = side("i").crossJoin(side("j")).where("i <> j")  # clusters are a small dimension and the answer is about all their pairs
    far = apart.select("i", "j", F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)).alias("distance")).where("distance is not null")
    best = _best(far, F.asc("distance"), k)
    return best.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(F.exp(-F.col("distance") / decay)).alias("weight"), F.min("distance").alias("distance"))


def _best(pairs: DataFrame, order, k: int) -> DataFrame:
    by = Window.partitionBy("i").orderBy(order, "j")
    return pairs.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)


def normalized_adjacency(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """(row, col, value) of D^-1/2 (A + I) D^-1/2, or D^-1 (A + I). ``edges``: (a, b, weight); ``nodes``: (node)."""
    full = edges.select(F.col("a").alias("row"), F.col("b").alias("col"), "weight").union(edges.select("b", "a", "weight")).union(nodes.select("node", F.col("node"), F.lit(1.0)))
    cells = full.groupBy("row", "col").agg(F.sum("weight").alias("weight"))
    degree = cells.groupBy("row").agg(F.sum("weight").alias("degree"))
    joined = cells.join(degree, "row")
    if not symmetric:
        return joined.select("row", "col", (F.col("weight") / F.nullif("degree", F.lit(0.0))).alias("value"))
    other = degree.select(F.col("row").alias("col"), F.col("degree").alias("degree2"))
    return joined.join(other, "col").select("row", "col", (F.col("weight") / F.sqrt("degree") / F.sqrt("degree2")).alias("value"))


def cluster_adjacency(edges: DataFrame, partition: DataFrame, weight: str = "base_weight") -> DataFrame:
    """Both directions of the cluster road edges."""
    one = cluster_road_edges(edges, partition, weight)
    return one.union(one.select("cluster_b", "cluster_a", "weight", "edge_count"))


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of ``vectors`` most like each query by cosine.

    A stated set of queries against all rows. Each task keeps its own k best of every query, so what is shuffled
    is k rows for each query and task. Queries reach the driver in blocks of about ``QUERY_BLOCK`` rows.
    """
    import numpy as np
    import pyarrow as pa

    spark, out = vectors.sparkSession, None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toPandas()
        if not len(rows):
            continue
        q = np.array(rows["embedding"].tolist(), dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        q_ids = rows["vec_id"].to_numpy()

        def run(batches, q=q, q_ids=q_ids):
            kept_s, kept_n = np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64)
            for batch in batches:
                v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                v_ids, score = batch.column("vec_id").to_numpy(), np.round(q @ v.T, 12)
                score[q_ids[:, None] == v_ids[None]] = -np.inf
                # All scores from each query's k-th best on, so that ties can be told apart by id.
                score = np.concatenate((kept_s, score), axis=1)
                least = np.partition(score, -k, axis=1)[:, -k]
                row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                s, n = score[row, column], np.where(column < k, kept_n[row, np.minimum(column, k - 1)], v_ids[np.maximum(column - k, 0)])
                order = np.lexsort((n, -s, row))
                row, s, n = row[order], s[order], n[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank < k
                kept_s[:] = -np.inf
                kept_s[row[best], rank[best]], kept_n[row[best], rank[best]] = s[best], n[best]
            row, rank = np.nonzero(kept_s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(kept_n[row, rank]), pa.array(kept_s[row, rank])], names=["query_id", "vec_id", "score"])

        part = vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
