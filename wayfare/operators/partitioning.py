"""Graph kernels on executors: one graph for each group of a variant, one search for each setting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.operators import kernels as k
from wayfare.operators.geometry import shapes

NODE_COLUMNS = ("seg_id", "demand", "length", "x", "y")
EDGE_COLUMNS = ("seg_id_a", "seg_id_b", "weight", "continuity_weight", "connector_weight", "poi_similarity", "order_similarity")

ALGORITHMS = {
    "louvain": lambda g, n: k.modularity_communities(g),
    "leiden": lambda g, n: k.modularity_communities(g, refine=True),
    "skater": lambda g, n: k.skater(g, n),
    "metis": lambda g, n: k.balanced_bisection(g, n),
    "demand_network_voronoi": lambda g, n: k.demand_partition(g, k.Growth(n), grow=False),
    "demand_region_growing": lambda g, n: k.demand_partition(g, k.Growth(n), grow=True),
}


#: The number columns of edges that each algorithm looks at; a graph does not hold the others.
LOOKS_AT = {name: EDGE_COLUMNS[2:] if name.startswith("demand_") else ("weight",) for name in ALGORITHMS}


def graph_of(nodes: pd.DataFrame, edges: pd.DataFrame) -> k.Graph:
    out = k.Builder()
    number = lambda df, c: df[c].to_numpy(np.float64, na_value=np.nan)
    out.add_nodes(nodes["seg_id"].to_numpy(), [number(nodes, c) for c in NODE_COLUMNS[1:]])
    out.add_edges(edges["seg_id_a"].to_numpy(), edges["seg_id_b"].to_numpy(), [number(edges, c) for c in EDGE_COLUMNS[2:]])
    return out.graph()


def _ready(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    doubles = lambda df, names: df.select("variant", *names[: 1 if names is NODE_COLUMNS else 2], *(F.col(c).cast("double").alias(c) for c in names[1 if names is NODE_COLUMNS else 2 :]))
    return doubles(nodes, NODE_COLUMNS), doubles(edges, EDGE_COLUMNS)


def partition(nodes: DataFrame, edges: DataFrame, algorithms: list[str], clusters: int) -> DataFrame:
    """(variant, algorithm, seg_id, cluster_id). Both inputs have ``variant``; each variant and algorithm is a task."""
    for name in algorithms:
        if name not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {name}")
    names = F.explode(F.array(*map(F.lit, algorithms))).alias("algorithm")
    nodes, edges = _ready(nodes, edges)
    id_type = dict(nodes.dtypes)["seg_id"]
    # Nodes and edges come as one sorted stream, so that a task holds the graph alone and not its rows too.
    values = [f"v{i}" for i in range(5)]
    left = nodes.select("variant", names, F.lit(0).alias("kind"), F.col("seg_id").alias("a"), F.lit(None).cast(id_type).alias("b"), *(F.col(c).alias(v) for c, v in zip(NODE_COLUMNS[1:], values)), F.lit(None).cast("double").alias("v4"))
    links = edges.where("seg_id_a is not null and seg_id_b is not null").select("variant", names, F.lit(1).alias("kind"), F.col("seg_id_a").cast(id_type).alias("a"), F.col("seg_id_b").cast(id_type).alias("b"), *(F.col(c).alias(v) for c, v in zip(EDGE_COLUMNS[2:], values)))
    stream = left.union(links).repartition("variant", "algorithm").sortWithinPartitions("variant", "algorithm", "kind", "a", "b")

    def plain(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def labelled(key: tuple, built: k.Builder) -> Iterator[pa.RecordBatch]:
        g = built.graph()
        built.__dict__.clear()
        labels = ALGORITHMS[key[1]](g, min(max(clusters, len(g.components())), len(g))) if len(g) else []
        for at in range(0, len(g), 1 << 16):
            ids = g.ids[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(ids), pa.string()) for x in key] + [pa.array(ids, out_type), pa.array(labels[at : at + (1 << 16)], pa.int64())], names=["variant", "algorithm", "seg_id", "cluster_id"])

    out_type = to_arrow_type(nodes.schema["seg_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, built = None, None
        for batch in batches:
            kind = plain(batch.column("kind"))
            code = [plain(batch.column(c).dictionary_encode().indices.fill_null(-1)) for c in ("variant", "algorithm")]
            ends = [*(np.flatnonzero((np.diff(code[0]) != 0) | (np.diff(code[1]) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(kind)]
            at = 0
            for end in ends if len(kind) else []:
                some, at = batch.slice(at, end - at), end
                own = (some.column("variant")[0].as_py(), some.column("algorithm")[0].as_py())
                if own != key:
                    if built is not None:
                        yield from labelled(key, built)
                    key, built = own, k.Builder()
                if some.column("kind")[0].as_py() == 0:
                    built.add_nodes(plain(some.column("a")), [plain(some.column(v)).astype(np.float64) for v in values[:4]])
                else:
                    built.add_edges(plain(some.column("a")), plain(some.column("b")), [plain(some.column(v)).astype(np.float64) if c in LOOKS_AT[own[1]] else None for c, v in zip(EDGE_COLUMNS[2:], values)])
        if built is not None:
            yield from labelled(key, built)

    return stream.mapInArrow(run, f"variant string, algorithm string, seg_id {id_type}, cluster_id long")


def search(nodes: DataFrame, edges: DataFrame, initial: DataFrame, settings: DataFrame, clusters: int | None, merge_split: bool = True, passes: int = 5) -> DataFrame:
    """The trace of the regularised search: (variant, algorithm, setting_id, step, kind, delta, objective and parts, num_clusters).

    ``initial``: (variant, algorithm, seg_id, cluster_id); ``settings``: (setting_id, lambda_c, lambda_r). Each
    initial partition with each setting is a task. An initial partition that lacks a node is an error.
    """
    nodes, edges = _ready(nodes, edges)
    starts = initial.select("variant", "algorithm").distinct().crossJoin(settings)  # the grid that is asked for
    keys = ["variant", "algorithm", "setting_id"]
    left = starts.join(nodes.join(initial, ["variant", "seg_id"], "left"), ["variant", "algorithm"])
    named = starts.select(*keys).join(edges, "variant")
    right = named.select(*(F.col(c).alias(c) for c in named.columns))  # columns of its own, as both sides hold the grid

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if own["cluster_id"].isna().any():
            raise ValueError("the initial partition lacks nodes")
        g = graph_of(own, links)
        label = dict(zip(own["seg_id"], own["cluster_id"].astype(int), strict=True))
        first = own.iloc[0]
        o = k.Objective(clusters=clusters, lambda_c=float(first["lambda_c"]), lambda_r=float(first["lambda_r"]))
        labels, trace = k.regularized_search(g, [label[x] for x in g.ids], o, k.Search(passes=passes, merge_split=merge_split))
        out = pd.DataFrame(trace)
        out["num_clusters"] = len(set(labels))
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "step", "kind", "delta", "objective", "r_cap", "r_graph", "r_cont", "r_conn", "num_clusters"]]

    schema = "variant string, algorithm string, setting_id string, step long, kind string, delta double, objective double, r_cap double, r_graph double, r_cont double, r_conn double, num_clusters long"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def diameters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, diameter) of each cluster's own graph. ``clusters``: (seg_id, cluster_id, length)."""
    side = lambda s: clusters.select(F.col("seg_id").alias(f"seg_id_{s}"), F.col("cluster_id").alias(f"c_{s}"))
    inner = edges.select("seg_id_a", "seg_id_b").join(side("a"), "seg_id_a").join(side("b"), "seg_id_b").where("c_a = c_b").select(F.col("c_a").alias("cluster_id"), "seg_id_a", "seg_id_b")

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        g = k.Graph.build(((i, 1.0, n, 0.0, 0.0) for i, n in zip(own["seg_id"], own["length"], strict=True)), ((a, b, 1.0, 0.0, 0.0, 0.0, 0.0) for a, b in zip(links["seg_id_a"], links["seg_id_b"], strict=True)))
        return pd.DataFrame({"cluster_id": [key[0]], "diameter": [k.diameter(g, set(range(len(g))))]})

    return clusters.select("seg_id", "cluster_id", "length").groupBy("cluster_id").cogroup(inner.groupBy("cluster_id")).applyInPandas(run, f"cluster_id {dict(clusters.dtypes)['cluster_id']}, diameter double")


def diameter_metrics(edges: DataFrame, clusters: DataFrame, large_m: float = 30_000.0) -> DataFrame:
    return diameters(edges, clusters).agg(F.avg("diameter").alias("diameter_mean"), F.max("diameter").alias("diameter_max"), F.avg((F.col("diameter") > large_m).cast("double")).alias("large_diameter_ratio"))


def shape_metrics(lines: DataFrame, radius: float = 50.0, long: float = 10.0) -> DataFrame:
    """Mean, median, least and most of each figure, and the share of elongated clusters."""
    figures = ("compactness", "hull_ratio", "elongation", "perimeter_to_root_area")
    out = []
    for c in figures:
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return shapes(lines, radius).agg(*out, F.avg((F.col("elongation") > long).cast("double")).alias("elongated_ratio"))


def colour_diagnostics(borders: DataFrame) -> DataFrame:
    """Neighbours and colour distances of each cluster under a greedy contrast colouring.

    ``borders``: (cluster_a, cluster_b), the touching clusters; a map has few, so one task colours it.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(own["cluster_a"], own["cluster_b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        colour = k.contrast_colours(near)
        rows = []
        for c in sorted(near):
            d = [k.math.dist(colour[c], colour[x]) for x in near[c]]
            rows.append((c, "#%02x%02x%02x" % colour[c], len(d), min(d), sum(d) / len(d)))
        return pd.DataFrame(rows, columns=["cluster_id", "colour", "neighbours", "min_distance", "mean_distance"])

    return borders.select("cluster_a", "cluster_b", F.lit("all").alias("map")).groupBy("map").applyInPandas(run, f"cluster_id {dict(borders.dtypes)['cluster_a']}, colour string, neighbours long, min_distance double, mean_distance double")
