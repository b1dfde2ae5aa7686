"""Connected components as an iterative join plan.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Each step is one grouped minimum, which Spark combines before the shuffle, and one
equi-join whose skewed keys adaptive execution splits. Nothing is collected but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayfare.plans.shared import cut


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df``, grouped by a ``key``, as a join side of its own.

    The key is computed anew, so the planner does not reuse the partitioning of the aggregate: both sides of a join on
    it then have an exchange, and adaptive execution can split the other side where a key has very many rows.
    """
    kind = dict(df.dtypes)[key]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(key, F.bitwise_not(F.bitwise_not(key)))
    return df.withColumn(key, F.reverse(F.reverse(key))) if kind == "string" else df


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each node."""
    return apart(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step over (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    joined = large.join(_least(large), "a")
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Return (node, component): component is the smallest node reachable. Only nodes with an edge appear.

    Null endpoints and self loops are ignored; repeated and reversed edges count once. ``rows``: about how many edges
    there may be, for the number of files; from the second round on it is known.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), rows)
    mark = None
    for _ in range(max_rounds):
        after = cut(_star(now), rows)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = after
        if tuple(seen) == mark:
            break
        mark, rows = tuple(seen), seen[0]  # a round adds no edges
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        heads.select("node", F.col("node").alias("component"))
    )
