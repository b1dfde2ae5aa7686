"""Road network preparation: scope, access and service filters, roles, ring candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayfare.functions.scalars import name_matches, road_name
from wayfare.operators.geometry import inside_ratio, legs
from wayfare.operators.spatial import lines_within
from wayfare.plans.shared import cut

#: Tags that decide access, weakest first. Fixed values.
ACCESS_COLUMNS = ("access", "vehicle", "motor_vehicle", "psv", "motorcar", "taxi")


def tag_values(c: str) -> Column:
    """The values of a tag: lower case, split at ; and |, trimmed, blanks dropped; null as none."""
    parts = F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[;|]")
    return F.filter(F.transform(parts, F.trim), lambda v: v != "")


def first_value(c: str) -> Column:
    """The first element of a list-valued tag, null if there is none."""
    return F.get(F.col(c), F.lit(0))


def access_verdict(allowed: list[str], excluded: list[str], designated: list[str]) -> Column:
    """struct(allowed, reason): the strongest tag that says anything decides; without tags access is allowed."""
    out = F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason"))
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    for c in ACCESS_COLUMNS:
        values = tag_values(c)
        bad = F.filter(values, lambda v: F.array_contains(strings(excluded), v))
        good = F.arrays_overlap(values, strings(allowed)) | (F.array_contains(values, "designated") if c in designated else F.lit(False))
        deny = lambda v, c=c: F.struct(F.lit(False).alias("allowed"), F.concat(F.lit(f"{c}="), v).alias("reason"))
        out = (
            F.when(F.size(values) == 0, out)
            .when(F.size(bad) > 0, deny(F.get(bad, F.lit(0))))
            .when(good, F.struct(F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason")))
            .otherwise(deny(F.get(values, F.lit(0))))
        )
    return out


def service_allowed(excluded: list[str], columns: list[str]) -> Column:
    """False for service roads of an excluded kind; true for all if there is no such column."""
    if "service" not in columns:
        return F.lit(True)
    return ~F.coalesce((F.col("highway") == "service") & F.col("service").isin(*excluded), F.lit(False))


def segment_role(max_connector_m: float = 120.0) -> Column:
    """connector for short links, else ordinary."""
    return F.when(F.col("highway").endswith("_link") & (F.col("length") <= max_connector_m), "connector").otherwise("ordinary")


def with_seg_ids(edges: DataFrame, order: list[str]) -> DataFrame:
    """seg_0000000 and on, in the order of a key that identifies the edges.

    Positions need a total order, which range-partitioning with per-partition counts gives without one big task.
    """
    ranged = edges.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds come from a sample, so positions are written down before they are used twice.
    placed = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    by = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_p").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n")
    return placed.join(F.broadcast(base), "_p").withColumn("seg_id", F.format_string("seg_%07d", F.col("base") + F.col("_k"))).drop("_p", "_k", "base")


def ring_candidates(edges: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Edges whose name marks the ring road."""
    return edges.withColumn("normalized_name", road_name("name")).where(name_matches(F.col("normalized_name"), include, exclude))


def ring_summary(ring: DataFrame) -> DataFrame:
    """What validation of a ring looks at: number, kilometres and spans."""
    return ring.agg(F.count("*").alias("n_segments"), (F.sum("length") / 1000).alias("total_km"), (F.max("x") - F.min("x")).alias("x_span"), (F.max("y") - F.min("y")).alias("y_span"))


def top_reasons(rejected: DataFrame, n: int = 10) -> DataFrame:
    """The commonest reasons, ties by name. A top-k report."""
    return rejected.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def inside_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as nulls of a type."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def safe_names(df: DataFrame) -> DataFrame:
    """Columns renamed for file formats: : and - as _, names that differ in case alone numbered; lists and maps as text."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        clean = c.replace(":", "_").replace("-", "_")
        n = seen[clean.lower()] = seen.get(clean.lower(), 0) + 1
        names.append(clean if n == 1 else f"{clean}_{n - 1}")
    kinds = dict(df.dtypes)
    out = []
    for c, name in zip(df.columns, names, strict=True):
        kind, value = kinds[c], F.col(f"`{c}`")
        if kind.startswith("array<") and not kind.startswith("array<struct"):
            value = F.get(value, F.lit(0))
        elif kind.startswith(("array<", "map<", "struct<")):
            value = F.to_json(value)
        out.append(value.alias(name))
    return df.select(*out)


def highway_filter(edges: DataFrame, keep: list[str], exclude: list[str] = ()) -> DataFrame:
    """Edges of the highway classes to keep that are not among those to leave out."""
    kept = edges.where(F.col("highway").isin(*keep))
    return kept.where(~F.col("highway").isin(*exclude)) if exclude else kept


def scope_mask(edges: DataFrame, ring: DataFrame, boundary: list[tuple[float, float]], include: list[str], exclude: list[str] = (), threshold: float = 0.98, tolerance: float = 0.0, corridor: float = 0.0, keep_ring: bool = True) -> DataFrame:
    """``edges`` (seg_id, name, geom) with inside_ratio, ``inside``, ``on_ring`` and ``in_scope``.

    ``inside``: at least ``threshold`` of the length is inside the boundary widened by ``tolerance``. ``on_ring``: the
    name marks the ring road and some part is within ``corridor`` of the ``ring`` lines. Edges and ring meet by cells.
    """
    share = inside_ratio(edges, "seg_id", boundary, tolerance)
    out = edges.join(share, "seg_id", "left").withColumn("inside", F.coalesce(F.col("inside_ratio") >= threshold, F.lit(False)))
    if keep_ring:
        named = edges.where(name_matches(road_name("name"), [x.replace(" ", "") for x in include], [x.replace(" ", "") for x in exclude]))
        near = lines_within(legs(named), legs(ring.select("geom")), corridor).select("seg_id").distinct().withColumn("on_ring", F.lit(True))
        out = out.join(near, "seg_id", "left").withColumn("on_ring", F.coalesce("on_ring", F.lit(False)))
    else:
        out = out.withColumn("on_ring", F.lit(False))
    return out.withColumn("in_scope", F.col("inside") | F.col("on_ring"))
