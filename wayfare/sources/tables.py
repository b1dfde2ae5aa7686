"""Reading and writing of the domain's data sets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.errors import AnalysisException

#: The supply tables' columns, in the order of their files. Fixed values.
SUPPLY_COLUMNS = {
    "segments": ("segment_id", "driver_id", "trip_start", "trip_end", "origin_cluster_id", "destination_cluster_id", "service_type", "order_ids"),
    "chains": ("chain_id", "driver_id", "date_", "chain_seq", "chain_start", "chain_end", "start_cluster_id", "end_cluster_id", "num_segments", "segment_ids"),
    "idle": ("chain_id", "driver_id", "cluster_id", "idle_start", "idle_end", "idle_minutes"),
    "available": ("slot_start", "cluster_id", "available_vehicles"),
    "in_service": ("slot_start", "origin_cluster_id", "destination_cluster_id", "in_service_vehicles"),
    "fleet": ("slot_start", "cluster_id", "fleet_lower_bound", "global_fleet_lower_bound"),
}


def read_orders_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Raw orders from (compressed) CSV: ids as text, times and coordinates that do not parse as null.

    Columns are found by their names in the header, which ``columns`` may give where they differ.
    """
    names = "order_id driver_id starting_lng starting_lat dest_lng dest_lat departure_time finish_time".split()
    raw = spark.read.csv(path, header=True, inferSchema=False).select(*(F.col(f"`{(columns or {}).get(n, n)}`").alias(n) for n in names))
    number = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in names[2:6]}
    time = {c: F.expr(f"try_cast({c} AS TIMESTAMP_NTZ)") for c in names[6:]}
    return raw.withColumns(number | time)


def try_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def as_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.withColumns(nested) if nested else df


def write_csv_gz(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A directory of compressed CSV parts with headers; an empty frame gives a header alone."""
    as_text(df).write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def write_supply(tables: dict[str, DataFrame], folder: str, by_day: bool = False, text: bool = False) -> dict[str, DataFrame]:
    """The supply tables as Parquet below ``folder``, by ``proc_date`` in daily mode, and as compressed CSV if asked; each read again."""
    out = {}
    for name, columns in SUPPLY_COLUMNS.items():
        df = tables[name]
        days = ["proc_date"] if by_day and "proc_date" in df.columns else []
        wanted = df.select(*days, *columns)
        writer = wanted.write.mode("overwrite")
        (writer.partitionBy(*days) if days else writer).parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.schema(wanted.schema).parquet(f"{folder}/{name}")  # an empty table has no file to take it from
        if text:
            write_csv_gz(out[name], f"{folder}/{name}.csv.gz")
    return out


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at a path, built and written first where it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(data: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small metadata file; NaN and infinities become null. With a session it goes to the store that the path names."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [plain(v) for v in x]
        if hasattr(x, "item"):
            x = x.item()
        return None if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x if isinstance(x, (str, int, float, bool, type(None))) else str(x)

    text = json.dumps(plain(data), ensure_ascii=False, indent=2)
    if spark is None:
        Path(path).write_text(text)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append_manifest(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rows`` to a Parquet manifest, each with the next ``ordinal``, and give the last row of each key.

    Runs that are done need not be made again: see :func:`unfinished`. One writer at a time.
    """
    from wayfare.operators.selection import keep_last

    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", ordinal long"
    last = try_read(spark, path, schema).agg(F.coalesce(F.max("ordinal"), F.lit(-1))).first()[0]
    rows.withColumn("ordinal", F.lit(last + 1).cast("long")).write.mode("append").parquet(path)
    return keep_last(spark.read.schema(schema).parquet(path), keys, "ordinal")


def unfinished(wanted: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose keys the manifest lacks, for a run that goes on where one stopped."""
    return wanted.join(manifest.select(*keys), keys, "left_anti")
