"""Keyed upsert on plain parquet: an append-only log of batches, and views that keep the newest rows.

Batch N of a job is the folder ``batch_id=N``, divided by ingestion date where the table has one, so that bounds on dates
leave out files. Writing it again replaces it, so a replayed batch changes nothing, and readers of the log as a stream
never miss rows. A log and the checkpoint of its writer live and die together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.sources.tables import PARTITIONS, SORTED, create_if_missing, parsed_schema

BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int, keys: Sequence[str] = ()) -> None:
    """Write one batch; with ``keys`` it holds one row per key (ties: the largest row)."""
    rows = largest_per_key(df, keys) if keys else df
    target = f"{path.rstrip('/')}/{BATCH}={batch_id}"
    if {*PARTITIONS, *SORTED} <= set(df.columns):
        # Few files per date; a date with most of the rows is split again.
        spread = rows.hint("rebalance", *[F.col(c) for c in PARTITIONS]).sortWithinPartitions(*PARTITIONS, *SORTED)
        # A replay replaces the whole batch, whatever the session says about partitions.
        replacing = spread.write.mode("overwrite").option("partitionOverwriteMode", "static")
        replacing.partitionBy(*PARTITIONS).parquet(target)
    else:
        rows.write.mode("overwrite").parquet(target)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    create_if_missing(spark, path, schema)
    full = parsed_schema(f"{schema}, {BATCH} BIGINT")
    return spark.read.schema(full).parquet(path).select(full.names)


def stream_log(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Incremental scan of an upserted table."""
    create_if_missing(spark, path, schema)
    full = parsed_schema(f"{schema}, {BATCH} BIGINT")
    # Folder columns last, in the order of the folders: that is where Spark puts them once an empty table gets its first batch.
    folders = [f for f in (BATCH, *PARTITIONS) if f in full.names]
    reader = spark.readStream.schema(StructType([*[f for f in full if f.name not in folders], *[full[f] for f in folders]]))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select(full.names)


def once(df: DataFrame, path: str) -> DataFrame:
    """Rows a micro-batch uses several times, computed once: written to a scratch table of the job, which the next batch replaces."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the largest. An aggregation, not a window, so rows of one key are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(rows.columns)


def _of_newest_batch(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of each key's newest batch. Only keys and batch numbers are aggregated; a null is a key like any other."""
    newest = log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(BATCH).alias("_newest"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return log.join(newest, [*same, F.col(BATCH) == F.col("_newest")], "left_semi")


def current(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert view: update-all on a matching key, insert-all otherwise. Batches hold one row per key (``write_batch``)."""
    return _of_newest_batch(log, keys).drop(BATCH)


def current_by_trace(log: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Replace-by-trace view: all rows of the newest batch of each trace, so steps can also disappear."""
    return _of_newest_batch(log, [trace]).drop(BATCH)
