"""Order-dependent building blocks that keep one hot key from landing in one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. These helpers cut each key's rows into slices
of the ordering column first: the heavy work is per (key, slice), and only one small row per slice meets the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions.timeparts import floor_div


def step_slice(ts_ms: Column, span_id: Column, slice_ms: int) -> Column:
    """Slice of a step within its trace, in step order.

    Steps without a start time all share time 0 and are ordered by span id alone, so they are sliced by id prefix.
    """
    ts = F.coalesce(ts_ms, F.lit(0).cast("bigint"))
    return F.struct(
        floor_div(ts, slice_ms).alias("slot"),
        (ts > 0).alias("timed"),
        F.when(ts == 0, F.substring(F.coalesce(span_id, F.lit("")), 1, 2)).otherwise(F.lit("")).alias("prefix"),
    )


# Slices of one section: the most rows that meet in one task, per key, to find what lies before a slice.
SECTION_SLICES = 1024


def _section(sliced: DataFrame) -> Column:
    """Number of a slice's section; it does not decrease along the slices."""
    slot = F.col("_slice.slot") if isinstance(sliced.schema["_slice"].dataType, StructType) else F.col("_slice")
    return F.floor(slot.cast("double") / SECTION_SLICES).cast("bigint")


def _with_earlier_slices(
    sliced: DataFrame, inside: Column, fold: Callable[[Column | str], Column], both: Callable[[Column, Column], Column], keys: list[str]
) -> DataFrame:
    """Adds ``_inside`` (a fold over the rows before within the slice) and ``_before`` (over the earlier slices).

    Slices meet in sections, and only one row per section meets the others. ``both`` folds two values, either of which may be null.
    """
    per_slice = sliced.withColumn("_section", _section(sliced)).groupBy(*keys, "_section", "_slice").agg(fold("_value").alias("_folded"))
    earlier = Window.partitionBy(*keys, "_section").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sections = per_slice.groupBy(*keys, "_section").agg(fold("_folded").alias("_whole"))
    earlier_sections = Window.partitionBy(*keys).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    entered = sections.select(
        *[F.col(k).alias(f"_e_{k}") for k in keys], F.col("_section").alias("_e_section"), fold("_whole").over(earlier_sections).alias("_entered")
    )
    same = F.col("_section").eqNullSafe(F.col("_e_section"))
    match = F.col("_slice").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    offsets = per_slice.withColumn("_own", fold("_folded").over(earlier)).join(entered, same).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_at"), both(F.col("_own"), F.col("_entered")).alias("_before")
    )
    return sliced.withColumn("_inside", inside).join(offsets, match).drop("_at", *[f"_k_{k}" for k in keys])


def _sum_of(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def running_total(
    df: DataFrame, order_by: list[str], weight: Column, slice_of: Column, name: str, keys: list[str] | None = None
) -> DataFrame:
    """Adds the running total of ``weight``, this row included, in the order of ``order_by`` within ``keys``.

    ``slice_of`` must not decrease along ``order_by``. With weight 1 the result is a row number.
    """
    keys = keys or []
    rows = Window.partitionBy(*keys, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sliced = df.select("*", slice_of.alias("_slice"), weight.alias("_value"))
    summed = _with_earlier_slices(sliced, F.sum("_value").over(rows), F.sum, _sum_of, keys)
    total = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_inside")
    return summed.select(*df.columns, total.alias(name))


def running_max_before(
    df: DataFrame, order_by: list[str], value: Column, slice_of: Column, name: str, keys: list[str]
) -> DataFrame:
    """Adds the largest ``value`` of the rows before this one (null for the first), like ``running_total``."""
    rows = Window.partitionBy(*keys, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    sliced = df.select("*", slice_of.alias("_slice"), value.alias("_value"))
    folded = _with_earlier_slices(sliced, F.max("_value").over(rows), F.max, F.greatest, keys)
    return folded.select(*df.columns, F.greatest("_before", "_inside").alias(name))


def with_previous(
    df: DataFrame, keys: list[str], order_by: str, values: list[str], slice_of: Column, name: str
) -> DataFrame:
    """Adds struct ``name`` with ``order_by`` and ``values`` of the row before, null for the first row of a key.

    Rows must be unique per (keys, order_by). The first row of a slice takes the last row of the slice before it.
    """
    sliced = df.withColumn("_slice", slice_of)
    row = F.struct(F.col(order_by), *[F.col(v) for v in values])
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(row, F.col(order_by)).alias("_last"))
    carried = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_at"),
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
    )
    match = F.col("_slice").eqNullSafe(F.col("_at"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.lag(row).over(Window.partitionBy(*keys, "_slice").orderBy(order_by))
    return (
        sliced.withColumn("_inside", inside)
        .join(carried, match)
        .withColumn(name, F.coalesce(F.col("_inside"), F.col("_carried")))
        .drop("_slice", "_at", "_inside", "_carried", *[f"_k_{k}" for k in keys])
    )


def ordered_lines(rows: Column, field: str, separator: str) -> Column:
    """Join one field of an ordered array of structs, leaving out nulls."""
    return F.array_join(F.transform(rows, lambda r: r[field]), separator)


def top_rows(df: DataFrame, keys: list[str], order_by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark keeps only k rows per key in each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
