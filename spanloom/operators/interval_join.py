"""Aggregate point samples over time intervals without emitting every (interval, sample) pair.

Samples are rolled up into tiles of growing width. An interval is covered by a few whole tiles, whose rollups are used
as they are, and at most two cut base tiles, where single samples are compared. An interval of any length meets a
number of rows that grows with the logarithm of its length, and tile ids spread a busy key over time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.timeparts import floor_div

RAW = -1
FANOUT = 16


@dataclass(frozen=True)
class Measure:
    """One aggregate over the matched samples: 'sum' or 'max' of a sample expression (SQL text)."""

    name: str
    how: str
    value: str


def count_of(name: str) -> Measure:
    return Measure(name, "sum", "1L")


def _fold(measure: Measure, column: Column) -> Column:
    return (F.sum(column) if measure.how == "sum" else F.max(column)).alias(measure.name)


def fold_samples(measures: list[Measure]) -> list[Column]:
    """The measures as aggregates over the samples themselves."""
    return [_fold(m, F.expr(m.value)) for m in measures]


def tiled_samples(
    samples: DataFrame, keys: list[str], ts: str, measures: list[Measure], tile_ms: int, levels: int
) -> DataFrame:
    """Samples by instant (level -1) together with their rollups per tile (levels 0 and up)."""
    instants = samples.groupBy(*keys, F.col(ts).alias("_ts")).agg(*fold_samples(measures))
    raw = instants.withColumn("_level", F.lit(RAW)).withColumn("_tile", floor_div(F.col("_ts"), tile_ms))
    marks = F.array(
        *[
            F.struct(F.lit(level).alias("level"), floor_div(F.col("_ts"), tile_ms * FANOUT**level).alias("tile"))
            for level in range(levels)
        ]
    )
    rollups = (
        instants.withColumn("_mark", F.explode(marks))
        .groupBy(*keys, F.col("_mark.level").alias("_level"), F.col("_mark.tile").alias("_tile"))
        .agg(*[_fold(m, F.col(m.name)) for m in measures])
        .withColumn("_ts", F.lit(None).cast("bigint"))
    )
    return raw.unionByName(rollups)


def _tiles(level: int, start: Column, end: Column) -> Column:
    """Tiles start..end-1 of one level as structs."""
    none = F.array().cast("array<struct<level:int,tile:bigint>>")
    return F.when(
        start < end,
        F.transform(
            F.sequence(start, end - 1), lambda t: F.struct(F.lit(level).alias("level"), t.cast("bigint").alias("tile"))
        ),
    ).otherwise(none)


def covered_intervals(intervals: DataFrame, lo: str, hi: str, tile_ms: int, levels: int) -> DataFrame:
    """One row per tile of each interval's cover: columns _level and _tile are added."""
    width = F.lit(tile_ms).cast("bigint")
    df = intervals.where(F.col(lo) <= F.col(hi)).select(
        "*",
        floor_div(F.col(lo) + width - 1, tile_ms).alias("_a0"),
        floor_div(F.col(hi) + 1, tile_ms).alias("_b0"),
    )
    first, last = floor_div(F.col(lo), tile_ms), floor_div(F.col(hi), tile_ms)
    cut = F.array_distinct(
        F.array_compact(F.array(F.when(first < F.col("_a0"), first), F.when(last >= F.col("_b0"), last)))
    )
    cover = [F.transform(cut, lambda t: F.struct(F.lit(RAW).alias("level"), t.cast("bigint").alias("tile")))]
    fan, zero = F.lit(FANOUT).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(levels):
        a, b = F.col(f"_a{level}"), F.col(f"_b{level}")
        if level == levels - 1:
            cover.append(_tiles(level, a, b))
            break
        up_a, up_b = F.col(f"_a{level + 1}"), F.col(f"_b{level + 1}")
        ceil, floor = floor_div(a + fan - 1, FANOUT), floor_div(b, FANOUT)
        climbs = (a < b) & (ceil < floor)
        df = df.select(
            "*",
            F.when(climbs, ceil).otherwise(zero).alias(f"_a{level + 1}"),
            F.when(climbs, floor).otherwise(zero).alias(f"_b{level + 1}"),
        )
        # Whole tiles of the next level take the middle; this level keeps what sticks out on both sides.
        cover.append(_tiles(level, a, F.when(up_a < up_b, up_a * fan).otherwise(b)))
        cover.append(_tiles(level, F.when(up_a < up_b, up_b * fan).otherwise(b), b))
    return df.select(*intervals.columns, F.explode(F.concat(*cover)).alias("_cover")).select(
        *intervals.columns, F.col("_cover.level").alias("_level"), F.col("_cover.tile").alias("_tile")
    )


def aggregate_over_intervals(
    intervals: DataFrame,
    samples: DataFrame,
    *,
    group_by: list[str],
    keys: list[str],
    lo: str,
    hi: str,
    ts: str,
    measures: list[Measure],
    tile_ms: int,
    levels: int = 1,
    sample_groups: list[str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Measures of the samples with equal ``keys`` and lo <= ts <= hi, per ``group_by`` (+ ``sample_groups``).

    A sample counts once for every interval it lies in. Groups without samples have no row, unless ``carry`` is given:
    then every group is kept, with null measures if need be, together with those columns of its intervals (they must
    depend on ``group_by`` alone).
    """
    sample_groups = sample_groups or []
    tiled = tiled_samples(samples, keys + sample_groups, ts, measures, tile_ms, levels)
    wanted = intervals.select(*dict.fromkeys(group_by + keys + [lo, hi] + (carry or [])))
    covered = covered_intervals(wanted, lo, hi, tile_ms, levels)
    on = keys + ["_level", "_tile"]
    renamed = tiled.select(*[F.col(c).alias(f"_s{c}") if c in on else F.col(c) for c in tiled.columns])
    match = (F.col("_level") > RAW) | F.col("_ts").between(F.col(lo), F.col(hi))
    for column in on:
        match = match & (F.col(column) == F.col(f"_s{column}"))
    return (
        covered.join(renamed, match, "inner" if carry is None else "left")
        .groupBy(*dict.fromkeys(group_by + sample_groups + (carry or [])))
        .agg(*[_fold(m, F.col(m.name)) for m in measures])
    )
