"""Correlated traces -> drift and verdict per time window."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import drift as d
from spanloom.functions.timeparts import floor_div
from spanloom.options import DRIFT, DriftOptions

# Sums and extremes carried from traces up to windows; every one of them folds again by itself.
_SUMS = ("n", "q_n", "q_sum", "h_n", "h_sum", "c_n", "c_sum", "l_n", "l_sum", "drops", "x_sum", "y_sum", "xx", "yy", "xy")
_MINS = ("x_min", "y_min")
_MAXES = ("x_max", "y_max", "c_max")


def _fold_all() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.min(c).alias(c) for c in _MINS],
        *[F.max(c).alias(c) for c in _MAXES],
    ]


def contribution(options: DriftOptions = DRIFT) -> list[Column]:
    """What a correlated trace adds to the slice (finest bucket) and signature it counts in; without a start the slice is null."""
    finest = reduce(gcd, (ms for _, ms in options.window_sizes))
    started = F.nullif(F.col("start_ts_ms"), F.lit(0).cast("bigint"))
    return [
        (floor_div(started, finest) * finest).alias("slice_ms"),
        F.coalesce("trajectory_signature", F.lit("")).alias("signature"),
        F.col("quality_overall").alias("q"),
        F.col("quality_hallucination").alias("h"),
        F.col("gpu_contention_avg").alias("c"),
        F.col("inter_node_latency_avg").alias("l"),
        F.coalesce("packet_drop_total", F.lit(0)).cast("bigint").alias("d"),
    ]


def sliced(rows: DataFrame) -> DataFrame:
    """Measures per (slice, signature) of contributions, combined before they shuffle."""
    zero = F.lit(0.0)
    rows = rows.withColumns({"x": F.coalesce("c", zero), "y": F.coalesce("q", zero)})
    x, y = F.col("x"), F.col("y")
    return rows.groupBy("slice_ms", "signature").agg(
        F.count("*").alias("n"),
        *[e for k in "qhcl" for e in (F.count(k).alias(f"{k}_n"), F.sum(k).alias(f"{k}_sum"))],
        F.sum("d").alias("drops"),
        F.sum(x).alias("x_sum"),
        F.sum(y).alias("y_sum"),
        F.sum(x * x).alias("xx"),
        F.sum(y * y).alias("yy"),
        F.sum(x * y).alias("xy"),
        F.min(x).alias("x_min"),
        F.min(y).alias("y_min"),
        F.max(x).alias("x_max"),
        F.max(y).alias("y_max"),
        F.max("c").alias("c_max"),
    )


def added(slices: DataFrame) -> DataFrame:
    """Measures of the same (slice, signature) from several tables, folded into one row."""
    return slices.groupBy("slice_ms", "signature").agg(*_fold_all())


def signature_slices(correlated: DataFrame, options: DriftOptions = DRIFT) -> DataFrame:
    """Measures per (finest bucket, signature): one pass over the traces."""
    return sliced(correlated.where(F.coalesce("start_ts_ms", F.lit(0)) != 0).select(*contribution(options)))


def sized_distribution(slices: DataFrame, options: DriftOptions = DRIFT) -> DataFrame:
    """Measures per (window size, window, signature), every size from the finest buckets."""
    sizes = F.array(
        *[F.struct(F.lit(label).alias("label"), F.lit(ms).cast("bigint").alias("ms")) for label, ms in options.window_sizes]
    )
    sized = slices.withColumn("_size", F.explode(sizes))
    start = F.col("slice_ms") - F.pmod(F.col("slice_ms"), F.col("_size.ms"))
    return sized.groupBy(
        F.col("_size.label").alias("window_size"),
        F.col("_size.ms").alias("size_ms"),
        start.alias("window_start_ms"),
        "signature",
    ).agg(*_fold_all())


def signature_windows(correlated: DataFrame, options: DriftOptions = DRIFT) -> DataFrame:
    """The table everything about windows derives from. It is used several times over, so jobs write it once."""
    return sized_distribution(signature_slices(correlated, options), options)


WINDOW = ["window_size", "window_start_ms"]


def _pearson() -> Column:
    """Correlation from sums; 0 when undefined. A constant side is known from equal extremes, not from rounding."""
    n = F.col("n")
    covariance = F.col("xy") - F.col("x_sum") * F.col("y_sum") / n
    spread = (F.col("xx") - F.col("x_sum") * F.col("x_sum") / n) * (F.col("yy") - F.col("y_sum") * F.col("y_sum") / n)
    undefined = (n < 3) | (F.col("x_min") == F.col("x_max")) | (F.col("y_min") == F.col("y_max"))
    value = F.try_divide(covariance, F.sqrt(F.greatest(spread, F.lit(0.0))))
    return F.round(F.when(undefined, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0))), 4)


def _avg(name: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")), F.lit(0.0))


def window_measures(distribution: DataFrame) -> DataFrame:
    """Per window: totals of its signatures. Empty signatures count as traces, not in the distribution.

    Entropy (bits) comes from counts alone: H = log2 N - sum(n log2 n) / N.
    """
    known = F.col("signature") != ""
    n = F.when(known, F.col("n").cast("double"))
    entropy = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    return distribution.groupBy(*WINDOW, "size_ms").agg(
        *_fold_all(),
        F.sum(F.when(known, F.col("n"))).alias("known_n"),
        F.count_if(known).cast("int").alias("unique_signatures"),
        F.coalesce(F.round(entropy, 4), F.lit(0.0)).alias("entropy"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("rank"), F.col("signature").alias("signature")))).alias("top"),
    )


def baselines(measures: DataFrame) -> DataFrame:
    """The earliest window of each size: one row per window size."""
    return measures.groupBy("window_size").agg(
        F.min("window_start_ms").alias("baseline_start_ms"),
        F.min_by(F.struct(_avg("q").alias("q"), F.coalesce("known_n", F.lit(0)).alias("known_n")), "window_start_ms").alias(
            "base"
        ),
    )


def jensen_shannon(distribution: DataFrame, measures: DataFrame, bases: DataFrame) -> DataFrame:
    """Divergence (log2, 0..1) of each window's signatures from those of the baseline window.

    A baseline signature a window lacks adds half its share, so only the signatures a window has need to be matched.
    """
    known = distribution.where(F.col("signature") != "").select(*WINDOW, "signature", "n")
    totals = measures.select(*WINDOW, F.coalesce("known_n", F.lit(0)).alias("known_n"))
    starts = bases.select("window_size", "baseline_start_ms", F.col("base.known_n").alias("base_n"))
    # One row per window size: bounded by the options, safe to broadcast.
    sized = known.join(F.broadcast(starts), "window_size")
    base = sized.where(F.col("window_start_ms") == F.col("baseline_start_ms")).select(
        "window_size", "signature", (F.col("n") / F.col("base_n")).alias("q")
    )
    p, q = F.col("p"), F.coalesce("q", F.lit(0.0))
    m = (p + q) * 0.5
    term = F.lit(0.5) * p * F.log2(p / m) + F.when(q > 0, F.lit(0.5) * q * F.log2(q / m)).otherwise(F.lit(0.0))
    per_window = (
        known.join(totals, WINDOW)
        .withColumn("p", F.col("n") / F.col("known_n"))
        .join(base, ["window_size", "signature"], "left")
        .groupBy(*WINDOW)
        .agg(F.sum(term).alias("matched"), F.sum(q).alias("base_matched"))
    )
    both = F.col("matched") + F.lit(0.5) * F.greatest(F.lit(1.0) - F.col("base_matched"), F.lit(0.0))
    value = (
        F.when((F.col("known_n") == 0) & (F.col("base_n") == 0), F.lit(0.0))
        .when((F.col("known_n") == 0) | (F.col("base_n") == 0), F.lit(0.5))
        .otherwise(F.least(F.greatest(both, F.lit(0.0)), F.lit(1.0)))
    )
    return (
        totals.join(F.broadcast(starts), "window_size")
        .join(per_window, WINDOW, "left")
        .select(
            *WINDOW,
            F.when(F.col("window_start_ms") == F.col("baseline_start_ms"), F.lit(0.0))
            .otherwise(F.round(value, 4))
            .alias("jsd"),
        )
    )


def drift_windows(correlated: DataFrame, options: DriftOptions = DRIFT) -> DataFrame:
    """All window sizes in one plan, for small tables; jobs put a written ``signature_windows`` in between."""
    return drift_of(signature_windows(correlated, options), options)


def drift_of(distribution: DataFrame, options: DriftOptions = DRIFT) -> DataFrame:
    """Per window of ``signature_windows``: drift from the baseline window, signals and verdict (25 columns)."""
    measures = window_measures(distribution)
    bases = baselines(measures)
    wide = (
        measures.join(F.broadcast(bases), "window_size")
        .join(jensen_shannon(distribution, measures, bases), WINDOW)
        .select(
            *WINDOW,
            (F.col("window_start_ms") + F.col("size_ms")).alias("window_end_ms"),
            F.col("n").cast("int").alias("trace_count"),
            F.coalesce("top.signature", F.lit("")).alias("dominant_signature"),
            F.round(F.coalesce(-F.col("top.rank") / F.col("known_n"), F.lit(0.0)), 4).alias("dominant_share"),
            "unique_signatures",
            F.col("entropy").alias("trajectory_entropy"),
            F.col("jsd").alias("trajectory_drift_jsd"),
            (F.col("window_start_ms") == F.col("baseline_start_ms")).cast("int").alias("is_baseline"),
            _avg("q").alias("q"),
            _avg("h").alias("h"),
            F.col("base.q").alias("base_q"),
            F.round(_avg("q") - F.col("base.q"), 4).alias("quality_delta"),
            F.round(_avg("c"), 4).alias("gpu_contention_avg"),
            F.round(F.coalesce("c_max", F.lit(0.0)), 4).alias("gpu_contention_max"),
            F.round(_avg("l"), 2).alias("net_latency_avg"),
            F.col("drops").alias("packet_drop_total"),
            _pearson().alias("contention_quality_corr"),
        )
    )
    flags = d.window_flags(
        F.col("q"),
        F.col("quality_delta"),
        F.col("trajectory_drift_jsd"),
        F.col("gpu_contention_avg"),
        F.col("net_latency_avg"),
        F.col("packet_drop_total"),
        options,
    )
    flagged = wide.withColumns(flags)
    return flagged.select(
        *WINDOW,
        "window_end_ms",
        "trace_count",
        "dominant_signature",
        "dominant_share",
        "unique_signatures",
        "trajectory_entropy",
        "trajectory_drift_jsd",
        "is_baseline",
        F.round("q", 4).alias("quality_overall_avg"),
        F.round("h", 4).alias("quality_hallucination_avg"),
        F.round("base_q", 4).alias("quality_overall_baseline"),
        "quality_delta",
        "gpu_contention_avg",
        "gpu_contention_max",
        "net_latency_avg",
        "packet_drop_total",
        *flags,
        "contention_quality_corr",
        d.verdict(*[F.col(f) for f in flags]).alias("correlation_flag"),
        d.verdict_details(
            F.col("q"),
            F.col("quality_delta"),
            F.col("h"),
            F.col("trajectory_drift_jsd"),
            F.col("trajectory_entropy"),
            F.col("gpu_contention_avg"),
            F.col("contention_quality_corr"),
            F.col("trace_count"),
        ).alias("correlation_details"),
    )
