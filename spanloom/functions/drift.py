"""Column functions behind the drift verdict and the mutation report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.options import DRIFT, DriftOptions

SIGNATURE_PREFIX = "tpl_"
SIGNATURE_DIGITS = 12


def signature(path: Column) -> Column:
    return F.concat(F.lit(SIGNATURE_PREFIX), F.substring(F.sha2(path, 256), 1, SIGNATURE_DIGITS))


def window_flags(
    quality_avg: Column,
    quality_delta: Column,
    jsd: Column,
    gpu_avg: Column,
    latency_avg: Column,
    drops: Column,
    options: DriftOptions = DRIFT,
) -> dict[str, Column]:
    """The four signals of a window as 0/1."""
    below_floor = (quality_avg > 0) & (quality_avg < options.quality_bad_abs)
    return {
        "quality_drop": ((quality_delta <= -options.quality_drop_delta) | below_floor).cast("int"),
        "trajectory_drift": (jsd >= options.drift_jsd).cast("int"),
        "gpu_pressure": (gpu_avg >= options.gpu_pressure).cast("int"),
        "network_pressure": ((drops > 0) | (latency_avg >= options.net_latency_us)).cast("int"),
    }


def verdict(quality_drop: Column, trajectory_drift: Column, gpu_pressure: Column, network_pressure: Column) -> Column:
    """Which layer, if any, a window's degradation is put down to."""
    worse, moved = quality_drop == 1, trajectory_drift == 1
    return (
        F.when(worse & moved & (gpu_pressure == 1), F.lit("gpu_induced_degradation"))
        .when(worse & moved & (network_pressure == 1), F.lit("network_induced_degradation"))
        .when(worse & moved, F.lit("app_layer_degradation"))
        .when(moved, F.lit("trajectory_drift_no_quality_impact"))
        .when(worse, F.lit("quality_drop_stable_trajectory"))
        .otherwise(F.lit("normal"))
    )


def verdict_details(
    quality_avg: Column,
    quality_delta: Column,
    hallucination_avg: Column,
    jsd: Column,
    entropy: Column,
    gpu_avg: Column,
    correlation: Column,
    n: Column,
) -> Column:
    return F.format_string(
        "q_avg=%.2f (delta %+.2f), halluc=%.2f, drift_jsd=%.3f, entropy=%.2f, "
        "gpu_contention=%.3f, corr(gpu,q)=%+.2f, n=%d",
        quality_avg,
        quality_delta,
        hallucination_avg,
        jsd,
        entropy,
        gpu_avg,
        correlation,
        n,
    )


def mutation_explanation(step_delta: Column, call_delta: Column, retries: Column) -> Column:
    """Why a path fails, in words; empty when nothing stands out."""
    return F.concat_ws(
        ", ",
        F.when(step_delta < 0, F.format_string("%.0f fewer steps (truncated reasoning)", F.abs(step_delta))),
        F.when(call_delta < 0, F.format_string("%.0f fewer LLM calls", F.abs(call_delta))),
        F.when(retries > 0.5, F.format_string("%.1f avg retries (fallback churn)", retries)),
    )
