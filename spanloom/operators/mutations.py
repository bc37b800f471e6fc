"""Which paths lead to bad outcomes: one aggregation per signature, everything else from its result.

Totals and rows both come from ``path_outcomes``; jobs write it once and call the ``*_of`` functions on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.drift import mutation_explanation
from spanloom.options import DRIFT


def path_outcomes(correlated: DataFrame, bad_below: float = DRIFT.quality_bad_abs) -> DataFrame:
    """Counts and means per signature. Unscored traces count as bad."""
    bad = F.coalesce("quality_overall", F.lit(0.0)) < bad_below
    means = {
        "avg_quality": "quality_overall",
        "avg_hallucination": "quality_hallucination",
        "steps": "step_count",
        "calls": "llm_call_count",
        "avg_tool_calls": "tool_call_count",
        "avg_retry_count": "retry_count",
        "avg_gpu_contention": "gpu_contention_avg",
    }
    return correlated.groupBy(
        F.coalesce(F.nullif(F.col("trajectory_signature"), F.lit("")), F.lit("unknown")).alias("signature")
    ).agg(
        F.count("*").alias("count"),
        F.count_if(bad).alias("bad"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in means.items()],
        F.min_by(F.coalesce("step_sequence", F.lit("")), F.struct("start_ts_ms", "trace_id")).alias("step_sequence"),
    )


def outcome_totals(paths: DataFrame) -> DataFrame:
    """One row: totals, and the dominant healthy path (most traces among mostly good paths, else most traces)."""
    mostly_good = (F.col("count") - F.col("bad")) * 2 > F.col("count")
    rank = F.struct(
        (~mostly_good).alias("unhealthy"), (-F.col("count")).alias("size"), "signature", "steps", "calls"
    )
    return paths.agg(F.sum("count").alias("total"), F.sum("bad").alias("bad"), F.min(rank).alias("dominant"))


def mutations(correlated: DataFrame, bad_below: float = DRIFT.quality_bad_abs) -> DataFrame:
    return mutations_of(path_outcomes(correlated, bad_below))


def mutations_of(paths: DataFrame) -> DataFrame:
    """Per path: bad rate, lift over the global bad rate, structural difference from the dominant path."""
    totals = outcome_totals(paths).select(F.struct("total", "bad", "dominant").alias("t")).scalar()
    t = F.col("_t")
    bad_rate = F.col("bad") / F.col("count")
    global_rate = t["bad"] / t["total"]
    steps_delta = F.round(F.col("steps") - t["dominant"]["steps"], 2)
    calls_delta = F.round(F.col("calls") - t["dominant"]["calls"], 2)
    ranked = (
        paths.withColumn("_t", totals)
        .select(
            "signature",
            (F.col("signature") == t["dominant"]["signature"]).cast("int").alias("is_dominant"),
            "count",
            F.round(F.col("count") / t["total"], 4).alias("share"),
            F.round(bad_rate, 4).alias("bad_rate"),
            F.coalesce(F.round(F.try_divide(bad_rate, global_rate), 3), F.lit(0.0)).alias("lift"),
            F.round("avg_quality", 3).alias("avg_quality"),
            F.round("avg_hallucination", 3).alias("avg_hallucination"),
            F.round("steps", 2).alias("avg_step_count"),
            F.round("calls", 2).alias("avg_llm_calls"),
            F.round("avg_tool_calls", 2).alias("avg_tool_calls"),
            F.round("avg_retry_count", 2).alias("avg_retry_count"),
            F.round("avg_gpu_contention", 4).alias("avg_gpu_contention"),
            steps_delta.alias("step_delta_vs_dominant"),
            calls_delta.alias("llm_delta_vs_dominant"),
            "step_sequence",
        )
        .withColumn("is_harmful", (F.col("lift") > 1.0).cast("int"))
        .withColumn(
            "why",
            mutation_explanation(
                F.col("step_delta_vs_dominant"), F.col("llm_delta_vs_dominant"), F.col("avg_retry_count")
            ),
        )
    )
    return ranked.orderBy(F.desc("bad_rate"), F.desc("count"), "signature")


def mutation_summary(correlated: DataFrame, bad_below: float = DRIFT.quality_bad_abs) -> DataFrame:
    return mutation_summary_of(path_outcomes(correlated, bad_below))


def mutation_summary_of(paths: DataFrame) -> DataFrame:
    """One row: total traces, global bad rate, dominant signature, number of harmful paths."""
    totals = outcome_totals(paths).select(F.struct("total", "bad", "dominant").alias("t")).scalar()
    t = F.col("_t")
    lift = F.round(F.try_divide(F.col("bad") / F.col("count"), t["bad"] / t["total"]), 3)
    return (
        paths.withColumn("_t", totals)
        .groupBy("_t")
        .agg(F.count_if(lift > 1.0).alias("harmful_count"))
        .select(
            t["total"].alias("total_traces"),
            F.round(t["bad"] / t["total"], 4).alias("global_bad_rate"),
            t["dominant"]["signature"].alias("dominant_signature"),
            "harmful_count",
        )
    )


def worst_mutation(ranked: DataFrame) -> DataFrame:
    """The worst harmful path that is not the dominant one."""
    return (
        ranked.where((F.col("is_harmful") == 1) & (F.col("is_dominant") == 0))
        .orderBy(F.desc("bad_rate"), F.desc("count"), "signature")
        .limit(1)
    )
