"""Agent steps -> one trajectory per trace: its ordered path, signature, counts and extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.drift import signature
from spanloom.functions.timeparts import ingestion_date, ingestion_hour, now_ms
from spanloom.operators.ordered import ordered_lines, step_slice
from spanloom.options import STEPS, StepOptions


def _extent(which: str) -> Column:
    """Earliest start or latest end, leaving out zero and null."""
    fold = F.min if which == "start_ts_ms" else F.max
    return fold(F.nullif(F.col(which), F.lit(0).cast("bigint")))


def step_order() -> Column:
    return F.struct(
        F.coalesce(F.col("start_ts_ms"), F.lit(0).cast("bigint")).alias("ts"),
        F.coalesce(F.col("span_id"), F.lit("")).alias("span_id"),
    )


def trajectories(steps: DataFrame, ingested_ms: Column | None = None, options: StepOptions = STEPS) -> DataFrame:
    """Two aggregations: steps into path pieces per (trace, time slice), pieces into the path of the trace.

    A trace with very many steps is ordered slice by slice in different tasks; the last one only joins finished text.
    A normal trace has one or two slices, so the second shuffle moves about one row per trace.
    """
    ingested_ms = now_ms() if ingested_ms is None else ingested_ms
    order = step_order()
    step = F.struct(
        order.alias("at"),
        F.col("span_kind").alias("kind"),
        F.concat(F.col("span_kind"), F.lit(":"), F.coalesce(F.col("sub_span_kind"), F.lit(""))).alias("detail"),
    )
    kind = F.col("span_kind")
    counts = {
        "llm_call_count": "REASON",
        "tool_call_count": "TOOL",
        "retrieve_count": "RETRIEVE",
        "agent_count": "AGENT",
    }
    pieces = (
        steps.groupBy("trace_id", step_slice(F.col("start_ts_ms"), F.col("span_id"), options.path_slice_ms).alias("at"))
        .agg(
            F.array_sort(F.collect_list(step)).alias("steps"),
            F.count("*").alias("step_count"),
            *[F.count_if(kind == k).alias(name) for name, k in counts.items()],
            _extent("start_ts_ms").alias("start_ts_ms"),
            _extent("end_ts_ms").alias("end_ts_ms"),
            F.min(F.struct(order.alias("at"), F.coalesce(F.col("session_id"), F.lit("")).alias("session_id"))).alias(
                "first"
            ),
        )
        .select(
            "trace_id",
            F.struct(
                "at",
                ordered_lines(F.col("steps"), "kind", "|").alias("path"),
                ordered_lines(F.col("steps"), "detail", "|").alias("detailed"),
            ).alias("piece"),
            "step_count",
            *counts,
            "start_ts_ms",
            "end_ts_ms",
            "first",
        )
    )
    traces = pieces.groupBy("trace_id").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.sum("step_count").cast("int").alias("step_count"),
        *[F.sum(name).cast("int").alias(name) for name in counts],
        F.coalesce(F.min("start_ts_ms"), F.lit(0)).alias("start_ts_ms"),
        F.coalesce(F.max("end_ts_ms"), F.lit(0)).alias("end_ts_ms"),
        F.min("first").alias("first"),
    )
    paths = traces.withColumn("step_sequence", ordered_lines(F.col("pieces"), "path", "|")).withColumn(
        "step_sequence_detailed", ordered_lines(F.col("pieces"), "detailed", "|")
    )
    return paths.select(
        "trace_id",
        F.col("first.session_id").alias("session_id"),
        signature(F.col("step_sequence")).alias("trajectory_signature"),
        "step_sequence",
        "step_sequence_detailed",
        "step_count",
        *counts,
        F.greatest(F.lit(0), F.col("llm_call_count") - F.col("agent_count") - 1).alias("retry_count"),
        F.lit(0).alias("error_count"),
        (F.col("end_ts_ms") - F.col("start_ts_ms")).cast("double").alias("total_duration_ms"),
        "start_ts_ms",
        "end_ts_ms",
        ingestion_date(ingested_ms).alias("ingestion_date"),
        ingestion_hour(ingested_ms).alias("ingestion_hour"),
    )


def span_errors(spans: DataFrame) -> DataFrame:
    """Error spans per trace, for callers that want a real error count."""
    return spans.groupBy("trace_id").agg(F.count_if(F.col("status_code") == "ERROR").cast("int").alias("error_count"))


def template_counts(trajectories: DataFrame) -> DataFrame:
    """Traces per signature with the columns of its earliest trace."""
    example = F.struct(
        "step_count",
        "llm_call_count",
        "tool_call_count",
        "retrieve_count",
        "step_sequence",
        "step_sequence_detailed",
    )
    return trajectories.groupBy(F.col("trajectory_signature").alias("signature")).agg(
        F.count("*").alias("count"),
        F.min_by(example, F.struct("start_ts_ms", "trace_id")).alias("example"),
    )


def template_distribution(trajectories: DataFrame) -> DataFrame:
    return distribution_of(template_counts(trajectories))


def distribution_of(per_signature: DataFrame) -> DataFrame:
    """``template_counts`` with each signature's share, most frequent first."""
    total = per_signature.agg(F.sum("count").alias("n")).scalar()
    return per_signature.select(
        "signature", "count", F.round(F.col("count") / total, 4).alias("share"), "example.*"
    ).orderBy(F.desc("count"), "signature")
