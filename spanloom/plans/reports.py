"""Report queries over the tables. Each takes DataFrames and gives one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.infra import health_badge
from spanloom.functions.judge import DIMENSIONS
from spanloom.operators.infra import downsample
from spanloom.options import DRIFT

QUALITY_DIMENSIONS = (*DIMENSIONS, "overall")
HIGH_CONTENTION = 0.7


def _only(df: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters; an empty value means no filter."""
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def _between(df: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """Time bounds; 0 or None means no bound."""
    if start_ms:
        df = df.where(F.col("timestamp_ms") >= start_ms)
    if end_ms:
        df = df.where(F.col("timestamp_ms") <= end_ms)
    return df


def trajectory_detail(steps: DataFrame, trajectories: DataFrame, trace_id: str) -> DataFrame:
    """The steps of one trace in order, with its path's signature."""
    path = trajectories.where(F.col("trace_id") == trace_id).select("trace_id", "trajectory_signature", "step_count")
    return (
        steps.where(F.col("trace_id") == trace_id)
        .join(path, "trace_id", "left")
        .orderBy(F.coalesce("start_ts_ms", F.lit(0)), "span_id")
    )


def quality_series(quality: DataFrame) -> DataFrame:
    return quality.orderBy(F.coalesce("start_ts_ms", F.lit(0)), "trace_id")


def quality_detail(quality: DataFrame, trace_id: str) -> DataFrame:
    return quality.where(F.col("trace_id") == trace_id)


def quality_summary(quality: DataFrame) -> DataFrame:
    """Mean, lowest and highest score per dimension, from one aggregation."""
    zero = F.lit(0.0)
    stats = quality.agg(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.round(F.coalesce(F.avg(d), zero), 3).alias("avg"),
                F.coalesce(F.min(d), zero).alias("min"),
                F.coalesce(F.max(d), zero).alias("max"),
            ).alias(d)
            for d in QUALITY_DIMENSIONS
        ]
    )
    return stats.select(F.inline(F.array(*QUALITY_DIMENSIONS)))


def gpu_series(
    gpu: DataFrame,
    start_ms: int | None = None,
    end_ms: int | None = None,
    node_id: str | None = None,
    gpu_id: str | None = None,
    every: int = 1,
    per: list[str] | None = None,
) -> DataFrame:
    kept = _only(_between(gpu, start_ms, end_ms), node_id=node_id, gpu_id=gpu_id)
    order = ["timestamp_ms", "node_id", "gpu_id"]
    return downsample(kept, every, order, per).orderBy(*order)


def gpu_summary(series: DataFrame) -> DataFrame:
    c = F.col("contention_index")
    return series.agg(
        F.count("*").alias("total_samples"),
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("avg_contention"),
        F.coalesce(F.max(c), F.lit(0.0)).alias("max_contention"),
        F.round(F.coalesce(F.try_divide(F.count_if(c > HIGH_CONTENTION), F.count("*")), F.lit(0.0)) * 100, 1).alias(
            "high_contention_pct"
        ),
    )


def network_series(
    network: DataFrame,
    start_ms: int | None = None,
    end_ms: int | None = None,
    node_id: str | None = None,
    every: int = 1,
    per: list[str] | None = None,
) -> DataFrame:
    kept = _only(_between(network, start_ms, end_ms), node_id=node_id)
    order = ["timestamp_ms", "node_id"]
    return downsample(kept, every, order, per).orderBy(*order)


def correlated_traces(correlated: DataFrame) -> DataFrame:
    return correlated.orderBy(F.coalesce("start_ts_ms", F.lit(0)), "trace_id")


def windows(analytics_windows: DataFrame, window_size: str | None = None) -> DataFrame:
    return _only(analytics_windows, window_size=window_size).orderBy("window_start_ms", "window_size")


def alerts(analytics_windows: DataFrame) -> DataFrame:
    return analytics_windows.where(F.col("correlation_flag") != "normal").orderBy("window_start_ms", "window_size")


def alert_counts(analytics_windows: DataFrame) -> DataFrame:
    return (
        analytics_windows.where(F.col("correlation_flag") != "normal")
        .groupBy("correlation_flag")
        .agg(F.count("*").alias("alerts"))
    )


def first_alerts(analytics_windows: DataFrame, limit: int = 5) -> DataFrame:
    """The first alerts (a top-k report)."""
    return alerts(analytics_windows).limit(limit)


MICROSTRUCTURE = (
    "trace_id",
    "session_id",
    "step_count",
    "llm_call_count",
    "tool_call_count",
    "retrieve_count",
    "agent_count",
    "retry_count",
    "error_count",
    "total_duration_ms",
    "trajectory_signature",
)


def microstructure(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(*MICROSTRUCTURE)


def routing_distribution(routing: DataFrame) -> DataFrame:
    """Requests per pod, per node and in total, in one aggregation."""
    return (
        routing.groupingSets([["vllm_pod_id"], ["node_id"], []], "vllm_pod_id", "node_id")
        .agg(F.count("*").alias("requests"), F.grouping_id().alias("_g"))
        .select(
            F.when(F.col("_g") == 1, "pod").when(F.col("_g") == 2, "node").otherwise("total").alias("by"),
            F.coalesce(F.when(F.col("_g") == 1, F.col("vllm_pod_id")).when(F.col("_g") == 2, F.col("node_id")), F.lit(""))
            .alias("id"),
            "requests",
        )
    )


def dashboard_numbers(correlated: DataFrame) -> DataFrame:
    """Headline numbers and the health badge."""
    contention = F.coalesce(F.avg(F.coalesce("gpu_contention_avg", F.lit(0.0))), F.lit(0.0))
    return correlated.agg(
        F.count("*").alias("traces"),
        F.count_distinct("trajectory_signature").alias("templates"),
        F.round(F.coalesce(F.avg(F.coalesce("quality_overall", F.lit(0.0))), F.lit(0.0)), 2).alias("avg_quality"),
        F.round(contention, 3).alias("avg_contention"),
        health_badge(contention).alias("badge"),
    )


def highest_contention(correlated: DataFrame, limit: int = 3) -> DataFrame:
    """The traces under the highest contention (a top-k report)."""
    return (
        correlated.select("trace_id", "quality_overall", "gpu_contention_avg", "step_count")
        .orderBy(F.desc("gpu_contention_avg"), "trace_id")
        .limit(limit)
    )


SUMMARY_PROMPT = (
    "You review a fleet of agents. From the numbers below, say in three to five short sentences how good the answers are, "
    "whether paths are stable, whether contention harms quality, and what to do.\n\n%s\n\nSummary:"
)


def template_text(templates: DataFrame) -> Column:
    """All templates as a JSON object in order of frequency.

    One text in one row, some twenty characters per template: it grows with the number of paths. ``templates`` itself has
    the same numbers as rows.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "signature")))
    entries = F.transform(ranked, lambda t: F.format_string('"%s": %d', t["signature"], -t["rank"]))
    text = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    return templates.agg(text.alias("text")).scalar()


def _alert_text(analytics_windows: DataFrame) -> Column:
    """The kinds among the first five alerts as a JSON object, each with the details of its last one."""
    first = first_alerts(analytics_windows)
    order = F.struct("window_start_ms", "window_size", F.col("correlation_flag").alias("flag"), F.col("correlation_details").alias("d"))
    listed = F.array_sort(F.collect_list(order))
    kinds = F.array_distinct(F.transform(listed, lambda a: a["flag"]))
    entry = F.transform(
        kinds,
        lambda kind: F.format_string('"%s": "%s"', kind, F.element_at(F.filter(listed, lambda a: a["flag"] == kind), -1)["d"]),
    )
    return first.agg(F.concat(F.lit("{"), F.array_join(entry, ", "), F.lit("}")).alias("text")).scalar()


def _contention_text(correlated: DataFrame) -> Column:
    top = highest_contention(correlated)
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("gpu_contention_avg")).alias("rank"), "trace_id", "quality_overall", "step_count"))
    )
    lines = F.transform(
        ranked,
        lambda r: F.format_string(
            "\n  - trace %s: quality=%.1f, gpu_contention=%.3f, steps=%d",
            F.substring(r["trace_id"], 1, 12), r["quality_overall"], -r["rank"], r["step_count"],
        ),
    )
    return top.agg(F.array_join(lines, "").alias("text")).scalar()


def fleet_summary(
    correlated: DataFrame,
    analytics_windows: DataFrame,
    templates: DataFrame,
    model: Callable[[Column], Column] | None = None,
    listed: Column | None = None,
) -> DataFrame:
    """One row of fleet numbers with a context text, the prompt for a language model, and its answer as the summary.

    ``templates`` is ``trajectory.template_counts``. ``model`` gives the answer to a prompt column (a pandas UDF, say);
    without one, or where it gives null, the summary is a fixed sentence. ``listed`` is the text about the templates that
    the model shall read: ``template_text(templates)`` for all of them, which must fit one row and the model; without it
    the context has their number only, and its size does not grow with the fleet.
    """

    def mean(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    alert_count = analytics_windows.agg(F.count_if(F.col("correlation_flag") != "normal").alias("n")).scalar()
    stats = correlated.agg(
        F.count("*").alias("total_traces"),
        mean("quality_overall").alias("q"),
        mean("gpu_contention_avg").alias("c"),
        mean("quality_hallucination").alias("h"),
    ).select(
        "*",
        templates.agg(F.count("*").alias("n")).scalar().alias("unique_templates"),
        alert_count.alias("alert_count"),
        _alert_text(analytics_windows).alias("alert_types"),
        _contention_text(correlated).alias("busiest"),
    )
    per_template = F.lit("") if listed is None else F.concat(F.lit("Traces per template: "), listed, F.lit("\n"))
    q, c, h = F.col("q"), F.col("c"), F.col("h")
    context = F.format_string(
        "Traces analyzed: %d\nAverage quality: %.2f/5\nAverage hallucination score: %.2f/5\n"
        "Average GPU contention: %.3f\nUnique trajectory templates: %d\n%sCorrelation alerts: %d\n"
        "Kinds of alerts: %s\nTraces under the highest GPU contention:%s",
        "total_traces", q, h, c, "unique_templates", per_template, "alert_count", "alert_types", "busiest",
    )
    prompt = F.format_string(SUMMARY_PROMPT, "context")
    sentence = F.format_string(
        "Analytics summary (auto-generated): %d traces analyzed. Avg quality: %.2f/5. "
        "Avg GPU contention: %.3f. %d correlation alerts detected.",
        "total_traces", q, c, "alert_count",
    )
    answered = stats.withColumn("context", context).withColumn("prompt", prompt)
    return answered.select(
        "total_traces",
        F.round(q, 3).alias("avg_quality"),
        F.round(c, 4).alias("avg_contention"),
        F.round(h, 3).alias("avg_hallucination"),
        "unique_templates",
        "alert_count",
        "context",
        "prompt",
        (F.coalesce(model(F.col("prompt")), sentence) if model else sentence).alias("summary"),
    )


def drift_story(analytics_windows: DataFrame) -> DataFrame:
    """Per window size: seconds since the first window, drift mark, first and last shape, and the drift peak.

    Window tables are small: one row per time bucket, so a window function per size is bounded by the time covered.
    """
    by_size = Window.partitionBy("window_size")
    in_order = by_size.orderBy("window_start_ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jsd = F.col("trajectory_drift_jsd")
    first_start = F.min("window_start_ms").over(by_size)
    return analytics_windows.select(
        "window_size",
        "window_start_ms",
        F.call_function("div", F.col("window_start_ms") - first_start, F.lit(1000).cast("bigint")).alias("relative_s"),
        "trace_count",
        "unique_signatures",
        "dominant_share",
        "trajectory_entropy",
        "trajectory_drift_jsd",
        F.when(F.col("is_baseline") == 1, "baseline").when(jsd >= DRIFT.drift_jsd, "DRIFT").otherwise("").alias("mark"),
        F.first("dominant_share").over(in_order).alias("first_share"),
        F.last("dominant_share").over(in_order).alias("last_share"),
        F.first("trajectory_entropy").over(in_order).alias("first_entropy"),
        F.last("trajectory_entropy").over(in_order).alias("last_entropy"),
        F.max(jsd).over(by_size).alias("peak_jsd"),
    )


def cooccurrence_story(analytics_windows: DataFrame) -> DataFrame:
    """Per window size: windows where all three signals fired, and the window of the strongest negative correlation."""
    strongest = F.min(
        F.struct("contention_quality_corr", "window_start_ms", "gpu_contention_avg")
    )
    return (
        analytics_windows.groupBy("window_size")
        .agg(
            F.count_if(F.col("correlation_flag") == "gpu_induced_degradation").alias("gpu_induced_windows"),
            strongest.alias("s"),
        )
        .select(
            "window_size",
            "gpu_induced_windows",
            F.col("s.window_start_ms").alias("strongest_window_start_ms"),
            F.col("s.contention_quality_corr").alias("strongest_corr"),
            F.col("s.gpu_contention_avg").alias("gpu_contention_avg"),
        )
    )
