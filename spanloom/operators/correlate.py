"""Trajectories + quality + routing + metrics -> the wide per-trace fact table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.judge import DIMENSIONS
from spanloom.functions.timeparts import ingestion_date, ingestion_hour, now_ms
from spanloom.operators.interval_join import Measure, aggregate_over_intervals, count_of, fold_samples
from spanloom.operators.ordered import top_rows
from spanloom.options import CORRELATION, ROUTING, CorrelationOptions

QUALITY_COLUMNS = ("overall", *DIMENSIONS)

GPU_MEASURES = [
    count_of("gpu_n"),
    Measure("contention_sum", "sum", "contention_index"),
    Measure("contention_max", "max", "contention_index"),
    Measure("temperature_sum", "sum", "temperature_c"),
    Measure("temperature_max", "max", "temperature_c"),
    Measure("memory_sum", "sum", "memory_used_pct"),
    Measure("power_sum", "sum", "power_draw_pct"),
    Measure("throttled", "sum", "cast(throttle_active <> 0 as bigint)"),
]

# A latency of -1 stands for 'no peer' and is not measured.
NETWORK_MEASURES = [
    Measure("latency_n", "sum", "cast(coalesce(inter_node_latency_us > 0, false) as bigint)"),
    Measure("latency_sum", "sum", "case when inter_node_latency_us > 0 then inter_node_latency_us end"),
    Measure("latency_max", "max", "case when inter_node_latency_us > 0 then inter_node_latency_us end"),
    Measure("drops", "sum", "cast(coalesce(packet_drop_count, 0) as bigint)"),
    Measure("retransmits", "sum", "cast(coalesce(tcp_retransmit_count, 0) as bigint)"),
]


def _mean(total: str, n: str, digits: int) -> Column:
    return F.round(F.coalesce(F.try_divide(F.col(total), F.col(n)), F.lit(0.0)), digits)


def _peak(column: str, digits: int) -> Column:
    return F.round(F.coalesce(F.col(column), F.lit(0.0)), digits)


def in_time_range(metrics: DataFrame, trajectories: DataFrame, options: CorrelationOptions = CORRELATION) -> DataFrame:
    """Samples near any trace; with ingestion_date present the bound also prunes partitions."""
    start, end = F.col("start_ts_ms"), F.col("end_ts_ms")
    bounds = trajectories.agg(
        F.struct(
            (F.min(F.nullif(start, F.lit(0).cast("bigint"))) - options.tolerance_ms).alias("lo"),
            (F.max(F.nullif(end, F.lit(0).cast("bigint"))) + options.tolerance_ms).alias("hi"),
        ).alias("b")
    ).scalar()
    kept = metrics.where(F.col("timestamp_ms").between(bounds["lo"], bounds["hi"]))
    if "ingestion_date" in metrics.columns:
        kept = kept.where(F.col("ingestion_date").between(ingestion_date(bounds["lo"]), ingestion_date(bounds["hi"])))
    return kept


def timed_calls(trajectories: DataFrame, routing: DataFrame) -> DataFrame:
    """Routed calls of known traces; a call without a time takes the start of its trace."""
    starts = trajectories.groupBy("trace_id").agg(F.min("start_ts_ms").alias("_start"))
    return (
        routing.join(starts, "trace_id")
        .withColumn(
            "call_ts", F.coalesce(F.nullif(F.col("timestamp_ms"), F.lit(0).cast("bigint")), F.col("_start"))
        )
        .drop("_start")
    )


def call_intervals(calls: DataFrame, options: CorrelationOptions = CORRELATION) -> DataFrame:
    """Distinct (trace, node, gpu, instant) with the number of calls at it and the interval around it."""
    return (
        calls.groupBy("trace_id", "node_id", "gpu_id", "call_ts")
        .agg(F.count("*").alias("calls"))
        .withColumn("lo", F.col("call_ts") - options.tolerance_ms)
        .withColumn("hi", F.col("call_ts") + options.tolerance_ms)
    )


def _per_trace(
    intervals: DataFrame, samples: DataFrame, keys: list[str], measures: list[Measure], options: CorrelationOptions
) -> DataFrame:
    """Fold measures to traces. A sample counts once per matching call."""
    per_call = aggregate_over_intervals(
        intervals,
        samples,
        group_by=["trace_id", "calls"],
        keys=keys,
        lo="lo",
        hi="hi",
        ts="timestamp_ms",
        measures=measures,
        tile_ms=max(options.tolerance_ms, 1),
    )
    folded = [
        (F.sum(F.col(m.name) * F.col("calls")) if m.how == "sum" else F.max(m.name)).alias(m.name) for m in measures
    ]
    return per_call.groupBy("trace_id").agg(*folded)


def gpu_around_calls(intervals: DataFrame, gpu: DataFrame, options: CorrelationOptions = CORRELATION) -> DataFrame:
    return _per_trace(intervals, gpu, ["node_id", "gpu_id"], GPU_MEASURES, options)


def network_around_calls(intervals: DataFrame, network: DataFrame, options: CorrelationOptions = CORRELATION) -> DataFrame:
    return _per_trace(intervals, network, ["node_id"], NETWORK_MEASURES, options)


def primary_pods(calls: DataFrame) -> DataFrame:
    """The pod with most calls of each trace (ties: smallest id), with node and GPU of its first call; queue waits."""
    waited = F.nullif(F.col("queue_wait_ms"), F.lit(0.0))
    per_pod = calls.groupBy("trace_id", "vllm_pod_id").agg(
        F.count("*").alias("n"),
        F.min(F.struct("call_ts", "span_id", "node_id", "gpu_id")).alias("first"),
        F.count(waited).alias("waits"),
        F.sum(waited).alias("wait_sum"),
        F.max(waited).alias("wait_max"),
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), "vllm_pod_id", "first"))
    return (
        per_pod.groupBy("trace_id")
        .agg(
            best.alias("p"), F.sum("waits").alias("waits"), F.sum("wait_sum").alias("wait_sum"),
            F.max("wait_max").alias("wait_max"),
        )
        .select(
            "trace_id",
            F.col("p.vllm_pod_id").alias("primary_pod_id"),
            F.col("p.first.node_id").alias("primary_node_id"),
            F.col("p.first.gpu_id").alias("primary_gpu_id"),
            "waits",
            "wait_sum",
            "wait_max",
        )
    )


def _signals(gpu: int = 4, other: int = 2) -> list[Column]:
    return [
        _mean("contention_sum", "gpu_n", gpu).alias("gpu_contention_avg"),
        _peak("contention_max", gpu).alias("gpu_contention_max"),
        _mean("temperature_sum", "gpu_n", other).alias("gpu_temperature_avg"),
        _peak("temperature_max", other).alias("gpu_temperature_max"),
        _mean("memory_sum", "gpu_n", other).alias("gpu_memory_pressure_avg"),
        F.coalesce("throttled", F.lit(0)).cast("bigint").alias("gpu_throttle_count"),
        _mean("power_sum", "gpu_n", other).alias("gpu_power_avg"),
        _mean("latency_sum", "latency_n", other).alias("inter_node_latency_avg"),
        _peak("latency_max", other).alias("inter_node_latency_max"),
        F.coalesce("drops", F.lit(0)).cast("bigint").alias("packet_drop_total"),
        F.coalesce("retransmits", F.lit(0)).cast("bigint").alias("tcp_retransmit_total"),
    ]


def correlate(
    trajectories: DataFrame,
    quality: DataFrame,
    routing: DataFrame,
    gpu: DataFrame,
    network: DataFrame,
    ingested_ms: Column | None = None,
    options: CorrelationOptions = CORRELATION,
) -> DataFrame:
    """One row per trajectory with its scores and the GPU and network state around its model calls."""
    ingested_ms = now_ms() if ingested_ms is None else ingested_ms
    calls = timed_calls(trajectories, routing)
    intervals = call_intervals(calls, options)
    # Aggregated in separate branches, so the two interval joins do not multiply.
    gpu_side = gpu_around_calls(intervals, gpu, options)
    network_side = network_around_calls(intervals, network, options)
    newest = F.max_by(
        F.struct(*QUALITY_COLUMNS, "explanation"), F.struct("eval_timestamp_ms", "session_id")
    )
    scores = quality.groupBy("trace_id").agg(newest.alias("q")).select("trace_id", "q.*")
    wide = (
        trajectories.join(scores, "trace_id", "left")
        .join(primary_pods(calls), "trace_id", "left")
        .join(gpu_side, "trace_id", "left")
        .join(network_side, "trace_id", "left")
    )
    empty = F.lit("")
    return wide.select(
        "trace_id",
        F.coalesce("session_id", empty).alias("session_id"),
        "start_ts_ms",
        "end_ts_ms",
        "total_duration_ms",
        "trajectory_signature",
        "step_sequence",
        "step_count",
        "llm_call_count",
        "tool_call_count",
        "retrieve_count",
        "retry_count",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"quality_{c}") for c in QUALITY_COLUMNS],
        F.coalesce("explanation", empty).alias("quality_explanation"),
        *_signals(),
        _mean("wait_sum", "waits", 2).alias("queue_wait_avg"),
        _peak("wait_max", 2).alias("queue_wait_max"),
        F.coalesce("primary_pod_id", empty).alias("primary_pod_id"),
        F.coalesce("primary_node_id", empty).alias("primary_node_id"),
        F.coalesce("primary_gpu_id", empty).alias("primary_gpu_id"),
        ingestion_date(ingested_ms).alias("ingestion_date"),
        ingestion_hour(ingested_ms).alias("ingestion_hour"),
    )


# --- live variant: no routing, the busiest node within the trace's own time span stands for it ---


def live_traces(steps: DataFrame) -> DataFrame:
    kind = F.col("span_kind")
    first = F.min(F.struct(F.coalesce("start_ts_ms", F.lit(0).cast("bigint")), "span_id", "session_id"))
    zero = F.lit(0).cast("bigint")
    return (
        steps.groupBy("trace_id")
        .agg(
            first.alias("f"),
            F.min(F.coalesce("start_ts_ms", zero)).alias("start_ts_ms"),
            F.max(F.coalesce("end_ts_ms", zero)).alias("end_ts_ms"),
            F.count("*").cast("int").alias("step_count"),
            F.count_if(kind == "REASON").cast("int").alias("llm_call_count"),
            F.count_if(kind == "TOOL").cast("int").alias("tool_call_count"),
            F.count_if(kind == "RETRIEVE").cast("int").alias("retrieve_count"),
        )
        .withColumn("session_id", F.coalesce("f.session_id", F.lit("")))
        .drop("f")
    )


def uncorrelated(steps: DataFrame, correlated: DataFrame) -> DataFrame:
    """Steps of traces that have no correlated row yet."""
    return steps.join(correlated.select("trace_id").distinct(), "trace_id", "left_anti")


LIVE_LEVELS = 5


def correlate_live(
    steps: DataFrame,
    gpu: DataFrame,
    network: DataFrame,
    ingested_ms: Column | None = None,
    options: CorrelationOptions = CORRELATION,
    keep: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Correlate traces by time alone. Traces without a sample in reach take the latest samples instead.

    ``keep`` may write a named table and read it back. That cuts the plan, which is otherwise planned again as a whole, in the
    driver's memory, after each of its shuffles.
    """
    ingested_ms = now_ms() if ingested_ms is None else ingested_ms
    kept = keep or (lambda _, rows: rows)
    spans = live_traces(steps)
    traces = kept(
        "traces",
        spans.select(
            "*",
            (F.col("start_ts_ms") - options.live_margin_ms).alias("lo"),
            (F.col("end_ts_ms") + options.live_margin_ms).alias("hi"),
        ),
    )
    gpu = gpu.withColumn("node_id", F.coalesce(F.nullif(F.col("node_id"), F.lit("")), F.lit(ROUTING.default_node)))
    # Numbers only, so that the wide aggregation stays a hash aggregation; the GPU's name is looked up at the end.
    gpu_measures = [*GPU_MEASURES, Measure("first_age", "max", "-timestamp_ms")]
    trace = [c for c in traces.columns if c != "trace_id"]
    # Every trace meets every node, but a tile's nodes are dealt into groups, so that no task holds a tile of all of them.
    grouped = gpu.withColumn("_group", F.pmod(F.xxhash64("node_id"), F.lit(options.node_groups)))
    # Only groups that have a node, at most ``node_groups`` numbers.
    groups = grouped.agg(F.collect_set("_group").alias("g")).scalar()
    reach = traces.select("trace_id", "lo", "hi", groups.alias("_groups")).select("trace_id", "lo", "hi", F.explode("_groups").alias("_group"))
    gpu_by_node = aggregate_over_intervals(
        reach, grouped, group_by=["trace_id"], keys=["_group"], sample_groups=["node_id"], lo="lo", hi="hi", ts="timestamp_ms",
        measures=gpu_measures, tile_ms=options.tile_ms, levels=LIVE_LEVELS,
    )
    busiest_first = F.struct(
        (-F.try_divide(F.col("contention_sum"), F.col("gpu_n"))).alias("calm"), "node_id", *[m.name for m in gpu_measures]
    )
    latest = gpu.orderBy(F.desc("timestamp_ms"), "node_id", "gpu_id").limit(options.live_fallback_samples)
    fallback = latest.groupBy("node_id").agg(*fold_samples(gpu_measures)).agg(F.min(busiest_first).alias("b")).scalar()
    busiest = kept("busiest", gpu_by_node.groupBy("trace_id").agg(F.min(busiest_first).alias("b")))
    placed = (
        traces.join(busiest, "trace_id", "left")
        .withColumn("b", F.coalesce("b", fallback))
        .select(
            "trace_id",
            *trace,
            F.coalesce("b.node_id", F.lit(ROUTING.default_node)).alias("node_id"),
            *[F.col(f"b.{m.name}").alias(m.name) for m in gpu_measures],
        )
    )
    names = [m.name for m in NETWORK_MEASURES]
    around = aggregate_over_intervals(
        placed, network, group_by=["trace_id"], keys=["node_id"], lo="lo", hi="hi", ts="timestamp_ms",
        measures=[count_of("net_n"), *NETWORK_MEASURES], tile_ms=options.tile_ms, levels=LIVE_LEVELS,
        carry=[*trace, "node_id", *[m.name for m in gpu_measures]],
    )
    with_network = kept("network", around)
    last = top_rows(network, ["node_id"], [F.desc("timestamp_ms")], options.live_fallback_samples)
    net_last = last.groupBy("node_id").agg(*fold_samples(NETWORK_MEASURES)).select("node_id", F.struct(*names).alias("_last"))
    first_gpu = gpu.groupBy("node_id", (-F.col("timestamp_ms")).alias("first_age")).agg(F.min("gpu_id").alias("first_gpu"))
    seen = F.when(F.col("net_n").isNotNull(), F.struct(*names))
    others = [c for c in with_network.columns if c not in names]
    wide = (
        with_network.join(net_last, "node_id", "left")
        .join(first_gpu, ["node_id", "first_age"], "left")
        .select(*others, "first_gpu", F.coalesce(seen, "_last").alias("_net"))
        .select("*", *[F.col(f"_net.{n}").alias(n) for n in names])
    )
    start, end = F.col("start_ts_ms"), F.col("end_ts_ms")
    zero = F.lit(0.0)
    return wide.select(
        "trace_id",
        "session_id",
        "start_ts_ms",
        "end_ts_ms",
        F.when((start != 0) & (end != 0), (end - start).cast("double")).otherwise(zero).alias("total_duration_ms"),
        F.lit("").alias("trajectory_signature"),
        F.lit("").alias("step_sequence"),
        "step_count",
        "llm_call_count",
        "tool_call_count",
        "retrieve_count",
        F.lit(0).alias("retry_count"),
        *[zero.alias(f"quality_{c}") for c in QUALITY_COLUMNS],
        F.lit("").alias("quality_explanation"),
        *_signals(other=1),
        zero.alias("queue_wait_avg"),
        zero.alias("queue_wait_max"),
        F.concat(F.lit(ROUTING.pod_prefix), "node_id").alias("primary_pod_id"),
        F.col("node_id").alias("primary_node_id"),
        F.coalesce(F.nullif(F.col("first_gpu"), F.lit("")), F.lit(ROUTING.default_gpu)).alias("primary_gpu_id"),
        ingestion_date(ingested_ms).alias("ingestion_date"),
        ingestion_hour(ingested_ms).alias("ingestion_hour"),
    )
