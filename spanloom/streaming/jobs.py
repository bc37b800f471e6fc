"""The streaming chain: spans -> steps -> trajectories, scores, routing -> correlated traces -> windows.

Every job reads the change log of the table before it, works on the traces the micro-batch touches, and writes one
batch of its own log. Logs are cut to these traces, or to the dates around them, before they are shuffled. Nothing is
collected; replaying a batch overwrites that batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from spanloom import schemas
from spanloom.functions.timeparts import floor_div, ingestion_date, ingestion_hour
from spanloom.operators.correlate import correlate, in_time_range, timed_calls
from spanloom.operators.infra import route_calls
from spanloom.operators.otlp import flatten, identified, undecodable, unidentified
from spanloom.operators.scoring import JudgeFactory, evaluate, rule_judge
from spanloom.operators.steps import agent_steps, before_lookback, impacted_traces, of_traces, within_lookback
from spanloom.operators.trajectory import trajectories
from spanloom.options import CORRELATION, DRIFT, ROUTING, STEPS, CorrelationOptions, DriftOptions, RoutingOptions, StepOptions
from spanloom.sources import changelog, tables
from spanloom.streaming import incremental

DEFAULT_TRIGGER = "5 minutes"


@dataclass(frozen=True)
class Pipeline:
    """Where the chain's tables live and how its jobs behave."""

    folder: str
    trigger: str | None = DEFAULT_TRIGGER  # None: work off what is there, then stop
    max_files: int | None = None  # landed files per micro-batch
    max_log_files: int | None = None  # files of the logs between the jobs per micro-batch
    judge: JudgeFactory = rule_judge
    eval_model: str = "rules"
    steps: StepOptions = field(default=STEPS)
    routing: RoutingOptions = field(default=ROUTING)
    correlation: CorrelationOptions = field(default=CORRELATION)
    drift: DriftOptions = field(default=DRIFT)

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def scratch(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/scratch/{name}"

    def checkpoint(self, job: str) -> str:
        return f"{self.folder.rstrip('/')}/checkpoints/{job}"


BatchWork = Callable[[DataFrame, int], None]


def _triggered(writer, chain: Pipeline):
    return writer.trigger(availableNow=True) if chain.trigger is None else writer.trigger(processingTime=chain.trigger)


def start(stream: DataFrame, name: str, work: BatchWork, chain: Pipeline) -> StreamingQuery:
    """Run ``work`` on every micro-batch that is not empty."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            work(batch, batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", chain.checkpoint(name)).queryName(name)
    return _triggered(writer, chain).start()


def _log(spark: SparkSession, chain: Pipeline, table: str) -> DataFrame:
    return changelog.read_log(spark, chain.path(table), schemas.TABLES[table][0])


# A batch of these holds all rows of its traces, so the newest batch of a trace replaces the ones before it.
BY_TRACE = ("agent_steps", "trajectory_templates", "quality_scores", "trace_correlated")


def current(spark: SparkSession, chain: Pipeline, table: str, traces: DataFrame | None = None) -> DataFrame:
    """What a table says now (of some traces): the newest row per key, or all rows of a trace's newest batch.

    The trace id is part of the keys of all tables about traces, so the log is cut to the traces before it is shuffled.
    """
    schema, keys = schemas.TABLES[table]
    log = changelog.read_log(spark, chain.path(table), schema)
    if traces is not None:
        log = of_traces(log, traces)
    return changelog.current_by_trace(log) if table in BY_TRACE else changelog.current(log, keys)


def current_routing(spark: SparkSession, chain: Pipeline, traces: DataFrame) -> DataFrame:
    """Routed calls of some traces that are still among their steps (a late entry span can retract a call)."""
    steps = current(spark, chain, "agent_steps", traces).select("trace_id", "span_id")
    return current(spark, chain, "request_routing", traces).join(steps, ["trace_id", "span_id"], "left_semi")


def samples_near(spark: SparkSession, chain: Pipeline, table: str, paths: DataFrame) -> DataFrame:
    """Current samples near some traces. Their time is part of their key, so the log is cut to these dates before anything else."""
    near = in_time_range(_log(spark, chain, table), paths, chain.correlation)
    return changelog.current(near, schemas.TABLES[table][1])


def _changes(spark: SparkSession, chain: Pipeline, table: str) -> DataFrame:
    return changelog.stream_log(spark, chain.path(table), schemas.TABLES[table][0], chain.max_log_files)


def _write(df: DataFrame, chain: Pipeline, table: str, batch_id: int, keys: bool = True) -> None:
    changelog.write_batch(df, chain.path(table), batch_id, schemas.TABLES[table][1] if keys else ())


def start_spans(spark: SparkSession, chain: Pipeline, landing: str) -> StreamingQuery:
    """Message files -> span table; undecodable messages -> ``dead_letters``, spans without a trace id -> ``rejected_spans``."""
    messages = tables.message_stream(spark, landing, chain.max_files)

    def work(batch: DataFrame, batch_id: int) -> None:
        spans = changelog.once(flatten(batch), chain.scratch("spans"))
        changelog.write_batch(identified(spans), chain.path("trace_delta_table"), batch_id)
        changelog.write_batch(unidentified(spans), chain.path("rejected_spans"), batch_id)
        changelog.write_batch(undecodable(batch), chain.path("dead_letters"), batch_id)

    return start(messages, "spans", work, chain)


def start_agent_steps(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    """New spans -> all steps of their traces, replacing what was there (a late entry span retracts steps).

    Spans are read again within the lookback; steps from before it are carried over from the batches before this one.
    """
    stream = _changes(spark, chain, "trace_delta_table")

    def work(batch: DataFrame, batch_id: int) -> None:
        traces = impacted_traces(batch)
        log = _log(spark, chain, "trace_delta_table")
        spans = within_lookback(of_traces(log, traces), batch, chain.steps).drop(changelog.BATCH)
        written = _log(spark, chain, "agent_steps").where(F.col(changelog.BATCH) < batch_id)
        kept = before_lookback(changelog.current_by_trace(of_traces(written, traces)), batch, chain.steps)
        _write(agent_steps(spans).unionByName(kept), chain, "agent_steps", batch_id)

    return start(stream, "agent_steps", work, chain)


def start_trajectories(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    def work(batch: DataFrame, batch_id: int) -> None:
        steps = current(spark, chain, "agent_steps", impacted_traces(batch))
        _write(trajectories(steps, options=chain.steps), chain, "trajectory_templates", batch_id)

    return start(_changes(spark, chain, "agent_steps"), "trajectory", work, chain)


def start_quality(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    def work(batch: DataFrame, batch_id: int) -> None:
        steps = current(spark, chain, "agent_steps", impacted_traces(batch))
        _write(evaluate(steps, chain.judge, chain.eval_model), chain, "quality_scores", batch_id)

    return start(_changes(spark, chain, "agent_steps"), "quality", work, chain)


def _unplaced(spark: SparkSession, chain: Pipeline, batch: DataFrame, batch_id: int) -> DataFrame:
    """Traces with calls that were routed before their node had any sample, if the batch brings samples of that node."""
    waiting = _log(spark, chain, "unplaced_calls").where(F.col(changelog.BATCH) < batch_id)
    nodes = batch.where("node_id IS NOT NULL").select("node_id").distinct()
    return waiting.join(nodes, "node_id", "left_semi").select("trace_id").distinct()


def start_routing(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    """Calls of changed traces, and of traces that were routed before their node had a sample, by the newest sample of the node."""
    changed = _changes(spark, chain, "agent_steps").select("trace_id", F.lit(None).cast("string").alias("node_id"))
    sampled = _changes(spark, chain, "gpu_metrics").select(F.lit(None).cast("string").alias("trace_id"), "node_id")

    def work(batch: DataFrame, batch_id: int) -> None:
        named = batch.where("trace_id IS NOT NULL").select("trace_id")
        traces = named.union(_unplaced(spark, chain, batch, batch_id)).distinct()
        steps = current(spark, chain, "agent_steps", traces)
        gpus = current(spark, chain, "gpu_metrics")
        _write(route_calls(steps, gpus, options=chain.routing), chain, "request_routing", batch_id)
        routed = _log(spark, chain, "request_routing").where(F.col(changelog.BATCH) == batch_id)
        unplaced = routed.select("node_id", "trace_id").distinct().join(gpus.select("node_id"), "node_id", "left_anti")
        changelog.write_batch(unplaced, chain.path("unplaced_calls"), batch_id)

    return start(changed.unionByName(sampled), "routing", work, chain)


def start_metrics(
    spark: SparkSession, chain: Pipeline, landing: str, table: str, fmt: tables.MetricFormat
) -> StreamingQuery:
    """Metric JSON lines -> metric table by key; bad lines -> ``<table>_rejects``. Each file is read once."""

    def work(batch: DataFrame, batch_id: int) -> None:
        # Parsed once; the text of good lines is not needed any more.
        parsed = tables.checked_metrics(batch, fmt).withColumn("value", F.when(F.col("reject_reason").isNotNull(), F.col("value")))
        checked = changelog.once(parsed, chain.scratch(f"checked_{table}"))
        _write(tables.accepted(checked, fmt), chain, table, batch_id)
        changelog.write_batch(tables.rejected(checked), chain.path(f"{table}_rejects"), batch_id)

    return start(tables.metric_stream(spark, landing, chain.max_files), table, work, chain)


def start_gpu_metrics(spark: SparkSession, chain: Pipeline, landing: str) -> StreamingQuery:
    return start_metrics(spark, chain, landing, "gpu_metrics", tables.GPU_FORMAT)


def start_network_metrics(spark: SparkSession, chain: Pipeline, landing: str) -> StreamingQuery:
    return start_metrics(spark, chain, landing, "network_metrics", tables.NETWORK_FORMAT)


def tile_of(at: Column, chain: Pipeline) -> Column:
    """Tiles as wide as the interval around a call, so that an interval meets two of them at most."""
    return floor_div(at, 2 * chain.correlation.tolerance_ms + 1)


def trace_tiles(calls: DataFrame, chain: Pipeline) -> DataFrame:
    """The reverse index of correlation: tiles of time and nodes whose samples count for a trace."""
    reach = chain.correlation.tolerance_ms
    ends = F.array(tile_of(F.col("call_ts") - reach, chain), tile_of(F.col("call_ts") + reach, chain))
    tiles = calls.select("node_id", "trace_id", F.explode(F.array_distinct(ends)).alias("tile")).distinct()
    at = F.col("tile") * (2 * reach + 1)
    return tiles.select("node_id", "tile", "trace_id", ingestion_date(at).alias("ingestion_date"), ingestion_hour(at).alias("ingestion_hour"))


def sampled_traces(spark: SparkSession, chain: Pipeline, batch: DataFrame, batch_id: int) -> DataFrame:
    """Correlated traces near the batch's samples. The index is divided by date, and only the samples' dates are read."""
    width = 2 * chain.correlation.tolerance_ms + 1
    tiles = batch.where("timestamp_ms IS NOT NULL").select("node_id", tile_of(F.col("timestamp_ms"), chain).alias("tile")).distinct()
    tiles = tiles.withColumn("ingestion_date", ingestion_date(F.col("tile") * width))
    index = _log(spark, chain, "trace_tiles").where(F.col(changelog.BATCH) < batch_id)
    near = index.join(tiles.select("ingestion_date").distinct(), "ingestion_date", "left_semi")
    return near.join(tiles, ["node_id", "tile"], "left_semi").select("trace_id").distinct()


def start_correlated(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    """Driven by new scores, trajectories, routed calls and samples, so a trace is correlated whichever of them comes last."""
    none = F.lit(None)
    touched = None
    for table in ("quality_scores", "trajectory_templates", "request_routing"):
        rows = _changes(spark, chain, table).select("trace_id", none.cast("string").alias("node_id"), none.cast("bigint").alias("timestamp_ms"))
        touched = rows if touched is None else touched.unionByName(rows)
    for table in ("gpu_metrics", "network_metrics"):
        touched = touched.unionByName(_changes(spark, chain, table).select(none.cast("string").alias("trace_id"), "node_id", "timestamp_ms"))

    def work(batch: DataFrame, batch_id: int) -> None:
        near = changelog.once(batch, chain.scratch("touched"))
        named = near.where("trace_id IS NOT NULL").select("trace_id")
        traces = changelog.once(named.union(sampled_traces(spark, chain, near, batch_id)).distinct(), chain.scratch("traces"))
        paths = changelog.once(current(spark, chain, "trajectory_templates", traces), chain.scratch("paths"))
        routing = changelog.once(current_routing(spark, chain, traces), chain.scratch("routing"))
        rows = correlate(
            paths,
            current(spark, chain, "quality_scores", traces),
            routing,
            samples_near(spark, chain, "gpu_metrics", paths),
            samples_near(spark, chain, "network_metrics", paths),
            options=chain.correlation,
        )
        # The index first: a crash in between leaves tiles too many, never one too few.
        changelog.write_batch(trace_tiles(timed_calls(paths, routing), chain), chain.path("trace_tiles"), batch_id)
        _write(rows, chain, "trace_correlated", batch_id)

    return start(touched, "correlated", work, chain)


def start_windows(spark: SparkSession, chain: Pipeline) -> StreamingQuery:
    """Correlated traces -> changes of slices -> the windows they are in; work follows the batch (see ``incremental``)."""
    folder = chain.folder.rstrip("/")

    def work(batch: DataFrame, batch_id: int) -> None:
        incremental.update(incremental.changes(batch, folder, batch_id, chain.drift), folder, batch_id, chain.drift)

    return start(_changes(spark, chain, "trace_correlated"), "windows", work, chain)


def current_windows(spark: SparkSession, chain: Pipeline) -> DataFrame:
    return incremental.current_windows(spark, chain.folder.rstrip("/"))


Job = Callable[[SparkSession, Pipeline, str, str, str], StreamingQuery]

# In the order of the chain. The jobs of one row read nothing that another one of it writes.
STAGES: tuple[tuple[Job, ...], ...] = (
    (
        lambda spark, chain, messages, gpu, network: start_gpu_metrics(spark, chain, gpu),
        lambda spark, chain, messages, gpu, network: start_network_metrics(spark, chain, network),
        lambda spark, chain, messages, gpu, network: start_spans(spark, chain, messages),
    ),
    (lambda spark, chain, *_: start_agent_steps(spark, chain),),
    (
        lambda spark, chain, *_: start_trajectories(spark, chain),
        lambda spark, chain, *_: start_quality(spark, chain),
        lambda spark, chain, *_: start_routing(spark, chain),
    ),
    (lambda spark, chain, *_: start_correlated(spark, chain),),
    (lambda spark, chain, *_: start_windows(spark, chain),),
)
JOBS: tuple[Job, ...] = tuple(job for stage in STAGES for job in stage)


def run_to_end(spark: SparkSession, chain: Pipeline, messages: str, gpu: str, network: str) -> None:
    """Backfill: run every job of a chain with ``trigger=None`` once, stage by stage; the jobs of a stage side by side."""
    for stage in STAGES:
        running: list[StreamingQuery] = []
        try:
            for begin in stage:
                running.append(begin(spark, chain, messages, gpu, network))
            for job in running:
                job.awaitTermination()
        finally:
            for job in running:
                job.stop()


def start_all(spark: SparkSession, chain: Pipeline, messages: str, gpu: str, network: str) -> list[StreamingQuery]:
    """Create the tables that are missing and start every job of a chain with a time trigger, side by side."""
    tables.create_all(spark, chain.folder.rstrip("/"))
    return [begin(spark, chain, messages, gpu, network) for begin in JOBS]


class BatchCounts(StreamingQueryListener):
    """Micro-batches with rows and the most rows of one, per job, as a running chain reports them."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.most_rows: dict[str, int] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None: ...

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        name, rows = event.progress.name, event.progress.numInputRows
        if rows:
            self.batches[name] = self.batches.get(name, 0) + 1
            self.most_rows[name] = max(self.most_rows.get(name, 0), rows)

    def onQueryIdle(self, event: QueryIdleEvent) -> None: ...

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None: ...


def run_until_idle(running: list[StreamingQuery]) -> None:
    """Let jobs that run side by side work until none of them has anything new, then stop them."""

    def at() -> list[int]:
        return [q.lastProgress["batchId"] if q.lastProgress else -1 for q in running]

    try:
        before = None
        while before != (before := at()):
            for job in running:
                job.processAllAvailable()
    finally:
        for job in running:
            job.stop()


def signature_counts(traces: DataFrame, size: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Traces per tumbling window and signature with bounded state: a watermark closes windows.

    Input columns: start_ts (timestamp) and trajectory_signature. Works on streams and on batches.
    """
    return (
        traces.withWatermark("start_ts", lateness)
        .groupBy(F.window("start_ts", size).alias("w"), "trajectory_signature")
        .agg(F.count("*").alias("n"))
        .select(
            F.unix_millis("w.start").alias("window_start_ms"),
            F.unix_millis("w.end").alias("window_end_ms"),
            F.col("trajectory_signature").alias("signature"),
            "n",
        )
    )


def start_closed_windows(
    spark: SparkSession, traces: DataFrame, folder: str, size: str = "1 hour", lateness_ms: int = 600_000
) -> tuple[StreamingQuery, StreamingQuery]:
    """Counts of windows that have closed -> ``closed``, rows that come after their window closed -> ``late``.

    ``traces``: a stream of start_ts and trajectory_signature. A window closes once a row ``lateness_ms`` after its end was seen; it
    is written once, and its state goes. Late rows are told by the same rule: the latest start of each micro-batch is
    kept in ``seen``, one row per batch, and a batch is held against what the batches before it have seen.
    """
    schema = "latest_ms BIGINT"

    def on_closed(batch: DataFrame, batch_id: int) -> None:
        changelog.write_batch(batch, f"{folder}/closed", batch_id)

    def on_rows(batch: DataFrame, batch_id: int) -> None:
        earlier = changelog.read_log(spark, f"{folder}/seen", schema).where(F.col(changelog.BATCH) < batch_id)
        mark = earlier.agg((F.max("latest_ms") - lateness_ms).alias("mark")).scalar()
        timed = batch.withColumn("_w", F.window("start_ts", size))
        late = timed.where(F.unix_millis("_w.end") <= mark).select(F.unix_millis("_w.start").alias("window_start_ms"), "start_ts", "trajectory_signature")
        changelog.write_batch(late, f"{folder}/late", batch_id)
        changelog.write_batch(batch.agg(F.max(F.unix_millis("start_ts")).alias("latest_ms")), f"{folder}/seen", batch_id)

    def begin(stream: DataFrame, work: BatchWork, name: str) -> StreamingQuery:
        writer = stream.writeStream.outputMode("append").foreachBatch(work).option("checkpointLocation", f"{folder}/checkpoints/{name}")
        return writer.trigger(availableNow=True).start()

    # One stateful step: rows count as late by the same time that closes windows, not by that of the batch before.
    setting = "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        closed = begin(signature_counts(traces, size, f"{lateness_ms} milliseconds"), on_closed, "closed")
    finally:
        spark.conf.set(setting, before)
    return closed, begin(traces, on_rows, "late")
