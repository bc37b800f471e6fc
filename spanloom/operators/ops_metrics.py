"""Operational metrics derived from spans: model calls, tools, retrievals, handoffs, workflows, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans as s
from spanloom.functions.timeparts import HOUR_MS, floor_div, ns_to_ms
from spanloom.operators.ordered import running_total
from spanloom.operators.steps import with_step

# Upper bounds (seconds) of the duration histogram; the last bucket is open.
DURATION_BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0)
# The same for the number of documents of a retrieval.
DOCUMENT_BOUNDS = (0, 1, 3, 5, 10, 20)

NANOS = 1_000_000_000.0


def measured_spans(spans: DataFrame) -> DataFrame:
    """Classified spans with the dimensions the metrics are grouped by; narrow."""
    t, unknown = F.col("_tags"), F.lit("unknown")
    return with_step(spans).select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "operation_name",
        F.col("_step.kind").alias("kind"),
        F.coalesce(t["gen_ai.request.model"], unknown).alias("model"),
        F.coalesce(t["gen_ai.agent.name"], t["agent.name"], F.lit("default")).alias("agent"),
        F.coalesce(t["db.collection.name"], unknown).alias("collection"),
        F.coalesce(t["rpc.method"], t["url.full"], unknown).alias("tool"),
        (F.col("status_code") != "ERROR").alias("success"),
        # The attribute, else the message's first word.
        F.coalesce(t["error.type"], F.nullif(F.substring_index("status_message", " ", 1), F.lit("")), unknown).alias("error_type"),
        "status_code",
        "duration_ns",
        (F.col("duration_ns") / F.lit(NANOS)).alias("seconds"),
        F.coalesce(s.safe_int(t["gen_ai.usage.input_tokens"]), F.lit(0)).alias("input_tokens"),
        F.coalesce(s.safe_int(t["gen_ai.usage.output_tokens"]), F.lit(0)).alias("output_tokens"),
        F.coalesce(s.safe_int(t["db.response.returned_rows"]), F.lit(0)).alias("documents"),
        F.coalesce(s.safe_int(t["retry.count"]), F.lit(0)).alias("retries"),
        ns_to_ms(F.col("start_time_unix_nano")).alias("start_ms"),
        ns_to_ms(F.col("end_time_unix_nano")).alias("end_ms"),
    )


def _calls(measured: DataFrame, kind: str, by: list[str], **extra: Column) -> DataFrame:
    return (
        measured.where(F.col("kind") == kind)
        .groupBy(*by)
        .agg(
            F.count("*").alias("calls"),
            F.count_if(~F.col("success")).alias("errors"),
            # Whole nanoseconds add up exactly, in whatever order tasks deliver them.
            (F.sum("duration_ns") / F.lit(NANOS)).alias("seconds"),
            *[column.alias(name) for name, column in extra.items()],
        )
    )


def model_calls(measured: DataFrame) -> DataFrame:
    return _calls(
        measured, "REASON", ["model", "agent"],
        input_tokens=F.sum("input_tokens"), output_tokens=F.sum("output_tokens"),
    )


def retrievals(measured: DataFrame) -> DataFrame:
    return _calls(measured, "RETRIEVE", ["collection"], documents=F.sum("documents"))


def tool_calls(measured: DataFrame) -> DataFrame:
    return _calls(measured, "TOOL", ["tool", "success"])


def workflows(measured: DataFrame) -> DataFrame:
    return _calls(measured, "ENTRY", ["status_code"])


def retries(measured: DataFrame) -> DataFrame:
    return (
        measured.where(F.col("retries") > 0)
        .groupBy("operation_name", F.col("retries").alias("attempt"))
        .agg(F.count("*").alias("count"))
    )


def handoffs(measured: DataFrame) -> DataFrame:
    """Agent steps started directly under another agent's step, counted from agent to agent."""
    agents = measured.where(F.col("kind") == "AGENT")
    children = agents.groupBy("trace_id", F.col("parent_span_id").alias("span_id"), F.col("agent").alias("to_agent")).agg(
        F.count("*").alias("_n")
    )
    parents = agents.groupBy("trace_id", "span_id").agg(F.min("agent").alias("from_agent"))
    return (
        children.join(parents, ["trace_id", "span_id"])
        .groupBy("from_agent", "to_agent")
        .agg(F.sum("_n").alias("handoffs"))
    )


def _bucket(value: str, bounds: tuple) -> Column:
    """The smallest bound a value does not exceed; null above all of them."""
    return F.coalesce(*[F.when(F.col(value) <= b, F.lit(b)) for b in bounds], F.lit(None))


def _hour() -> Column:
    return (floor_div(F.col("start_ms"), HOUR_MS) * HOUR_MS).alias("hour_ms")


def duration_histogram(measured: DataFrame, kind: str | None, by: list[str], hourly: bool = True) -> DataFrame:
    """Steps (of one kind) per dimensions, hour and duration bucket, by the bucket's upper bound (null is the open one)."""
    steps = measured if kind is None else measured.where(F.col("kind") == kind)
    hour = [_hour()] if hourly else []
    return steps.groupBy(*by, *hour, _bucket("seconds", DURATION_BOUNDS).alias("seconds_up_to")).agg(
        F.count("*").alias("count")
    )


def documents_histogram(measured: DataFrame) -> DataFrame:
    """Retrievals per collection, hour and number of documents, by the bucket's upper bound (null is the open one)."""
    found = measured.where(F.col("kind") == "RETRIEVE")
    return found.groupBy("collection", _hour(), _bucket("documents", DOCUMENT_BOUNDS).alias("documents_up_to")).agg(
        F.count("*").alias("count")
    )


def errors_by_type(measured: DataFrame) -> DataFrame:
    """Failed steps per kind, model, agent, hour and type of error."""
    failed = measured.where(~F.col("success"))
    return failed.groupBy("kind", "model", "agent", "error_type", _hour()).agg(F.count("*").alias("errors"))


def active_agents(measured: DataFrame, slice_ms: int = HOUR_MS) -> DataFrame:
    """Number of agent steps in flight after each instant at which it changes."""
    agents = measured.where(F.col("kind") == "AGENT")
    # A step without an end is still in flight, one without a start cannot be placed: neither may leave without entering.
    begun = agents.where(F.col("start_ms") > 0)
    changes = begun.select(F.col("start_ms").alias("at_ms"), F.lit(1).alias("d")).unionByName(
        begun.where(F.col("end_ms") > 0).select(F.col("end_ms").alias("at_ms"), F.lit(-1).alias("d"))
    )
    net = changes.groupBy("at_ms").agg(F.sum("d").alias("change")).where(F.col("change") != 0)
    counted = running_total(net, ["at_ms"], F.col("change"), floor_div(F.col("at_ms"), slice_ms), "active")
    return counted.select("at_ms", "change", "active")


def _value_slice(value: Column) -> Column:
    """Logarithmic bucket that grows with the value, fine from a billionth of the unit on."""
    return F.floor(F.log2(F.greatest(value, F.lit(0.0)) * 1e9 + 1) * 32)


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles per key: element floor(n*q) of the sorted values.

    Equal values are counted first, then ranks run over distinct values in slices; nothing is collected per key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counted, [value], F.col("_n"), _value_slice(F.col(value)), "_upto", keys)
    totals = counted.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("_n").alias("n"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    picks = [
        F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1), F.col(value))).alias(name)
        for name, q in quantiles.items()
    ]
    return ranked.join(totals, match).groupBy(*keys).agg(F.max("n").alias("n"), *picks)


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _rates(spans: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("status_code") != "ERROR"
    return spans.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.round(F.count_if(ok) / F.count("*") * 100, 1).alias("success_pct"),
        F.round(F.try_divide(F.sum(F.when(ok, F.col("duration_ns"))), F.count_if(ok)) / F.lit(NANOS), 2).alias("mean_s"),
    )


def latency_report(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, success rate and mean per key, with exact percentiles over the successful ones."""
    timed = spans.where(F.col("status_code") != "ERROR").withColumn("_seconds", F.col("duration_ns") / F.lit(NANOS))
    ranks = nearest_rank(timed, keys, "_seconds", PERCENTILES)
    return _rates(spans, keys).join(ranks.drop("n"), keys, "left")


# --- percentiles from mergeable sketches ---


def latency_sketch(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of successful requests per key, hour and logarithmic bucket of their seconds: small, and sketches of parts add up.

    A bucket is about two percent wide, so a key has some two thousand at most, whatever the number of requests.
    """
    ok = spans.where(F.coalesce(F.col("status_code") != "ERROR", F.lit(False)) & F.col("duration_ns").isNotNull())
    hour = floor_div(F.col("start_time_unix_nano"), HOUR_MS * 1_000_000).alias("hour")
    return ok.groupBy(*keys, hour, _value_slice(F.col("duration_ns") / F.lit(NANOS)).alias("bucket")).agg(F.count("*").alias("n"))


def _wanted_buckets(sketch: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Per key and percentile: the bucket that holds its rank, and the rank within it. The hours of a sketch are added up first."""
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    # One row per bucket of a key meets here, never one per request.
    upto = merged.withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    total = upto.withColumn("_total", F.sum("n").over(Window.partitionBy(*keys)))
    picks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()])
    asked = total.withColumn("p", F.explode(picks)).withColumn("_rank", F.least(F.floor(F.col("_total") * F.col("p.q")), F.col("_total") - 1))
    inside = asked.where((F.col("_rank") >= F.col("_upto") - F.col("n")) & (F.col("_rank") < F.col("_upto")))
    return inside.select(*keys, "bucket", F.col("p.name").alias("name"), (F.col("_rank") - F.col("_upto") + F.col("n")).alias("offset"))


def percentiles_from_sketch(spans: DataFrame, sketch: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the sketch says in which bucket each rank lies, and only values of these buckets are looked at.

    Keys must not be null. The second scan keeps some percent of the rows; equal values are counted before they meet.
    """
    wanted = _wanted_buckets(sketch, keys, quantiles)
    seconds = F.col("duration_ns") / F.lit(NANOS)
    ok = spans.where((F.col("status_code") != "ERROR") & F.col("duration_ns").isNotNull())
    values = ok.select(*keys, seconds.alias("value"), _value_slice(seconds).alias("bucket"))
    near = values.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi").groupBy(*keys, "bucket", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_upto", upto).join(wanted, [*keys, "bucket"]).where(F.col("_upto") > F.col("offset"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])


def latency_report_from_sketch(spans: DataFrame, sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``latency_report`` with its percentiles from a stored sketch of the same spans."""
    return _rates(spans, keys).join(percentiles_from_sketch(spans, sketch, keys, PERCENTILES), keys, "left")


def approximate_latency(spans: DataFrame, keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """The same percentiles from a mergeable sketch: one aggregation, for dashboards over very large tables."""
    seconds = F.col("duration_ns") / F.lit(NANOS)
    return spans.where(F.col("status_code") != "ERROR").groupBy(*keys).agg(
        *[F.percentile_approx(seconds, q, accuracy).alias(name) for name, q in PERCENTILES.items()]
    )


def calibrated_threshold(gpu_metrics: DataFrame) -> DataFrame:
    """Suggested GPU pressure threshold between mean and peak contention; null when contention barely moves."""
    stats = gpu_metrics.agg(
        F.round(F.avg("contention_index"), 4).alias("avg_contention"), F.max("contention_index").alias("max_contention")
    )
    avg, peak = F.col("avg_contention"), F.col("max_contention")
    return stats.withColumn(
        "suggested_threshold", F.when(peak > avg + 0.01, F.round(avg + F.lit(0.6) * (peak - avg), 2))
    )
