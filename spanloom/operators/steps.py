"""Spans -> classified agent steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as s
from spanloom.functions.timeparts import ingestion_date, ingestion_hour, now_ms, ns_to_ms
from spanloom.options import STEPS, StepOptions


def impacted_traces(batch: DataFrame) -> DataFrame:
    return batch.select("trace_id").distinct()


def of_traces(df: DataFrame, traces: DataFrame) -> DataFrame:
    """Rows whose trace is in ``traces``; a semi join, so no id list passes through the driver."""
    return df.join(traces.select("trace_id"), "trace_id", "left_semi")


def lookback_start_ms(batch: DataFrame, options: StepOptions = STEPS) -> Column:
    """Start of the time a batch of spans looks back to: the lookback before its earliest span."""
    back = F.lit(options.lookback_hours * 3_600_000).cast("bigint")
    earliest = batch.agg(F.coalesce(F.min("start_time_unix_nano"), F.lit(0).cast("bigint")).alias("t")).scalar()
    return ns_to_ms(earliest) - back


def within_lookback(spans: DataFrame, batch: DataFrame, options: StepOptions = STEPS) -> DataFrame:
    """Spans that start at most the lookback before the earliest span of the batch."""
    return spans.where(F.col("start_time_unix_nano") >= lookback_start_ms(batch, options) * 1_000_000)


def before_lookback(steps: DataFrame, batch: DataFrame, options: StepOptions = STEPS) -> DataFrame:
    """The steps whose spans ``within_lookback`` leaves out."""
    return steps.where(F.col("start_ts_ms") < lookback_start_ms(batch, options))


def with_step(spans: DataFrame) -> DataFrame:
    """Adds ``_tags`` (map) and ``_step`` (kind, sub) and leaves out spans no rule matches.

    The tags are parsed once per span. A plain filter on the step would be pushed below the projection, which repeats
    the JSON parse for every rule; the generator is a barrier to that.
    """
    parsed = F.transform(
        F.array(s.parse_tags(F.col("tags"))), lambda t: F.struct(t.alias("tags"), s.classify(t).alias("step"))
    )
    matched = F.explode(F.filter(parsed, lambda c: c["step"].isNotNull()))
    return (
        spans.select("*", matched.alias("_c"))
        .withColumn("_tags", F.col("_c.tags"))
        .withColumn("_step", F.col("_c.step"))
        .drop("_c")
    )


def classified(spans: DataFrame, ingested_ms: Column | None = None, with_user_message: bool = False) -> DataFrame:
    """Drop, classify and flatten spans; one narrow stage. Reasoning right under an entry span is still in."""
    ingested_ms = now_ms() if ingested_ms is None else ingested_ms
    kinds = with_step(spans.where(~s.is_dropped(F.col("operation_name"))))
    kind, tags = F.col("_step.kind"), F.col("_tags")
    attributes = s.step_attributes(kind, tags)
    if with_user_message:
        attributes["prompt"] = F.coalesce(attributes["prompt"], s.user_message(kind, tags))
    empty = F.lit("")
    return kinds.select(
        "trace_id",
        F.coalesce(F.col("session_id"), empty).alias("session_id"),
        "span_id",
        F.coalesce(F.col("parent_span_id"), empty).alias("parent_span_id"),
        kind.alias("span_kind"),
        F.col("_step.sub").alias("sub_span_kind"),
        ns_to_ms(F.col("start_time_unix_nano")).alias("start_ts_ms"),
        (F.coalesce(F.col("duration_ns"), F.lit(0)) / F.lit(1_000_000.0)).alias("duration_ms"),
        ns_to_ms(F.col("end_time_unix_nano")).alias("end_ts_ms"),
        *[column.alias(name) for name, column in attributes.items()],
        ingestion_date(ingested_ms).alias("ingestion_date"),
        ingestion_hour(ingested_ms).alias("ingestion_hour"),
    )


def without_entry_reasoning(steps: DataFrame) -> DataFrame:
    """Remove REASON steps whose parent is an ENTRY step of the same trace.

    The join key is (trace, span): a trace with very many steps spreads over all tasks. Steps that cannot be removed
    carry their own id in the key, so they spread too and never match.
    """
    own = F.concat(F.lit("own:"), F.coalesce(F.col("span_id"), F.lit("")))
    parent = F.concat(F.lit("parent:"), F.col("parent_span_id"))
    keyed = steps.withColumn("_key", F.when(F.col("span_kind") == "REASON", parent).otherwise(own))
    entries = (
        steps.where(F.col("span_kind") == "ENTRY")
        .select("trace_id", F.concat(F.lit("parent:"), F.col("span_id")).alias("_key"))
        .distinct()
    )
    return keyed.join(entries, ["trace_id", "_key"], "left_anti").select(steps.columns)


def agent_steps(spans: DataFrame, ingested_ms: Column | None = None, with_user_message: bool = False) -> DataFrame:
    return without_entry_reasoning(classified(spans, ingested_ms, with_user_message))


def reasoning_calls(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("span_kind") == "REASON")


def trace_search(
    spans: DataFrame, service: str, now_ns: int | Column, lookback_ms: int = 3_600_000, limit: int = 20
) -> DataFrame:
    """The most recent traces of a service (a top-k report)."""
    now_ns = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    since = now_ns - F.lit(lookback_ms * 1_000_000).cast("bigint")
    recent = spans.where((F.col("service_name") == service) & (F.col("start_time_unix_nano") >= since))
    return (
        recent.groupBy("trace_id")
        .agg(
            F.count("*").alias("span_count"),
            F.min("start_time_unix_nano").alias("start_time_unix_nano"),
            F.max("end_time_unix_nano").alias("end_time_unix_nano"),
            F.count_if(F.col("status_code") == "ERROR").alias("error_count"),
        )
        .orderBy(F.desc("start_time_unix_nano"), "trace_id")
        .limit(limit)
    )


def call_graph(spans: DataFrame, label: str = "operation_name") -> DataFrame:
    """Parent/child edges between labels with their counts.

    Children are counted per parent span before the join, so a parent with very many children is one row in it.
    """
    children = (
        spans.where(F.col("parent_span_id") != "")
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"), F.col(label).alias("target"))
        .agg(F.count("*").alias("_n"))
    )
    parents = spans.groupBy("trace_id", "span_id").agg(F.min(label).alias("source"))
    return (
        children.join(parents, ["trace_id", "span_id"])
        .groupBy("source", "target")
        .agg(F.sum("_n").alias("calls"))
    )


def call_graph_totals(edges: DataFrame) -> DataFrame:
    """Node count and edge counts by target, as (measure, value)."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    by_target = edges.groupBy(F.concat(F.lit("edges to "), F.col("target")).alias("measure")).agg(
        F.count("*").alias("value")
    )
    return (
        nodes.agg(F.count("*").alias("value"))
        .select(F.lit("nodes").alias("measure"), "value")
        .unionByName(edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("measure"), "value"))
        .unionByName(by_target)
    )
