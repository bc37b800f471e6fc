"""OTLP messages -> one row per span. Projections and generators only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import otlp as o
from spanloom.schemas import OTLP_MESSAGE


BAD = "_undecodable"


def _parsed(column: str) -> Column:
    """The message, with the text itself in ``BAD`` if it is no JSON or any part has another shape than it should."""
    return F.from_json(F.col(column), f"{OTLP_MESSAGE}, {BAD} STRING", {"columnNameOfCorruptRecord": BAD})


def undecodable(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages to set aside: text that is not a JSON object of the message's shape."""
    parsed = _parsed(column)
    return messages.where(parsed.isNull() | parsed[BAD].isNotNull() | F.from_json(F.col(column), "map<string,string>").isNull())


def flatten(messages: DataFrame, ingested_at: Column | None = None, column: str = "value") -> DataFrame:
    """Message texts -> spans (15 columns). A text that cannot be decoded has no spans.

    The text is parsed inside the first generator: once per message, with nothing for a filter to repeat.
    """
    ingested_at = F.current_timestamp() if ingested_at is None else ingested_at
    parsed = _parsed(column)
    resources = messages.select(F.explode(F.array(parsed)).alias("m")).select(
        F.explode(F.when(F.col(f"m.{BAD}").isNull(), F.col("m.resourceSpans"))).alias("rs")
    )
    scopes = resources.select(
        o.service_name(F.col("rs.resource.attributes")).alias("service_name"),
        F.explode("rs.scopeSpans").alias("ss"),
    )
    spans = scopes.select("service_name", F.explode("ss.spans").alias("s"))
    attributed = spans.select(
        "service_name",
        "s",
        o.attribute_map(F.col("s.attributes")).alias("tag_map"),
        o.nanos(F.col("s.startTimeUnixNano")).alias("start_ns"),
        o.nanos(F.col("s.endTimeUnixNano")).alias("end_ns"),
    )
    empty = F.lit("")
    return attributed.select(
        o.normalise_id(F.col("s.traceId")).alias("trace_id"),
        F.coalesce(F.col("tag_map")["session.id"], empty).alias("session_id"),
        o.normalise_id(F.col("s.spanId")).alias("span_id"),
        o.normalise_id(F.col("s.parentSpanId")).alias("parent_span_id"),
        F.coalesce(F.col("s.name"), empty).alias("operation_name"),
        "service_name",
        F.col("start_ns").alias("start_time_unix_nano"),
        F.col("end_ns").alias("end_time_unix_nano"),
        o.span_duration(F.col("start_ns"), F.col("end_ns")).alias("duration_ns"),
        o.status_name(F.col("s.status.code")).alias("status_code"),
        F.coalesce(F.col("s.status.message"), empty).alias("status_message"),
        o.warning_text(F.col("s.events"), F.col("s.status")).alias("warning"),
        F.to_json("tag_map").alias("tags"),
        F.to_json(o.link_map(F.col("s.links"))).alias("references"),
        ingested_at.cast("timestamp").alias("ingested_at"),
    )


def identified(spans: DataFrame) -> DataFrame:
    """Spans that belong to a trace."""
    return spans.where(F.col("trace_id") != "")


def unidentified(spans: DataFrame) -> DataFrame:
    """Spans without a trace id, for a reject log: together they would be one giant trace of spans that have nothing in common."""
    return spans.where(F.coalesce("trace_id", F.lit("")) == "")
