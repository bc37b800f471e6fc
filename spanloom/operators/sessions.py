"""Session and message analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.judge import filled

TITLE_CHARS = 50


def session_rollup(messages: DataFrame, lifecycle: DataFrame | None = None) -> DataFrame:
    """One row per session: title, first and last time, turns, status.

    ``lifecycle`` (session_id, at, status) gives the last known status; a session without one is active.
    """
    order = F.struct("turn_number", "timestamp")
    asked = F.col("role") == "user"
    rolled = messages.groupBy("session_id").agg(
        F.substring(F.coalesce(F.min_by(F.when(asked, F.col("content")), F.when(asked, order)), F.lit("")), 1, TITLE_CHARS)
        .alias("title"),
        F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("updated_at"),
        F.max("turn_number").alias("total_turns"),
        F.count("*").alias("messages"),
    )
    if lifecycle is None:
        return rolled.withColumn("status", F.lit("active"))
    last = lifecycle.groupBy("session_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return rolled.join(last, "session_id", "left").withColumn("status", F.coalesce("status", F.lit("active")))


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """The sessions updated last (a top-k report)."""
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def history(messages: DataFrame) -> DataFrame:
    return messages.orderBy("session_id", "turn_number", "timestamp")


def session_context(extracted: DataFrame) -> DataFrame:
    """Parameters gathered in a session: the last non-empty value of each. Input (session_id, turn_number, params)."""
    pairs = extracted.select("session_id", "turn_number", F.explode(filled(F.col("params"))).alias("name", "value"))
    last = pairs.groupBy("session_id", "name").agg(
        F.max_by("value", F.struct("turn_number", "value")).alias("value")
    )
    return last.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("params")
    )
