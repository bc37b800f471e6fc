"""Epoch arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def epoch_ms(ts_ntz: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)


def epoch_us(ts_ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)


def floor_div(value: Column, size: int) -> Column:
    """Integer division that rounds down, also for negative values."""
    width = F.lit(size).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def ingestion_date(ms: Column) -> Column:
    return F.date_add(F.to_date(F.lit("1970-01-01")), floor_div(ms, DAY_MS).cast("int")).cast("string")


def ingestion_hour(ms: Column) -> Column:
    return F.pmod(floor_div(ms, HOUR_MS), F.lit(24)).cast("int")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def ns_to_ms(ns: Column) -> Column:
    return floor_div(F.coalesce(ns, F.lit(0)).cast("bigint"), 1_000_000)
