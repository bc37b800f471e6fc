"""Column functions over decoded OTLP messages: ids, attribute lists, links, warnings, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute value fields, in order of precedence.
SCALAR_FIELDS = ("stringValue", "intValue", "doubleValue", "boolValue")
NESTED_FIELDS = ("arrayValue", "kvlistValue")
# Status codes, and the words that mark a span event as a warning.
STATUS_NAMES = {0: "UNSET", 1: "OK", 2: "ERROR"}
WARNING_WORDS = ("warn", "exception", "error")
MESSAGE_ATTRIBUTES = ("exception.message", "message")


def normalise_id(raw: Column) -> Column:
    """Hex ids stay, base64 ids become hex, anything else is unchanged; null is ''."""
    decoded = F.lower(F.hex(F.try_to_binary(raw, F.lit("base64"))))
    return F.when(raw.isNull() | (raw == ""), F.lit("")).when(
        raw.rlike("^[0-9a-fA-F]+$"), raw
    ).otherwise(F.coalesce(decoded, raw))


def attribute_text(value: Column) -> Column:
    """Text of one attribute value: the first scalar field, else (when that is empty) a nested value as JSON."""
    scalar = F.coalesce(*[value[field] for field in SCALAR_FIELDS])
    nested = [F.nullif(value[field], F.lit("")) for field in NESTED_FIELDS]
    return F.coalesce(F.nullif(scalar, F.lit("")), *nested, F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def first_value(value: Column) -> Column:
    """Text of whichever field of an attribute value comes first."""
    return F.coalesce(F.try_element_at(F.map_values(value), F.lit(1)), F.lit(""))


def _last_wins(entries: Column) -> Column:
    """Entries -> map where a repeated key keeps its last value, whatever the session's map policy."""

    def without_earlier(all_entries: Column) -> Column:
        kept = F.filter(
            all_entries,
            lambda e, i: ~F.exists(
                F.slice(all_entries, i + 2, F.size(all_entries)), lambda later: later["key"] == e["key"]
            ),
        )
        unique = F.size(F.array_distinct(all_entries["key"])) == F.size(all_entries)
        return F.map_from_entries(F.when(unique, all_entries).otherwise(kept))

    return once(entries, without_earlier)


def _entries(attributes: Column) -> Column:
    return F.transform(
        attributes,
        lambda a: F.struct(F.coalesce(a["key"], F.lit("")).alias("key"), attribute_text(a["value"]).alias("value")),
    )


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def attribute_map(attributes: Column) -> Column:
    return F.coalesce(_last_wins(_entries(attributes)), empty_map())


def link_map(links: Column) -> Column:
    """Span links as one flat map: link.{i}.trace_id, link.{i}.span_id, link.{i}.<attribute>."""

    def entries(link: Column, i: Column) -> Column:
        prefix = F.concat(F.lit("link."), i.cast("string"), F.lit("."))

        def entry(name: Column, value: Column) -> Column:
            return F.struct(F.concat(prefix, name).alias("key"), value.alias("value"))

        return F.concat(
            F.array(
                entry(F.lit("trace_id"), normalise_id(link["traceId"])),
                entry(F.lit("span_id"), normalise_id(link["spanId"])),
            ),
            F.coalesce(
                F.transform(
                    link["attributes"],
                    lambda a: entry(F.coalesce(a["key"], F.lit("")), first_value(a["value"])),
                ),
                F.array().cast("array<struct<key:string,value:string>>"),
            ),
        )

    return F.coalesce(_last_wins(F.flatten(F.transform(links, entries))), empty_map())


def _lookup(attributes: Column, key: str) -> Column:
    """Non-empty text of the last attribute with this key, else null."""
    found = F.filter(attributes, lambda a: a["key"] == key)
    return F.nullif(attribute_text(F.try_element_at(found, F.lit(-1))["value"]), F.lit(""))


def warning_text(events: Column, status: Column) -> Column:
    """Messages of warning-like events, then the message of an error status, joined by '; '."""

    def is_warning(event: Column) -> Column:
        name = F.lower(F.coalesce(event["name"], F.lit("")))
        hit = name.contains(WARNING_WORDS[0])
        for word in WARNING_WORDS[1:]:
            hit = hit | name.contains(word)
        return hit

    messages = F.transform(
        F.filter(events, is_warning),
        lambda e: F.coalesce(
            *[_lookup(e["attributes"], key) for key in MESSAGE_ATTRIBUTES], F.lower(F.coalesce(e["name"], F.lit("")))
        ),
    )
    nothing = F.array().cast("array<string>")
    failed = (status["code"] == 2) & (F.coalesce(status["message"], F.lit("")) != "")
    return F.array_join(
        F.concat(
            F.coalesce(messages, nothing),
            F.when(failed, F.array(status["message"])).otherwise(nothing),
        ),
        "; ",
    )


def status_name(code: Column) -> Column:
    named = F.lit(STATUS_NAMES[0])
    for value, name in STATUS_NAMES.items():
        if value:
            named = F.when(code == value, F.lit(name)).otherwise(named)
    return named


def nanos(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def span_duration(start_ns: Column, end_ns: Column) -> Column:
    return F.when((start_ns != 0) & (end_ns != 0), end_ns - start_ns).otherwise(F.lit(0).cast("bigint"))


def service_name(resource_attributes: Column) -> Column:
    named = F.filter(resource_attributes, lambda a: a["key"] == "service.name")
    return F.coalesce(first_value(F.try_element_at(named, F.lit(1))["value"]), F.lit(""))
