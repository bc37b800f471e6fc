"""The general-purpose test tables read as agent traces, metrics, scores and sessions.

``events`` stands for spans and metric samples: four consecutive events are one trace, the event type gives the kind
of step, the number k in ``props`` varies everything else. Expressions are kept to SQL that Spark and DuckDB read alike,
so the oracle queries can state the same inputs. Metric values are multiples of powers of two: their sums are exact in
any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.timeparts import epoch_us

BROKEN_MESSAGE_K = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        epoch_us(F.col("ts")).alias("us"),
    )


def _text(expression: str) -> str:
    return f"cast({expression} as string)"


BLOCK = "cast(floor(event_id / 4) as bigint)"
TRACE_ID = f"lpad(lower(hex({BLOCK})), 32, '0')"


def span_id_of(event: str) -> str:
    return f"lpad(lower(hex({event} + 1)), 16, '0')"


SESSION_ID = f"case when k % 25 = 3 then '' else 's' || {_text('user_id')} end"
START_NS = "case when k = 99 then cast(0 as bigint) else us * 1000 end"
DURATION_NS = "case when k = 99 then cast(0 as bigint) else cast(floor(value * 100) as bigint) * 1000000 end"

K = _text("k")
# (attribute, value) per kind of step; every value is a text expression
ATTRIBUTES: dict[str, list[tuple[str, str]]] = {
    "none": [("note", "'n'")],
    "entry": [
        ("http.route", f"'/api/' || {K}"),
        ("http.request.method", "'POST'"),
        ("orchestration.input.user_message", f"'plan ' || {K}"),
    ],
    "agent": [
        ("agent.name", f"'agent' || {_text('k % 5')}"),
        ("agent.operation", "'run'"),
        ("agent.parameter.city", f"'c' || {_text('k % 7')}"),
    ],
    "reason": [
        ("gen_ai.system", "'local'"),
        ("gen_ai.operation.name", "'chat'"),
        ("gen_ai.request.model", f"'m' || {_text('k % 3')}"),
        ("gen_ai.agent.name", f"'agent' || {_text('k % 5')}"),
        ("gen_ai.usage.input_tokens", _text("k * 10")),
        ("gen_ai.usage.output_tokens", f"case when k % 7 = 0 then 'x' else {_text('k * 3')} end"),
        ("gen_ai.prompt.user", f"'question ' || {K}"),
        ("gen_ai.response.content", f"case when k % 11 = 0 then '' else 'answer ' || {K} end"),
        ("app.inference.node_id", f"case when k % 4 = 0 then '' else 'node-' || {_text('k % 4')} end"),
        ("retry.count", _text("k % 3")),
    ],
    "rpc": [
        ("rpc.system", "'mcp'"),
        ("rpc.method", f"'tool' || {_text('k % 5')}"),
        ("tool.parameter.q", f"'q' || {K}"),
        ("tool.response", f"'result ' || {K}"),
    ],
    "http": [
        ("url.full", f"'http://t/' || {_text('k % 5')}"),
        ("http.request.method", "'GET'"),
        ("http.response.status_code", "'200'"),
    ],
    "plan": [("orchestration.type", "'plan_execution'")],
    "retrieve": [
        ("db.system", "'vec'"),
        ("db.operation.name", "'findNearest'"),
        ("db.collection.name", f"'col' || {_text('k % 4')}"),
        ("db.query.text", f"'find ' || {K}"),
        ("db.response.returned_rows", _text("k % 6")),
    ],
}
INTEGER_ATTRIBUTES = {"gen_ai.usage.input_tokens", "db.response.returned_rows", "retry.count"}

SHAPE = """case when k % 10 = 1 then 'none' when event_type = 'signup' then 'entry' when event_type = 'view' then 'agent'
when event_type = 'click' then 'reason' when event_type = 'purchase' and k % 2 = 0 then 'rpc'
when event_type = 'purchase' then 'http' when k % 3 = 0 then 'plan' else 'retrieve' end"""


def _by_shape(render) -> str:
    cases = " ".join(
        f"when '{shape}' then {render([('session.id', 'session_id'), *pairs])}" for shape, pairs in ATTRIBUTES.items()
    )
    return f"case shape {cases} end"


def _tags_json(pairs: list[tuple[str, str]]) -> str:
    fields = " || ',' || ".join(f"'\"{key}\":\"' || ({value}) || '\"'" for key, value in pairs)
    return f"'{{' || {fields} || '}}'"


def _otlp_attributes(pairs: list[tuple[str, str]]) -> str:
    def one(key: str, value: str) -> str:
        kind = "intValue" if key in INTEGER_ATTRIBUTES else "stringValue"
        return f"'{{\"key\":\"{key}\",\"value\":{{\"{kind}\":\"' || ({value}) || '\"}}}}'"

    return "'[' || " + " || ',' || ".join(one(k, v) for k, v in pairs) + " || ']'"


# Columns of a span by name; later ones use shape and session_id, which come first.
SPAN_KEYS = {
    "trace_id": TRACE_ID,
    "session_id": SESSION_ID,
    "span_id": span_id_of("event_id"),
    "parent_span_id": f"""case when event_id % 4 = 0 then '' when event_id % 4 = 3 then {span_id_of('(event_id - 1)')}
else {span_id_of('(event_id - event_id % 4)')} end""",
    "operation_name": f"case when k % 10 = 0 then 'session.turn.' || {K} else event_type || ' ' || {_text('k % 5')} end",
    "service_name": f"'svc' || {_text('user_id % 3')}",
    "start_time_unix_nano": START_NS,
    "end_time_unix_nano": f"({START_NS}) + ({DURATION_NS})",
    "duration_ns": DURATION_NS,
    "status_code": "case when k % 3 = 2 then 'ERROR' when k % 3 = 1 then 'OK' else 'UNSET' end",
    "status_message": f"case when k % 3 = 2 then 'failed ' || {K} else '' end",
    "warning": f"""concat_ws('; ', case when k % 5 = 0 then 'boom ' || {K} when k % 5 = 1 then 'retry_warning' end,
case when k % 3 = 2 then 'failed ' || {K} end)""",
    "shape": SHAPE,
}
LINKED = "k % 4 = 2"
REFERENCES = """case when k % 4 = 2 then '{"link.0.trace_id":"' || trace_id || '","link.0.span_id":"' || span_id
|| '","link.0.kind":"retry"}' else '{}' end"""
TAGS = _by_shape(_tags_json)
BROKEN_TAGS = f"case when k = 11 then '{{bad' else {TAGS} end"
SPAN_COLUMNS = (
    "trace_id",
    "session_id",
    "span_id",
    "parent_span_id",
    "operation_name",
    "service_name",
    "start_time_unix_nano",
    "end_time_unix_nano",
    "duration_ns",
    "status_code",
    "status_message",
    "warning",
)


def _keyed(events: DataFrame) -> DataFrame:
    return base_events(events).selectExpr("*", *[f"{e} as {name}" for name, e in SPAN_KEYS.items()])


def spans(events: DataFrame) -> DataFrame:
    """The span table, with one broken tags text among each hundred."""
    return _keyed(events).selectExpr(
        *SPAN_COLUMNS, f"{BROKEN_TAGS} as tags", f"{REFERENCES} as `references`", "timestamp_micros(us) as ingested_at"
    )


NAMELESS = "k % 3 = 1"


def otlp_messages(events: DataFrame, nameless: str = "false") -> DataFrame:
    """Spans as OTLP message texts: ids partly base64, some messages cut off; ``nameless`` spans have no trace id."""

    def identifier(column: str) -> str:
        return f"case when event_id % 2 = 1 and {column} <> '' then base64(unhex({column})) else {column} end"

    text = f"""'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"'
|| service_name || '"}}}}]}},"scopeSpans":[{{"spans":[{{"traceId":"' || case when {nameless} then '' else {identifier('trace_id')} end
|| '","spanId":"' || {identifier('span_id')} || '","parentSpanId":"' || {identifier('parent_span_id')}
|| '","name":"' || operation_name || '","startTimeUnixNano":"' || {_text('start_time_unix_nano')}
|| '","endTimeUnixNano":"' || {_text('end_time_unix_nano')} || '","attributes":' || {_by_shape(_otlp_attributes)}
|| ',"events":' || case
   when k % 5 = 0 then '[{{"name":"Exception","attributes":[{{"key":"exception.message","value":{{"stringValue":"boom '
     || {K} || '"}}}}]}}]'
   when k % 5 = 1 then '[{{"name":"retry_WARNING","attributes":[]}}]' else '[{{"name":"info","attributes":[]}}]' end
|| ',"links":' || case when {LINKED} then '[{{"traceId":"' || trace_id || '","spanId":"' || span_id
   || '","attributes":[{{"key":"kind","value":{{"stringValue":"retry"}}}}]}}]' else '[]' end
|| ',"status":{{"code":' || {_text('k % 3')} || ',"message":"' || status_message || '"}}}}]}}]}}]}}'"""
    return (
        _keyed(events)
        .selectExpr("event_id", "k", f"{text} as value")
        .selectExpr("event_id", f"case when k = {BROKEN_MESSAGE_K} then substring(value, 1, 60) else value end as value")
    )


GPU_FIELDS = {
    "timestamp_ms": "cast(floor(us / 1000) as bigint)",
    "node_id": f"'node-' || {_text('user_id % 4')}",
    "gpu_id": f"'gpu-' || {_text('cast(floor(user_id / 4) as bigint) % 2')}",
    "gpu_uuid": f"'GPU-' || {_text('user_id % 8')}",
    "gpu_utilization": "cast(least(floor(value / 4), 100) as double)",
    "memory_controller_util": "cast(least(floor(value / 5), 100) as double)",
    "memory_used_pct": "cast(least(floor(value / 4), 190) as double) / 2",
    "temperature_c": "cast(30 + floor(value / 8) as double)",
    "power_draw_pct": "cast(least(floor(value / 3), 190) as double) / 2",
    "clock_sm_mhz": "cast(1200 + k as double)",
    "clock_mem_mhz": "cast(5000 + k as double)",
    "throttle_active": "cast(case when k % 9 = 0 then 1 else 0 end as int)",
    "pcie_tx_mbps": "cast(k * 100 as double)",
    "pcie_rx_mbps": "cast(k * 50 as double)",
    "ecc_errors_total": "cast(k % 2 as int)",
    "contention_index": "cast(least(floor(value * 4), 512) as double) / 512",
}
NETWORK_FIELDS = {
    "timestamp_ms": GPU_FIELDS["timestamp_ms"],
    "node_id": GPU_FIELDS["node_id"],
    "peer_node_id": f"'node-' || {_text('(user_id + 1) % 4')}",
    "inter_node_latency_us": "case when k % 7 = 0 then cast(-1 as double) else cast(floor(value * 8) as double) end",
    "throughput_tx_mbps": "cast(k * 4 as double)",
    "throughput_rx_mbps": "cast(k * 2 as double)",
    "packet_drop_count": "cast(case when k % 37 = 5 then 1 else 0 end as int)",
    "tcp_retransmit_count": "cast(k % 4 as int)",
}


def _fields(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    return base_events(events).selectExpr(*[f"{e} as {name}" for name, e in fields.items()])


def gpu_samples(events: DataFrame) -> DataFrame:
    return _fields(events, GPU_FIELDS)


def network_samples(events: DataFrame) -> DataFrame:
    return _fields(events, NETWORK_FIELDS)


# Scores of a trace, from its number; traces with block % 13 = 5 have none.
QUALITY_FIELDS = {
    "trace_id": TRACE_ID,
    "session_id": "''",
    "completeness": f"case when {BLOCK} % 11 = 0 then 0e0 else cast(1 + {BLOCK} % 5 as double) end",
    "coherence": f"case when {BLOCK} % 11 = 0 then 0e0 else cast(1 + {BLOCK} % 4 as double) end",
    "hallucination": f"case when {BLOCK} % 11 = 0 then 0e0 else cast(1 + {BLOCK} % 3 as double) end",
    "groundedness": f"case when {BLOCK} % 11 = 0 then 0e0 else cast(5 - {BLOCK} % 5 as double) end",
    "relevance": f"case when {BLOCK} % 11 = 0 then 0e0 else 3e0 end",
    "overall": f"case when {BLOCK} % 11 = 0 then 0e0 else cast(4 + {BLOCK} % 17 as double) / 4 end",
    "explanation": f"'e' || {_text(BLOCK + ' % 3')}",
    "eval_model": "'table'",
    "eval_timestamp_ms": "cast(floor(us / 1000) as bigint)",
    "start_ts_ms": "cast(floor(us / 1000) as bigint)",
    "end_ts_ms": "cast(floor(us / 1000) as bigint)",
}
SCORED = f"event_id % 4 = 0 and {BLOCK} % 13 <> 5"


def quality_scores(events: DataFrame) -> DataFrame:
    return _fields(events.where(SCORED), QUALITY_FIELDS)


# Judge replies of every shape: plain, fenced, without overall, with missing or odd scores, not JSON.
REPLY = f"""case {BLOCK} % 7
when 0 then 'not json'
when 1 then '```json' || chr(10) || '{{"completeness":' || {_text('k % 7')} || ',"coherence":5,"hallucination":3,"groundedness":4,"relevance":4}}' || chr(10) || '```'
when 2 then '```' || chr(10) || '{{"completeness":4,"coherence":' || {_text('k % 6')} || '}}' || chr(10) || '```'
when 3 then '{{"completeness":4.7,"overall":' || {_text('k % 5')} || '.25,"explanation":"ok ' || {K} || '"}}'
when 4 then '{{"completeness":"bad","overall":3}}'
when 5 then '{{"completeness":9,"coherence":0,"explanation":"x"}}'
else '{{"completeness":' || {_text('k % 5 + 1')} || ',"coherence":2,"hallucination":3,"groundedness":4,"relevance":5,"overall":"none"}}' end"""

INTENT_REPLY = f"""case {BLOCK} % 5
when 0 then '{{"intent":"plan_trip","destination":"d' || {K} || '"}}'
when 1 then '```json' || chr(10) || '{{"intent":"modify_plan","budget":"' || {K} || '"}}' || chr(10) || '```'
when 2 then 'Sure, here it is: {{"intent":"proceed","origin":"o' || {K} || '"}} as asked'
when 3 then 'no idea'
else 'broken {{"intent": }} text' end"""


def replies(events: DataFrame) -> DataFrame:
    """One judge reply and one intent reply per event."""
    return base_events(events).selectExpr("event_id", "k", f"{REPLY} as reply", f"{INTENT_REPLY} as intent_reply")


def messages(conversations: DataFrame) -> DataFrame:
    """Chat messages with a timestamp that grows with the turn."""
    return conversations.selectExpr(
        "cast(conv_id as string) as session_id",
        "cast(turn as int) as turn_number",
        "role",
        "text as content",
        "lpad(cast(conv_id % 7 * 100 + turn as string), 8, '0') as timestamp",
        "'{}' as metadata",
    )


# Six files of traces in order of time; one trace in 17 lands a file late.
LANDED_PART = """cast(least(greatest(floor((start_ts_ms - 1704067200000) / 432000000), 0), 5)
+ case when start_ts_ms % 17 = 3 then 1 else 0 end as int)"""


def counters(lineitem: DataFrame) -> DataFrame:
    """Cumulative interface counters per node, one sample per order line."""
    return lineitem.selectExpr(
        "'node-' || cast(l_suppkey % 50 as string) as node_id",
        "cast(l_orderkey * 8000 + l_linenumber * 1000 as bigint) as ts_ms",
        "cast(l_orderkey * 1000000 + l_partkey * 100 as bigint) as tx_bytes",
        "cast(l_orderkey * 500000 + l_suppkey * 100 as bigint) as rx_bytes",
        "cast(l_partkey as bigint) as drops",
        "cast(l_suppkey as bigint) as retransmits",
    )


def incidents(orders: DataFrame) -> DataFrame:
    """Incident intervals of very different length, many of them overlapping."""
    return orders.selectExpr(
        "'incident ' || cast(o_orderkey as string) as name",
        "1704067200000 + cast(o_orderkey * 7919 % 2592000000 as bigint) as start_ms",
        "1704067200000 + cast(o_orderkey * 7919 % 2592000000 as bigint) + cast(o_custkey * 977 as bigint) as end_ms",
        "'node-' || cast(o_custkey % 9 as string) as node_id",
        "cast(o_orderkey % 8 as double) / 8 as intensity",
    )
