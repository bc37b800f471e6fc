"""Column functions that turn a span's tags into a classified step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.otlp import empty_map

# Operations that are never steps, by full name and by prefix.
DROPPED_OPERATIONS = (
    "session.resolve",
    "session.save_user_message",
    "session.load_context",
    "session.merge_context",
    "chat.conversational",
    "get_or_create_collection knowledge_base",
)
DROPPED_PREFIXES = ("session.turn.", "GET /api/sessions", "POST /api/sessions")

STEP_KINDS = ("ENTRY", "PLAN", "AGENT", "REASON", "RETRIEVE", "TOOL")


def is_dropped(operation: Column) -> Column:
    name = F.coalesce(operation, F.lit(""))
    dropped = name.isin(*DROPPED_OPERATIONS)
    for prefix in DROPPED_PREFIXES:
        dropped = dropped | name.startswith(prefix)
    return dropped


def parse_tags(tags_json: Column) -> Column:
    """Tags JSON as a map; bad or missing JSON is an empty map."""
    return F.coalesce(F.from_json(tags_json, "map<string,string>"), empty_map())


def classify(tags: Column) -> Column:
    """(kind, sub) of a span, null when no rule matches. Rules test for a key, also with an empty value."""

    def has(key: str) -> Column:
        return F.map_contains_key(tags, key)

    def step(kind: str, sub: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), sub.alias("sub"))

    def named(key: str) -> Column:
        return F.when(has(key), tags[key]).otherwise(F.lit("unknown"))

    return (
        F.when(has("http.route"), step("ENTRY", tags["http.route"]))
        .when(tags["orchestration.type"] == "plan_execution", step("PLAN", F.lit("plan_execution")))
        .when(has("agent.name"), step("AGENT", named("agent.operation")))
        .when(has("gen_ai.system"), step("REASON", named("gen_ai.operation.name")))
        .when(has("db.system"), step("RETRIEVE", named("db.operation.name")))
        .when(has("rpc.system"), step("TOOL", F.lit("MCP")))
        .when(has("url.full") & has("http.request.method"), step("TOOL", F.lit("HTTP")))
    )


def safe_int(text: Column) -> Column:
    return text.try_cast("int")


def prefixed_json(tags: Column, prefix: str) -> Column:
    """The tags under a prefix as a JSON object without that prefix, null when there are none."""
    under = F.map_filter(tags, lambda k, v: F.startswith(k, F.lit(prefix)))
    plain = F.transform_keys(under, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
    return F.when(F.size(under) > 0, F.to_json(plain))


def step_attributes(kind: Column, tags: Column) -> dict[str, Column]:
    """The typed columns each kind of step carries; null for the other kinds."""

    def when(of: str, value: Column) -> Column:
        return F.when(kind == of, value)

    return {
        "method": when("ENTRY", tags["http.request.method"]),
        "agent_name": when("AGENT", tags["agent.name"]),
        "model": when("REASON", tags["gen_ai.request.model"]),
        "input_tokens": when("REASON", safe_int(tags["gen_ai.usage.input_tokens"])),
        "output_tokens": when("REASON", safe_int(tags["gen_ai.usage.output_tokens"])),
        "collection": when("RETRIEVE", tags["db.collection.name"]),
        "query_text": when("RETRIEVE", tags["db.query.text"]),
        "returned_rows": when("RETRIEVE", safe_int(tags["db.response.returned_rows"])),
        "rpc_method": when("TOOL", tags["rpc.method"]),
        "url": when("TOOL", tags["url.full"]),
        "status_code": when("TOOL", tags["http.response.status_code"]),
        "context": F.when(kind == "AGENT", prefixed_json(tags, "agent.parameter."))
        .when(kind == "REASON", tags["gen_ai.prompt.system"])
        .when(kind == "TOOL", prefixed_json(tags, "tool.parameter.")),
        "prompt": F.when(kind == "REASON", tags["gen_ai.prompt.user"]).when(kind == "RETRIEVE", tags["db.query.text"]),
        "response": F.when(kind == "REASON", tags["gen_ai.response.content"]).when(kind == "TOOL", tags["tool.response"]),
        "node_id": when("REASON", tags["app.inference.node_id"]),
    }


def user_message(kind: Column, tags: Column) -> Column:
    """The request text an entry span may carry (optional; see the README on judge context)."""
    return F.when(kind == "ENTRY", tags["orchestration.input.user_message"])


def estimated_output_tokens(tokens: Column, text: Column) -> Column:
    """Reported output tokens, else twice the number of words."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))
    return F.coalesce(tokens, words * 2)


def estimated_input_tokens(tokens: Column, text: Column) -> Column:
    """Reported input tokens, else a quarter of the characters."""
    return F.coalesce(tokens, F.call_function("div", F.length(F.coalesce(text, F.lit(""))), F.lit(4)).cast("int"))


def stored_text(text: Column, limit: int = 2000) -> Column:
    return F.substring(text, 1, limit)
