"""Column functions around the answer judge: its prompt, its reply, and the intent reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("completeness", "coherence", "hallucination", "groundedness", "relevance")

# Placeholders for missing context, and the lengths at which quoted text is cut.
NO_REQUEST = "(not captured)"
NO_REASONING = "(no reasoning)"
NO_EVIDENCE = "(no evidence)"
NO_RESPONSE = "(no response)"
PROMPT_CUT = 200
QUERY_CUT = 100
TOOL_CUT = 300
# Score range and the score of a missing dimension.
SCORE_MIN, SCORE_MAX, SCORE_DEFAULT = 1, 5, 3

# Default judge instruction; pass another with the same four fields to use your own.
PROMPT_TEMPLATE = (
    "Rate the agent's answer on five dimensions, each an integer from 1 to 5:\n"
    "completeness, coherence, hallucination (5 means none), groundedness, relevance.\n\n"
    "USER REQUEST: {user_request}\n"
    "REASONING CHAIN: {reasoning_chain}\n"
    "EVIDENCE: {evidence}\n"
    "FINAL RESPONSE: {final_response}\n\n"
    "Answer with one JSON object holding the five scores, overall (number) and explanation (text).\n"
)
CONTEXT_FIELDS = ("user_request", "reasoning_chain", "evidence", "final_response")

# Parameters a request must have, and the ones filled in when empty.
REQUIRED_PARAMETERS = ("destination",)
DEFAULT_PARAMETERS = {
    "origin": "nearest major airport",
    "departure_date": "2026-07-15",
    "return_date": "2026-07-22",
    "passengers": "1",
    "interests": "sightseeing, local cuisine, culture",
    "budget": "mid-range",
}
DEFAULT_INTENT = "plan_trip"


def _or(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def reasoning_line(kind: Column, model: Column, prompt: Column, agent_name: Column) -> Column:
    """One line of the reasoning chain; null for steps that add none."""
    quoted = F.substring(F.coalesce(prompt, F.lit("")), 1, PROMPT_CUT)
    return F.when(kind == "REASON", F.concat(F.lit("[LLM:"), _or(model, "unknown"), F.lit("]: "), quoted)).when(
        kind == "AGENT", F.concat(F.lit("[Agent:"), _or(agent_name, "unknown"), F.lit("]"))
    )


def evidence_line(
    kind: Column, collection: Column, query_text: Column, rpc_method: Column, url: Column, response: Column
) -> Column:
    """One line of evidence; null for steps that add none."""
    empty = F.lit("")
    query = F.substring(F.coalesce(query_text, empty), 1, QUERY_CUT)
    tool = F.coalesce(F.nullif(rpc_method, empty), F.nullif(url, empty), F.lit("unknown"))
    answer = F.substring(F.coalesce(response, empty), 1, TOOL_CUT)
    return F.when(
        kind == "RETRIEVE",
        F.concat(F.lit("[RAG:"), F.coalesce(collection, empty), F.lit("] query='"), query, F.lit("'")),
    ).when(kind == "TOOL", F.concat(F.lit("[Tool:"), tool, F.lit("] → "), answer))


def prompt_text(template: str = PROMPT_TEMPLATE) -> Column:
    """The judge prompt from the four context columns."""
    pieces: list[Column] = []
    rest = template
    for field in CONTEXT_FIELDS:
        before, _, rest = rest.partition("{" + field + "}")
        pieces += [F.lit(before), F.col(field)]
    return F.concat(*pieces, F.lit(rest))


def unfenced(reply: Column) -> Column:
    """The text inside the first code fence, or the whole reply when there is none."""
    after_json_fence = F.split_part(reply, F.lit("```json"), F.lit(2))
    after_fence = F.split_part(reply, F.lit("```"), F.lit(2))
    return F.trim(
        F.when(reply.contains("```json"), F.split_part(after_json_fence, F.lit("```"), F.lit(1)))
        .when(reply.contains("```"), after_fence)
        .otherwise(reply)
    )


def parse_scores(reply: Column) -> Column:
    """Scores from a judge's reply; an unreadable reply gives the all-zero error row."""
    raw = F.from_json(unfenced(reply), "map<string,string>")
    numbers = {d: raw[d].try_cast("double") for d in DIMENSIONS}
    unreadable = raw.isNull()
    for d in DIMENSIONS:
        unreadable = unreadable | (F.map_contains_key(raw, d) & numbers[d].isNull())
    overall = raw["overall"].try_cast("double")
    unreadable = F.coalesce(unreadable | (F.map_contains_key(raw, "overall") & overall.isNull()), F.lit(True))

    scores = {}
    for d in DIMENSIONS:
        # Bounded before the cast: a reply can hold any number. The cast cuts the fraction off.
        bounded = F.greatest(F.least(numbers[d], F.lit(SCORE_MAX + 1.0)), F.lit(SCORE_MIN - 1.0))
        whole = F.when(F.map_contains_key(raw, d), bounded.cast("int")).otherwise(F.lit(SCORE_DEFAULT))
        scores[d] = F.greatest(F.least(whole, F.lit(SCORE_MAX)), F.lit(SCORE_MIN)).cast("double")
    total = scores[DIMENSIONS[0]]
    for d in DIMENSIONS[1:]:
        total = total + scores[d]
    mean = total / F.lit(float(len(DIMENSIONS)))
    given = F.map_contains_key(raw, "overall")

    def or_zero(value: Column) -> Column:
        return F.when(unreadable, F.lit(0.0)).otherwise(value)

    return F.struct(
        *[or_zero(scores[d]).alias(d) for d in DIMENSIONS],
        or_zero(F.round(F.when(given, overall).otherwise(mean), 2)).alias("overall"),
        F.when(unreadable, F.lit("eval_error: unreadable reply"))
        .otherwise(F.coalesce(raw["explanation"], F.lit("")))
        .alias("explanation"),
    )


def parse_intent(reply: Column) -> Column:
    """Intent map from a reply: whole text, else its first {...} part, else the default intent."""
    text = F.trim(reply)
    fenced = F.split_part(text, F.lit("```"), F.lit(2))
    body = F.when(
        text.startswith("```"),
        F.when(fenced.startswith("json"), F.substring(fenced, F.lit(5), F.length(fenced))).otherwise(fenced),
    ).otherwise(text)
    embedded = F.nullif(F.regexp_extract(body, r"(\{[^}]+\})", 1), F.lit(""))
    return F.coalesce(
        F.from_json(body, "map<string,string>"),
        F.from_json(embedded, "map<string,string>"),
        F.create_map(F.lit("intent"), F.lit(DEFAULT_INTENT)),
    )


def filled(parameters: Column) -> Column:
    """Only the parameters that have a value."""
    return F.map_filter(parameters, lambda k, v: F.coalesce(v, F.lit("")) != "")


def missing_parameters(parameters: Column, required: tuple[str, ...] = REQUIRED_PARAMETERS) -> Column:
    wanted = F.array(*[F.lit(name) for name in required])
    return F.array_except(wanted, F.map_keys(filled(parameters)))


def with_defaults(parameters: Column, defaults: dict[str, str] = DEFAULT_PARAMETERS) -> Column:
    """Parameters with every empty one replaced by its default where it has one."""
    given = filled(parameters)
    fallback = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    unused = F.map_filter(fallback, lambda k, v: ~F.map_contains_key(given, k))
    undefaulted = F.map_filter(
        parameters, lambda k, v: (F.coalesce(v, F.lit("")) != "") | ~F.map_contains_key(fallback, k)
    )
    return F.map_concat(undefaulted, unused)
