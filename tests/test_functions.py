import json

from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import drift, infra, judge, otlp, spans


def test_ids(column):
    rows = [("0AfF",), ("AAECAw==",), ("not an id!",), ("",), (None,)]
    assert column(otlp.normalise_id, "x STRING", rows) == ["0AfF", "00010203", "not an id!", "", ""]


def test_attributes_keep_last_of_repeated_keys_and_precedence(column):
    ddl = f"a ARRAY<{schemas.OTLP_ATTRIBUTE}>"
    attributes = [
        ("k", {"stringValue": "first"}), ("n", {"intValue": "7", "stringValue": "s"}), ("k", {"stringValue": "last"}),
        ("l", {"stringValue": "", "arrayValue": "[1]"}), ("e", {}),
    ]
    got = column(otlp.attribute_map, ddl, [(attributes,), ([],), (None,)])
    assert got == [{"k": "last", "n": "s", "l": "[1]", "e": ""}, {}, {}]


def test_classification_cases(column):
    cases = [
        ('{"http.route":""}', ("ENTRY", "")),
        ('{"orchestration.type":"plan_execution"}', ("PLAN", "plan_execution")),
        ('{"orchestration.type":"session_turn"}', None),
        ('{"agent.name":"x"}', ("AGENT", "unknown")),
        ('{"agent.name":"x","gen_ai.system":"o"}', ("AGENT", "unknown")),
        ('{"gen_ai.system":"o","gen_ai.operation.name":"chat"}', ("REASON", "chat")),
        ('{"db.system":"c","db.operation.name":"findNearest"}', ("RETRIEVE", "findNearest")),
        ('{"rpc.system":"mcp"}', ("TOOL", "MCP")),
        ('{"url.full":"u","http.request.method":"GET"}', ("TOOL", "HTTP")),
        ('{"url.full":"u"}', None), ("{}", None), ("{bad", None), (None, None),
    ]
    got = column(lambda t: spans.classify(spans.parse_tags(t)), "t STRING", [(c,) for c, _ in cases])
    assert [tuple(g) if g else None for g in got] == [want for _, want in cases]


def test_dropped_operations(column):
    names = [("session.turn.3",), ("GET /api/sessions/1",), ("chat.conversational",), ("chat",), (None,)]
    assert column(spans.is_dropped, "n STRING", names) == [True, True, True, False, False]


def test_safe_int(column):
    assert column(spans.safe_int, "x STRING", [("12",), (" 12 ",), ("12.0",), ("",), (None,)]) == [12, 12, None, None, None]


def test_prefixed_json(column):
    def fn(t):
        return spans.prefixed_json(spans.parse_tags(t), "tool.parameter.")

    got = column(fn, "t STRING", [('{"tool.parameter.a":"1","x":"2"}',), ('{"x":"2"}',)])
    assert json.loads(got[0]) == {"a": "1"} and got[1] is None


def test_contention(column):
    eight = ", ".join(f"c{i} DOUBLE" for i in range(8))
    assert column(infra.contention_index, eight, [(80.0, 60.0, 70.0, 81.0, 90.0, 1.0, 9000.0, 9000.0)]) == [0.825]
    five = ", ".join(f"c{i} DOUBLE" for i in range(5))
    assert round(column(infra.queue_contention_index, five, [(80.0, 60.0, 70.0, 250.0, 90.0)])[0], 9) == 0.675


def test_badges(column):
    assert column(infra.health_badge, "c DOUBLE", [(0.71,), (0.7,), (0.4,)]) == ["DEGRADED", "WARNING", "HEALTHY"]


def test_judge_replies(column):
    plain = '{"completeness":4,"coherence":5,"hallucination":3,"groundedness":4,"relevance":4}'
    rows = [(plain,), (f"```json\n{plain}\n```",), ('{"completeness":9,"coherence":0}',),
            ('{"completeness":4.7,"overall":2.345}',), ("not json",), (None,)]
    got = column(judge.parse_scores, "r STRING", rows)
    scores = [tuple(g[d] for d in judge.DIMENSIONS) + (g["overall"],) for g in got]
    assert scores[0] == scores[1] == (4, 5, 3, 4, 4, 4.0)
    assert scores[2] == (5, 1, 3, 3, 3, 3.0)
    assert scores[3][:5] == (4, 3, 3, 3, 3) and abs(scores[3][5] - 2.345) < 0.006
    assert scores[4] == scores[5] == (0, 0, 0, 0, 0, 0.0)
    assert got[4]["explanation"].startswith("eval_error")


def test_intent_replies(column):
    rows = [('{"intent":"a"}',), ('```json\n{"intent":"b"}\n```',), ('so {"intent":"c"} it is',), ("no",), ("x {bad} y",)]
    assert [m["intent"] for m in column(judge.parse_intent, "r STRING", rows)] == ["a", "b", "c", "plan_trip", "plan_trip"]


def test_parameters(column):
    ddl = "p MAP<STRING, STRING>"
    rows = [({"destination": "Rome", "budget": ""},), ({},)]
    assert column(judge.missing_parameters, ddl, rows) == [[], ["destination"]]
    full = column(judge.with_defaults, ddl, rows)
    assert full[0]["destination"] == "Rome" and full[0]["budget"] == "mid-range" and full[1] == judge.DEFAULT_PARAMETERS


def test_token_estimates(column):
    rows = [(None, "one two  three"), (9, "x"), (None, "  "), (None, None)]
    assert column(spans.estimated_output_tokens, "n INT, t STRING", rows) == [6, 9, 0, 0]
    assert column(spans.estimated_input_tokens, "n INT, t STRING", rows) == [3, 9, 0, 0]


def test_verdict_table(column):
    ddl = "q INT, d INT, g INT, n INT"
    rows = [(1, 1, 1, 0), (1, 1, 0, 1), (1, 1, 0, 0), (0, 1, 1, 1), (1, 0, 1, 1), (0, 0, 1, 1)]
    assert column(drift.verdict, ddl, rows) == [
        "gpu_induced_degradation", "network_induced_degradation", "app_layer_degradation",
        "trajectory_drift_no_quality_impact", "quality_drop_stable_trajectory", "normal",
    ]


def test_mutation_explanation(column):
    got = column(drift.mutation_explanation, "s DOUBLE, c DOUBLE, r DOUBLE", [(-2.0, -1.0, 0.6), (1.0, 0.0, 0.5)])
    assert got == ["2 fewer steps (truncated reasoning), 1 fewer LLM calls, 0.6 avg retries (fallback churn)", ""]


def test_warnings(column):
    attribute = f"ARRAY<{schemas.OTLP_ATTRIBUTE}>"
    ddl = f"e ARRAY<STRUCT<name: STRING, attributes: {attribute}>>, s STRUCT<code: INT, message: STRING>"
    rows = [
        ([("Exception", [("exception.message", {"stringValue": "boom"})]), ("info", []), ("WARN x", [])], (2, "down")),
        (None, (1, "fine")),
        ([("error", [("message", {"stringValue": "m"})])], None),
    ]
    assert column(otlp.warning_text, ddl, rows) == ["boom; warn x; down", "", "m"]


def test_status_and_service(column):
    assert column(otlp.status_name, "c INT", [(0,), (1,), (2,), (9,), (None,)]) == ["UNSET", "OK", "ERROR", "UNSET", "UNSET"]
    ddl = f"a ARRAY<{schemas.OTLP_ATTRIBUTE}>"
    rows = [([("x", {"stringValue": "1"}), ("service.name", {"stringValue": "svc"})],), (None,)]
    assert column(otlp.service_name, ddl, rows) == ["svc", ""]


def test_percent_guards_zero(column):
    assert column(lambda a, b: infra.percent_of(a, b), "a DOUBLE, b DOUBLE", [(1.0, 0.0), (1.0, 3.0)]) == [0.0, 33.33]


def test_prompt_fields(spark):
    row = spark.range(1).select(*[F.lit(f).alias(f) for f in judge.CONTEXT_FIELDS]).select(judge.prompt_text()).first()[0]
    assert row == judge.PROMPT_TEMPLATE.format(**{f: f for f in judge.CONTEXT_FIELDS})
