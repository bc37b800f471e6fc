import pytest
from times import T, message

from spanloom import schemas
from spanloom.operators.otlp import flatten, undecodable
from spanloom.operators.scoring import judge_contexts
from spanloom.operators.steps import agent_steps, call_graph, without_entry_reasoning
from spanloom.operators.trajectory import template_distribution, trajectories
from spanloom.options import StepOptions


def test_flatten_nested_and_broken(spark):
    texts = [
        message(
            {"traceId": "aa", "spanId": "01", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": 9,
             "attributes": [{"key": "session.id", "value": {"stringValue": "s1"}}], "status": {"code": 1}},
            {"traceId": "aa", "spanId": "02", "startTimeUnixNano": "0", "endTimeUnixNano": "9"},
        ),
        "{broken", "{}",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value STRING")
    rows = {r["span_id"]: r for r in flatten(df).collect()}
    assert set(rows) == {"01", "02"}
    assert rows["01"]["duration_ns"] == 4 and rows["01"]["session_id"] == "s1" and rows["01"]["status_code"] == "OK"
    assert rows["02"]["duration_ns"] == 0 and rows["02"]["tags"] == "{}" and rows["02"]["service_name"] == "svc"
    assert [r["value"] for r in undecodable(df).collect()] == ["{broken"]


def trace_a(step):
    return step(
        ("A", "e", "ENTRY", 0, {"end_ts_ms": T + 30_000}), ("A", "r0", "REASON", 1, {"parent_span_id": "e"}),
        ("A", "p", "PLAN", 2, {"parent_span_id": "e"}), ("A", "a", "AGENT", 3, {"parent_span_id": "p"}),
        ("A", "v", "RETRIEVE", 4), ("A", "r1", "REASON", 5, {"node_id": "node-1"}), ("A", "t", "TOOL", 6),
    )


def test_healthy_trace(step):
    row = trajectories(without_entry_reasoning(trace_a(step))).first()
    assert row["step_sequence"] == "ENTRY|PLAN|AGENT|RETRIEVE|REASON|TOOL"
    assert row["trajectory_signature"] == "tpl_ef8de1780e39"
    counts = ("step_count", "llm_call_count", "tool_call_count", "retrieve_count", "agent_count", "retry_count")
    assert [row[c] for c in counts] == [6, 1, 1, 1, 1, 0]
    assert row["total_duration_ms"] == 30_000 and row["error_count"] == 0


def test_orphan_and_truncated_traces(step):
    rows = {r["trace_id"]: r for r in trajectories(step(
        ("B", "1", "AGENT", 0, {"session_id": ""}), ("B", "2", "RETRIEVE", 1), ("B", "3", "REASON", 2),
        ("C", "1", "ENTRY", 0),
    )).collect()}
    assert rows["B"]["trajectory_signature"] == "tpl_844a9153aea9" and rows["B"]["session_id"] == ""
    assert rows["C"]["trajectory_signature"] == "tpl_6ee9657aa896" and rows["C"]["llm_call_count"] == 0


@pytest.mark.parametrize("slice_ms", [1, 700, 300_000, 10**9])
def test_path_does_not_depend_on_slices(step, slice_ms):
    rows = [("E", f"{i:03d}", ("AGENT", "TOOL", "REASON")[i * 7 % 3], i // 2) for i in range(60)]
    rows += [("E", f"z{i}", "RETRIEVE", 0, {"start_ts_ms": 0 if i % 2 else None, "end_ts_ms": 0}) for i in range(5)]
    got = trajectories(step(*rows).repartition(5), options=StepOptions(path_slice_ms=slice_ms)).first()
    want = ["RETRIEVE"] * 5 + [("AGENT", "TOOL", "REASON")[i * 7 % 3] for i in range(60)]
    assert got["step_sequence"] == "|".join(want)
    assert got["start_ts_ms"] == T


def test_entry_reasoning_is_matched_within_the_trace(step):
    kept = without_entry_reasoning(step(
        ("A", "e", "ENTRY", 0), ("A", "r", "REASON", 1, {"parent_span_id": "e"}),
        ("B", "r", "REASON", 1, {"parent_span_id": "e"}), ("A", "t", "TOOL", 1, {"parent_span_id": "e"}),
    )).collect()
    assert {(r["trace_id"], r["span_id"]) for r in kept} == {("A", "e"), ("B", "r"), ("A", "t")}


def test_nothing_classified_gives_no_row(make):
    spans = make(schemas.SPANS, [{"trace_id": "D", "span_id": "1", "operation_name": "x", "tags": "{}"}])
    assert trajectories(agent_steps(spans)).count() == 0


def test_template_distribution(step):
    rows = template_distribution(trajectories(step(
        ("A", "1", "TOOL", 0), ("B", "1", "TOOL", 0), ("C", "1", "AGENT", 0),
    ))).collect()
    assert [(r["count"], r["share"], r["step_sequence"]) for r in rows] == [(2, 0.6667, "TOOL"), (1, 0.3333, "AGENT")]


def test_judge_context(step):
    row = judge_contexts(step(
        ("A", "e", "ENTRY", 0, {"prompt": "ask"}), ("A", "g", "AGENT", 1, {"agent_name": "res"}),
        ("A", "v", "RETRIEVE", 2, {"collection": "kb", "query_text": "q" * 150}),
        ("A", "r", "REASON", 3, {"model": "m", "prompt": "p" * 300, "response": "answer"}),
        ("A", "t", "TOOL", 4, {"url": "u", "response": "r" * 400}), ("A", "r2", "REASON", 5, {"response": ""}),
    )).first()
    assert row["user_request"] == "ask" and row["final_response"] == "answer"
    assert row["reasoning_chain"] == f"[Agent:res]\n[LLM:m]: {'p' * 200}\n[LLM:unknown]: "
    assert row["evidence"] == f"[RAG:kb] query='{'q' * 100}'\n[Tool:u] → {'r' * 300}"


def test_call_graph(make):
    rows = [("1", "", "a"), ("2", "1", "b"), ("3", "1", "b"), ("4", "2", "c")]
    spans = make(schemas.SPANS, [
        {"trace_id": "A", "span_id": s, "parent_span_id": p, "operation_name": n} for s, p, n in rows
    ])
    assert {tuple(r) for r in call_graph(spans).collect()} == {("a", "b", 2), ("b", "c", 1)}


def test_tags_with_escaped_names_are_classified(spark):
    """Names of tags written with escapes are looked at like any others."""
    def row(span_id, parent, tags):
        return ("t", "s", span_id, parent, "op", "svc", 10**9, 2 * 10**9, 10**9, "OK", "", "", tags, "{}", None)

    spans = spark.createDataFrame(
        [
            row("1", "", '{"http\\u002eroute":"/a"}'), row("2", "1", '{"gen\\u005fai.system":"x"}'), row("3", "2", '{"gen_ai.system":"x"}'),
            row("4", "1", '{"gen_ai.system":"x","agent.name":"a"}'), row("5", "1", '{"note":"gen_ai.system"}'), row("6", "1", "{gen_ai.system"),
            row("7", None, '{"gen_ai.system":"x"}'), row("8", "1", None),
        ],
        schemas.SPANS,
    )
    assert {r["span_id"]: r["span_kind"] for r in agent_steps(spans).collect()} == {"1": "ENTRY", "3": "REASON", "4": "AGENT", "7": "REASON"}
