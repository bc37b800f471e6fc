import json

import pytest
from times import message

from spanloom import schemas
from spanloom.operators.otlp import flatten, undecodable
from spanloom.operators.scoring import evaluate, rule_judge
from spanloom.operators.steps import agent_steps
from spanloom.operators.trajectory import trajectories
from spanloom.sources import changelog, tables
from spanloom.streaming import jobs


def span(trace, span_id, parent, at, **tags):
    return {"traceId": trace, "spanId": span_id, "parentSpanId": parent, "name": "op",
            "startTimeUnixNano": str(at * 10**9), "endTimeUnixNano": str((at + 1) * 10**9),
            "attributes": [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in tags.items()]}


ENTRY = span("aa", "01", "", 100, http__route="/chat")
DIRECT = span("aa", "02", "01", 101, gen_ai__system="x", gen_ai__response__content="hello")
TOOL = span("aa", "03", "01", 102, rpc__system="mcp")
OTHER = span("bb", "04", "", 103, agent__name="planner")


@pytest.fixture()
def chain(tmp_path):
    (tmp_path / "in").mkdir()
    return jobs.Pipeline(folder=str(tmp_path / "tables"), trigger=None), tmp_path / "in"


def paths(spark, chain):
    log = changelog.read_log(spark, chain.path("trajectory_templates"), schemas.TRAJECTORIES)
    return {r["trace_id"]: r["step_sequence"] for r in changelog.current(log, ["trace_id", "session_id"]).collect()}


def run(spark, chain, landing):
    for begin in (lambda: jobs.start_spans(spark, chain, str(landing)), lambda: jobs.start_agent_steps(spark, chain),
                  lambda: jobs.start_trajectories(spark, chain)):
        begin().awaitTermination()


def test_late_entry_retracts_its_reasoning(spark, chain):
    pipeline, landing = chain
    (landing / "1.json").write_text(message(DIRECT, TOOL) + "\n{broken\n")
    run(spark, pipeline, landing)
    assert paths(spark, pipeline) == {"aa": "REASON|TOOL"}
    (landing / "2.json").write_text(message(ENTRY, OTHER) + "\n")
    run(spark, pipeline, landing)
    assert paths(spark, pipeline) == {"aa": "ENTRY|TOOL", "bb": "AGENT"}
    letters = changelog.read_log(spark, pipeline.path("dead_letters"), "value STRING")
    assert [r["value"] for r in letters.collect()] == ["{broken"]


def test_steps_from_before_the_lookback_stay(spark, chain):
    pipeline, landing = chain
    (landing / "1.json").write_text(message(ENTRY, TOOL, OTHER) + "\n")
    run(spark, pipeline, landing)
    (landing / "2.json").write_text(message(span("aa", "09", "03", 100 + 3 * 3600, agent__name="late")) + "\n")
    run(spark, pipeline, landing)
    assert paths(spark, pipeline) == {"aa": "ENTRY|TOOL|AGENT", "bb": "AGENT"}


def test_stream_equals_batch(spark, chain):
    pipeline, landing = chain
    texts = [message(s) for s in (ENTRY, DIRECT, TOOL, OTHER)]
    for i, text in enumerate(texts):
        (landing / f"{i}.json").write_text(text + "\n")
    pipeline = jobs.Pipeline(folder=pipeline.folder, trigger=None, max_files=1)
    run(spark, pipeline, landing)
    batch = trajectories(agent_steps(flatten(spark.createDataFrame([(t,) for t in texts], "value STRING"))))
    assert paths(spark, pipeline) == {r["trace_id"]: r["step_sequence"] for r in batch.collect()}


def test_whole_chain(spark, chain, tmp_path):
    pipeline, landing = chain
    (landing / "1.json").write_text(message(ENTRY, TOOL, OTHER) + "\n")
    for name, row in (("gpu", {"node_id": "n"}), ("net", {"node_id": 5})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(json.dumps(row) + "\n")
    jobs.run_to_end(spark, pipeline, str(landing), str(tmp_path / "gpu"), str(tmp_path / "net"))
    windows = jobs.current_windows(spark, pipeline)
    assert {r["window_size"]: r["trace_count"] for r in windows.collect()} == {"5min": 2, "30min": 2, "1h": 2}
    rejects = changelog.read_log(spark, pipeline.path("gpu_metrics_rejects"), "value STRING, reject_reason STRING")
    assert rejects.count() == 1


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k STRING, v INT"
    first = spark.createDataFrame([("a", 1), ("b", 1)], schema)
    second = spark.createDataFrame([("b", 2), ("b", 2), ("c", 2)], schema)
    for batch_id, df in ((0, first), (1, second), (1, second)):
        changelog.write_batch(df, path, batch_id, ["k"])
    log = changelog.read_log(spark, path, schema)
    assert log.count() == 4
    assert {tuple(r) for r in changelog.current(log, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_create_all_tables_once(spark, tmp_path):
    assert set(tables.create_all(spark, str(tmp_path))) == set(schemas.TABLES)
    assert tables.create_all(spark, str(tmp_path)) == []
    assert tables.scan(spark, str(tmp_path / "agent_steps"), schemas.AGENT_STEPS).count() == 0


def test_judge_failure_is_an_error_row(spark, step):
    def broken():
        def fail(prompts):
            raise RuntimeError("down")

        return fail

    steps = step(("A", "1", "REASON", 0, {"response": "x"}))
    row = evaluate(steps, broken, "none").first()
    assert row["overall"] == 0.0 and row["explanation"].startswith("eval_error")
    good = evaluate(steps, rule_judge, "rules").first()
    assert good["completeness"] == 4.0 and good["groundedness"] == 2.0


def test_one_failing_prompt_costs_one_trace(spark, step):
    def picky():
        answer = rule_judge()

        def judge(prompts):
            if any("poison" in p for p in prompts):
                raise RuntimeError("refused")
            return answer(prompts)

        return judge

    steps = step(*[(f"t{i}", f"{i:02}", "REASON", 0, {"response": "poison" if i == 3 else "fine"}) for i in range(20)])
    rows = evaluate(steps, picky, "picky").collect()
    assert [r["trace_id"] for r in rows if r["explanation"].startswith("eval_error")] == ["t3"] and len(rows) == 20


def test_late_session_replaces_the_trace_everywhere(spark, chain):
    """A late entry span brings another session and retracts a call: no second row, no stale call downstream."""
    pipeline, landing = chain
    others = landing.parent / "none"
    others.mkdir()
    (landing / "1.json").write_text(message(DIRECT, TOOL) + "\n")
    jobs.run_to_end(spark, pipeline, str(landing), str(others), str(others))
    (landing / "2.json").write_text(message(span("aa", "01", "", 100, http__route="/chat", session__id="s1")) + "\n")
    jobs.run_to_end(spark, pipeline, str(landing), str(others), str(others))
    for table in ("trajectory_templates", "quality_scores", "trace_correlated"):
        rows = jobs.current(spark, pipeline, table).collect()
        assert [(r["trace_id"], r["session_id"]) for r in rows] == [("aa", "s1")], table
    traces = jobs.current(spark, pipeline, "trajectory_templates").select("trace_id")
    assert jobs.current_routing(spark, pipeline, traces).count() == 0


def test_messages_of_another_shape_are_dead_letters(spark):
    good = message(ENTRY)
    bad = ['{"resourceSpans":"x"}', '{"resourceSpans":[{"scopeSpans":[{"spans":"oops"}]}]}', "[1]", "nothing", "3"]
    messages = spark.createDataFrame([(m,) for m in [good, *bad]], "value STRING")
    assert {r["value"] for r in undecodable(messages).collect()} == set(bad)
    assert [r["span_id"] for r in flatten(messages).collect()] == ["01"]
