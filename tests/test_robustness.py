"""Inputs that once ended a job or gave wrong numbers, and workers that lack the package."""

import os
import subprocess
import sys
from pathlib import Path

from spanloom.functions.judge import parse_scores
from spanloom.operators.infra import label_incidents
from spanloom.operators.ops_metrics import active_agents

ROOT = Path(__file__).resolve().parents[1]


def test_judge_scores_of_any_size(column):
    replies = [('{"completeness": 99999999999, "coherence": -1e300, "relevance": 2.9}',), ('{"completeness": "x"}',)]
    big, bad = column(parse_scores, "reply STRING", replies)
    assert (big["completeness"], big["coherence"], big["relevance"]) == (5.0, 1.0, 2.0)
    assert bad["explanation"].startswith("eval_error")


def test_open_ended_incidents(spark):
    samples = spark.createDataFrame([("n", t * 60_000) for t in range(0, 400, 7)], "node_id STRING, timestamp_ms BIGINT")
    incidents = spark.createDataFrame(
        [("n", "a", 0.5, 60_000 * 100, None), ("n", "b", 0.7, 0, 60_000 * 50), ("m", "c", 0.1, 0, 2**61)],
        "node_id STRING, name STRING, intensity DOUBLE, start_ms BIGINT, end_ms BIGINT",
    )
    for row in label_incidents(samples, incidents, ["node_id"]).collect():
        minute = row["timestamp_ms"] // 60_000
        assert row["incident"] == ("b" if minute <= 50 else "a" if minute >= 100 else None)
    assert label_incidents(samples.limit(0), incidents, ["node_id"]).count() == 0


def test_agents_without_an_end_stay_active(spark):
    steps = spark.createDataFrame(
        [("AGENT", 1000, 3000), ("AGENT", 2000, 0), ("AGENT", 0, 2500), ("TOOL", 1000, 9000)], "kind STRING, start_ms BIGINT, end_ms BIGINT"
    )
    rows = [(r["at_ms"], r["active"]) for r in active_agents(steps).orderBy("at_ms").collect()]
    assert rows == [(1000, 1), (2000, 2), (3000, 1)]


LIBRARY = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from spanloom.operators import retrieval, scoring
from spanloom.session import local_session
spark = local_session("elsewhere", 2)
rows = spark.createDataFrame([(i, "text " + str(i)) for i in range(9)], "id BIGINT, text STRING")
vectors = retrieval.embed(rows, "text", retrieval.hashing_embedder())
print("nearest", retrieval.nearest(vectors, vectors.withColumnRenamed("id", "query_id"), 2).count())
print("asked", scoring.ask(rows, scoring.rule_judge, "text").where("reply IS NOT NULL").count())
"""


def _elsewhere(script, folder):
    """Python started in another folder, without a search path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.split()


def test_workers_get_the_package_from_the_library(tmp_path):
    assert _elsewhere(LIBRARY, tmp_path) == ["nearest", "18", "asked", "9"]


def test_workers_get_the_package(tmp_path):
    """The entry is imported by its path, and queries that need Python workers run."""
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from spanloom.session import local_session
spark = local_session("elsewhere", 2)
for name in ("judged_traces", "nearest_vectors"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    assert len(_elsewhere(script, tmp_path)) == 4
