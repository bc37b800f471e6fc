import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.operators.mutations import mutation_summary, mutations, worst_mutation
from spanloom.operators.windows import drift_windows
from spanloom.options import DriftOptions
from spanloom.plans import reports

HOUR = 3_600_000
ONE = DriftOptions(window_sizes=(("1h", HOUR),))


def trace(i, sig, at, q=4.5, c=0.2, **extra):
    return {"trace_id": str(i), "session_id": "", "trajectory_signature": sig, "start_ts_ms": at, "quality_overall": q,
            "quality_hallucination": 4.0, "gpu_contention_avg": c, "inter_node_latency_avg": 0.0, "packet_drop_total": 0,
            "step_sequence": sig, "step_count": 3, "llm_call_count": 1, "tool_call_count": 0, "retry_count": 0, **extra}


def windows_of(make, rows, options=ONE):
    return {r["window_start_ms"]: r for r in drift_windows(make(schemas.CORRELATED, rows), options).collect()}


def test_baseline_and_degraded_window(make):
    rows = [trace(i, s, HOUR) for i, s in enumerate("AAAB")]
    later = zip("ACCC", (4.5, 4.0, 2.5, 2.0), (0.2, 0.5, 0.8, 0.9))
    rows += [trace(10 + i, s, 3 * HOUR, q, c) for i, (s, q, c) in enumerate(later)]
    w = windows_of(make, rows)
    base, late = w[HOUR], w[3 * HOUR]
    assert (base["trajectory_entropy"], late["trajectory_entropy"]) == (0.8113, 0.8113)
    assert (base["trajectory_drift_jsd"], late["trajectory_drift_jsd"]) == (0.0, 0.5944)
    assert (base["is_baseline"], late["is_baseline"], late["dominant_signature"], late["dominant_share"]) == (1, 0, "C", 0.75)
    assert late["contention_quality_corr"] == -0.9742 and base["contention_quality_corr"] == 0.0
    assert (late["gpu_contention_avg"], late["gpu_pressure"], late["quality_delta"], late["quality_drop"]) == (0.6, 1, -1.25, 1)
    assert late["correlation_flag"] == "gpu_induced_degradation" and base["correlation_flag"] == "normal"
    assert late["correlation_details"] == (
        "q_avg=3.25 (delta -1.25), halluc=4.00, drift_jsd=0.594, entropy=0.81, gpu_contention=0.600, corr(gpu,q)=-0.97, n=4"
    )


def test_empty_signatures_and_edges(make):
    w = windows_of(make, [trace(1, "A", HOUR), trace(2, "", 2 * HOUR), trace(3, "A", 3 * HOUR - 1), trace(4, "A", 0)])
    assert set(w) == {HOUR, 2 * HOUR}
    assert w[2 * HOUR]["trace_count"] == 2 and w[2 * HOUR]["unique_signatures"] == 1
    only_empty = windows_of(make, [trace(1, "A", HOUR), trace(2, "", 2 * HOUR)])[2 * HOUR]
    assert only_empty["trajectory_drift_jsd"] == 0.5 and only_empty["dominant_signature"] == ""
    assert windows_of(make, [trace(1, "", HOUR), trace(2, "", 2 * HOUR)])[2 * HOUR]["trajectory_drift_jsd"] == 0.0


def test_constant_side_has_no_correlation(make):
    rows = [trace(i, "A", HOUR, q=2.7, c=0.1 * i) for i in range(7)] + [trace(9, "A", 2 * HOUR), trace(10, "A", 2 * HOUR, 1.0, 0.9)]
    w = windows_of(make, rows)
    assert w[HOUR]["contention_quality_corr"] == 0.0 and w[2 * HOUR]["contention_quality_corr"] == 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_drift_equals_brute_force(make, seed):
    rng = random.Random(seed)
    rows = [trace(i, rng.choice("ABCDE"[: 2 + i % 4]), HOUR + rng.randrange(6 * HOUR), rng.randrange(20) / 4, rng.random()) for i in range(300)]
    by_window = {}
    for r in rows:
        by_window.setdefault(r["start_ts_ms"] // HOUR * HOUR, []).append(r["trajectory_signature"])
    base = Counter(by_window[min(by_window)])
    for start, got in windows_of(make, rows).items():
        mine = Counter(by_window[start])
        p = {s: n / sum(mine.values()) for s, n in mine.items()}
        q = {s: n / sum(base.values()) for s, n in base.items()}
        mix = {s: (p.get(s, 0) + q.get(s, 0)) / 2 for s in p | q}
        jsd = sum(v / 2 * math.log2(v / mix[s]) for d in (p, q) for s, v in d.items())
        assert abs(got["trajectory_drift_jsd"] - jsd) <= 5.1e-5 and 0 <= got["trajectory_drift_jsd"] <= 1
        assert abs(got["trajectory_entropy"] + sum(v * math.log2(v) for v in p.values())) <= 5.1e-5
        assert got["trajectory_entropy"] <= math.log2(got["unique_signatures"]) + 1e-4


def test_sizes_come_from_the_same_traces(make):
    rows = [trace(i, "AB"[i % 2], HOUR + i * 100_000) for i in range(50)]
    counts = drift_windows(make(schemas.CORRELATED, rows)).groupBy("window_size").agg(F.sum("trace_count").alias("n")).collect()
    assert {r["window_size"]: r["n"] for r in counts} == {"5min": 50, "30min": 50, "1h": 50}


def test_mutations(make):
    rows = [trace(i, "X", HOUR + i, q) for i, q in enumerate((5.0, 4.0, 4.0, 2.0))] + [trace(8, "Y", HOUR, 2.0), trace(9, "Y", HOUR, 1.0)]
    df = make(schemas.CORRELATED, rows)
    got = mutations(df).collect()
    assert [(r["signature"], r["bad_rate"], r["lift"], r["is_dominant"], r["is_harmful"]) for r in got] == [
        ("Y", 1.0, 2.0, 0, 1), ("X", 0.25, 0.5, 1, 0)
    ]
    assert mutation_summary(df).first().asDict() == {
        "total_traces": 6, "global_bad_rate": 0.5, "dominant_signature": "X", "harmful_count": 1
    }
    assert worst_mutation(mutations(df)).first()["signature"] == "Y"


def test_mutations_without_good_majority_and_without_bad(make):
    bad = make(schemas.CORRELATED, [trace(1, "X", HOUR, 1.0), trace(2, "X", HOUR, 1.0), trace(3, "Y", HOUR, None)])
    assert [r["signature"] for r in mutations(bad).collect() if r["is_dominant"]] == ["X"]
    good = make(schemas.CORRELATED, [trace(1, "X", HOUR), trace(2, "Y", HOUR)])
    assert {r["lift"] for r in mutations(good).collect()} == {0.0}


def test_reports(make):
    rows = [trace(i, "AB"[i % 2], HOUR + i * 60_000, c=i / 10) for i in range(8)]
    df = make(schemas.CORRELATED, rows)
    row = reports.dashboard_numbers(df).first()
    assert (row["traces"], row["templates"], row["avg_contention"], row["badge"]) == (8, 2, 0.35, "HEALTHY")
    w = drift_windows(df, ONE)
    assert reports.drift_story(w).count() == w.count()
    assert reports.windows(w, "5min").count() == 0 and reports.windows(w, "").count() == w.count()
