import random

import pytest
from times import T
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.operators import correlate as c
from spanloom.operators.interval_join import Measure, aggregate_over_intervals, count_of

ROUTE = {"trace_id": "A", "span_id": "1", "vllm_pod_id": "p1", "node_id": "node-1", "gpu_id": "gpu-0", "queue_wait_ms": 0.0,
         "timestamp_ms": T + 5_000}


def sample(node, ts, contention, temp, throttle):
    return {"timestamp_ms": ts, "node_id": node, "gpu_id": "gpu-0", "contention_index": contention, "temperature_c": temp,
            "throttle_active": throttle, "memory_used_pct": 10.0, "power_draw_pct": 20.0}


SAMPLES = [
    sample("node-1", T - 5_000, 0.2, 50.0, 0), sample("node-1", T + 15_000, 0.8, 80.0, 1),
    sample("node-1", T + 15_001, 0.9, 90.0, 1), sample("node-2", T + 5_000, 1.0, 90.0, 1),
]


def inputs(make, routes, gpu=SAMPLES, net=()):
    trace = {"trace_id": "A", "session_id": "s", "trajectory_signature": "x", "start_ts_ms": T, "end_ts_ms": T + 30_000}
    quality = {"trace_id": "A", "overall": 4.0, "completeness": 3.0, "explanation": "ok"}
    return (
        make(schemas.TRAJECTORIES, [trace]), make(schemas.QUALITY, [quality]), make(schemas.ROUTING, routes),
        make(schemas.GPU_SAMPLE, gpu), make(schemas.NETWORK_SAMPLE, net),
    )


def test_gpu_samples_within_ten_seconds(make):
    row = c.correlate(*inputs(make, [ROUTE])).first()
    assert (row["gpu_contention_avg"], row["gpu_contention_max"]) == (0.5, 0.8)
    assert (row["gpu_temperature_avg"], row["gpu_temperature_max"], row["gpu_throttle_count"]) == (65.0, 80.0, 1)
    assert (row["quality_overall"], row["quality_coherence"], row["primary_pod_id"]) == (4.0, 0.0, "p1")


def test_a_sample_counts_once_per_call(make):
    row = c.correlate(*inputs(make, [ROUTE, {**ROUTE, "span_id": "2"}])).first()
    assert row["gpu_throttle_count"] == 2 and row["gpu_contention_avg"] == 0.5


def test_no_samples_no_routing(make):
    row = c.correlate(*inputs(make, [], [])).first()
    assert row["gpu_contention_avg"] == 0.0 and row["primary_pod_id"] == "" and row["inter_node_latency_avg"] == 0.0


def test_latency_guard_keeps_drops(make):
    net = [{"timestamp_ms": T + 5_000 + i, "node_id": "node-1", "inter_node_latency_us": v, "packet_drop_count": 1,
            "tcp_retransmit_count": None} for i, v in enumerate([-1.0, 0.0, 200.0, 400.0])]
    row = c.correlate(*inputs(make, [ROUTE], net=net)).first()
    assert (row["inter_node_latency_avg"], row["inter_node_latency_max"]) == (300.0, 400.0)
    assert (row["packet_drop_total"], row["tcp_retransmit_total"]) == (4, 0)


def test_primary_pod_and_queue(make):
    def pods(*names):
        routes = [{**ROUTE, "span_id": str(i), "vllm_pod_id": p, "node_id": f"n{i}", "queue_wait_ms": float(i),
                   "timestamp_ms": T + i} for i, p in enumerate(names)]
        return c.correlate(*inputs(make, routes)).first()

    row = pods("p1", "p2", "p2")
    assert (row["primary_pod_id"], row["primary_node_id"], row["queue_wait_avg"], row["queue_wait_max"]) == ("p2", "n1", 1.5, 2.0)
    assert pods("p2", "p1")["primary_pod_id"] == "p1"


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_interval_aggregation_equals_brute_force(spark, levels):
    rng = random.Random(levels)
    samples = [(rng.choice("ab"), rng.randrange(0, 5_000), float(rng.randrange(100))) for _ in range(400)]
    intervals = []
    for i in range(150):
        lo = rng.randrange(0, 5_000)
        intervals.append((i, rng.choice("ab"), lo, lo + rng.choice([0, 3, 9, 10, 25, 400, 4_000])))
    got = aggregate_over_intervals(
        spark.createDataFrame(intervals, "i INT, k STRING, lo BIGINT, hi BIGINT"),
        spark.createDataFrame(samples, "k STRING, ts BIGINT, v DOUBLE"),
        group_by=["i"], keys=["k"], lo="lo", hi="hi", ts="ts",
        measures=[count_of("n"), Measure("s", "sum", "v"), Measure("m", "max", "v")], tile_ms=10, levels=levels,
    )
    want = {}
    for i, k, lo, hi in intervals:
        hit = [v for sk, ts, v in samples if sk == k and lo <= ts <= hi]
        if hit:
            want[i] = (len(hit), sum(hit), max(hit))
    assert {r["i"]: (r["n"], r["s"], r["m"]) for r in got.collect()} == want


def test_one_key_holding_most_rows(spark):
    """A busy node: the cover keeps the joined rows near the number of intervals, not intervals times samples."""
    samples = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("ts"))
    intervals = spark.range(200).select(
        F.col("id").alias("i"), F.lit("hot").alias("k"), F.lit(0).cast("bigint").alias("lo"), (19_000 + F.col("id")).alias("hi")
    )
    got = aggregate_over_intervals(
        intervals, samples, group_by=["i"], keys=["k"], lo="lo", hi="hi", ts="ts", measures=[count_of("n")], tile_ms=10, levels=4
    )
    assert got.where(F.col("n") != 19_001 + F.col("i")).count() == 0 and got.count() == 200


def test_live_takes_busiest_node_and_falls_back(make, step):
    steps = step(("A", "1", "REASON", 0), ("B", "1", "TOOL", 10_000))
    gpu = make(schemas.GPU_SAMPLE, [sample("n1", T, 0.2, 50.0, 0), sample("n2", T + 1, 0.9, 60.0, 1), sample("n1", T + 500_000, 0.4, 40.0, 0),
                                    sample("n1", T + 600_000, 0.6, 40.0, 0)])
    net = make(schemas.NETWORK_SAMPLE, [{"timestamp_ms": T + 9, "node_id": n, "inter_node_latency_us": v, "packet_drop_count": 2}
                                        for n, v in (("n1", 100.0), ("n2", 300.0))])
    rows = {r["trace_id"]: r for r in c.correlate_live(steps, gpu, net).collect()}
    assert (rows["A"]["primary_node_id"], rows["A"]["gpu_contention_avg"], rows["A"]["inter_node_latency_avg"]) == ("n2", 0.9, 300.0)
    assert (rows["B"]["primary_node_id"], rows["B"]["gpu_contention_avg"], rows["B"]["packet_drop_total"]) == ("n1", 0.5, 2)


def test_live_plan_can_be_cut(make, step, tmp_path, spark):
    """Kept tables give the same rows, and a trace meets groups of nodes only where there is a node."""
    steps = step(("A", "1", "REASON", 0), ("B", "1", "TOOL", 10_000), ("C", "1", "TOOL", 599))
    gpu = make(schemas.GPU_SAMPLE, [sample(f"n{i % 3}", T + i * 7_000, 0.1 * (i % 7), 50.0, i % 2) for i in range(100)])
    net = make(schemas.NETWORK_SAMPLE, [{"timestamp_ms": T + i, "node_id": f"n{i % 3}", "inter_node_latency_us": 100.0 + i, "packet_drop_count": 1}
                                        for i in range(9)])
    plain = c.correlate_live(steps, gpu, net, F.lit(T))
    kept = {}

    def keep(name, rows):
        rows.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return kept[name]

    cut = c.correlate_live(steps, gpu, net, F.lit(T), keep=keep)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect())) and set(kept) == {"traces", "busiest", "network"}
    long = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (cut, plain)]
    assert long[0] < long[1] / 2
