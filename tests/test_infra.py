import random

from times import T
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.operators import infra, ops_metrics, retrieval, sessions
from spanloom.operators.ordered import running_max_before, running_total
from spanloom.sources import tables


def test_network_rates(spark):
    rows = [("n", 0, 0, 0, 5, 1), ("n", 5_000, 1_250_000, 625_000, 4, 3), ("n", 5_000, 2_000_000, 0, 9, 9), ("m", 1, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "node_id STRING, ts_ms BIGINT, tx_bytes BIGINT, rx_bytes BIGINT, drops BIGINT, retransmits BIGINT")
    got = infra.network_rates(df).collect()
    assert [tuple(r) for r in got] == [(5_000, "n", 2.0, 1.0, 0, 2)]
    assert infra.network_rates(df, slice_ms=1_000).collect() == got


def test_running_folds_equal_brute_force(spark):
    rng = random.Random(3)
    rows = sorted({(rng.choice("ab"), rng.randrange(1_000)) for _ in range(300)})
    rows = [(k, t, rng.randrange(50)) for k, t in rows]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, v BIGINT")
    piece = F.floor(F.col("t") / 37)
    total = running_total(df, ["t"], F.col("v"), piece, "out", ["k"]).collect()
    peak = running_max_before(df, ["t"], F.col("v"), piece, "out", ["k"]).collect()
    for r in total:
        assert r["out"] == sum(v for k, t, v in rows if k == r["k"] and t <= r["t"])
    for r in peak:
        assert r["out"] == max((v for k, t, v in rows if k == r["k"] and t < r["t"]), default=None)


def test_incidents_equal_brute_force(spark):
    rng = random.Random(5)
    incidents = []
    for i in range(80):
        start = rng.randrange(20_000)
        incidents.append((f"i{i:02d}", rng.choice("ab"), start, start + rng.choice([0, 10, 500, 9_000]), i / 8))
    samples = [(rng.choice("abc"), rng.randrange(30_000)) for _ in range(300)]
    got = infra.label_incidents(
        spark.createDataFrame(samples, "node_id STRING, timestamp_ms BIGINT"),
        spark.createDataFrame(incidents, "name STRING, node_id STRING, start_ms BIGINT, end_ms BIGINT, intensity DOUBLE"),
        ["node_id"], tile_ms=700,
    ).collect()
    assert len(got) == len(samples)
    for r in got:
        hits = [(s, n, x) for n, k, s, e, x in incidents if k == r["node_id"] and s <= r["timestamp_ms"] <= e]
        want = min(hits) if hits else (None, None, 0.0)
        assert (r["incident"], r["intensity"], r["contended"]) == (want[1], want[2], int(bool(hits)))


def test_downsample_counts_over_all_series(spark):
    df = spark.range(100).select((F.col("id") * 7_000).alias("timestamp_ms"), (F.col("id") % 3).cast("string").alias("node_id"))
    kept = infra.downsample(df, 4, ["timestamp_ms", "node_id"]).collect()
    assert sorted(r["timestamp_ms"] for r in kept) == [i * 7_000 for i in range(0, 100, 4)]
    per = infra.downsample(df, 4, ["timestamp_ms"], ["node_id"]).groupBy("node_id").count().collect()
    assert {r["node_id"]: r["count"] for r in per} == {"0": 9, "1": 9, "2": 9}


def test_freshness_and_routing(make, step):
    gpu = make(schemas.GPU_SAMPLE, [
        {"timestamp_ms": T, "node_id": "node-1", "gpu_id": "gpu-1", "gpu_uuid": "old"},
        {"timestamp_ms": T + 29_000, "node_id": "node-1", "gpu_id": "gpu-2", "gpu_uuid": "new"},
        {"timestamp_ms": T, "node_id": "node-9", "gpu_id": "gpu-0"},
    ])
    fresh = {r["node_id"]: (r["source"], r["last_real_ago_s"]) for r in infra.source_freshness(gpu, T + 30_000).collect()}
    assert fresh == {"node-1": ("real", 1.0), "node-9": ("synthetic", 30.0)}
    routes = {r["span_id"]: r for r in infra.route_calls(step(
        ("A", "1", "REASON", 0, {"node_id": ""}), ("A", "2", "REASON", 0, {"node_id": "node-5"}), ("A", "3", "TOOL", 0),
    ), gpu).collect()}
    assert set(routes) == {"1", "2"}
    assert (routes["1"]["vllm_pod_id"], routes["1"]["gpu_uuid"]) == ("ollama-node-1", "new")
    assert (routes["2"]["gpu_id"], routes["2"]["gpu_uuid"]) == ("gpu-0", "")


def test_metric_ingest_reasons(spark):
    good = ('{"timestamp_ms":1,"node_id":"n","inter_node_latency_us":1,"throughput_tx_mbps":1,"throughput_rx_mbps":1,'
            '"packet_drop_count":1,"tcp_retransmit_count":1}')
    lines = [good, good.replace('"node_id":"n",', ""), good.replace('"packet_drop_count":1', '"packet_drop_count":"x"'), "oops"]
    checked = tables.checked_metrics(spark.createDataFrame([(line,) for line in lines], "value STRING"), tables.NETWORK_FORMAT)
    ok = tables.accepted(checked, tables.NETWORK_FORMAT).collect()
    assert len(ok) == 1 and ok[0]["peer_node_id"] == "" and ok[0]["ingestion_date"] == "1970-01-01"
    assert [r["reject_reason"] for r in tables.rejected(checked).collect()] == ["missing node_id", "bad packet_drop_count", "not JSON"]


def test_nearest_rank_with_one_value_holding_most_rows(spark):
    rng = random.Random(1)
    values = [5.0] * 700 + [rng.random() * 100 for _ in range(300)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 1.0)], "k STRING, v DOUBLE")
    got = {r["k"]: r for r in ops_metrics.nearest_rank(df, ["k"], "v", ops_metrics.PERCENTILES).collect()}
    for name, q in ops_metrics.PERCENTILES.items():
        assert got["g"][name] == sorted(values)[int(len(values) * q)] and got["h"][name] == 1.0


def test_threshold(make):
    gpu = make(schemas.GPU_SAMPLE, [{"contention_index": v} for v in (0.1, 0.2, 0.9)])
    assert ops_metrics.calibrated_threshold(gpu).first()["suggested_threshold"] == 0.7
    flat = make(schemas.GPU_SAMPLE, [{"contention_index": 0.5}])
    assert ops_metrics.calibrated_threshold(flat).first()["suggested_threshold"] is None


def test_nearest_ways_agree(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "id BIGINT, embedding ARRAY<FLOAT>")
    queries = vectors.where("id < 30").withColumnRenamed("id", "query_id")
    in_one = {(r["query_id"], r["id"]) for r in retrieval.nearest(vectors, queries).collect()}
    by_blocks = {(r["query_id"], r["id"]) for r in retrieval.nearest_by_blocks(vectors, queries, 3, 5, 4).collect()}
    assert in_one == by_blocks and len(by_blocks) == 90


def test_nearest_compares_large_blocks_in_slices(spark):
    """More stored vectors than a slice holds; copies tie by id."""
    vectors = spark.range(5000).selectExpr("id", "array(cast(id % 7 as float), cast(1 as float)) as embedding")
    queries = vectors.where("id < 7").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in retrieval.nearest(vectors, queries).collect()}
    assert got == {(q, q + 7 * i) for q in range(7) for i in range(3)}


def test_sessions(spark):
    messages = spark.createDataFrame(
        [("s", 1, "assistant", "hi", "1", "{}"), ("s", 2, "user", "x" * 60, "2", "{}")], schemas.MESSAGES)
    row = sessions.session_rollup(messages).first()
    assert (row["title"], row["total_turns"], row["status"]) == ("x" * 50, 2, "active")
    turns = spark.createDataFrame([("s", 1, {"a": "1", "b": "2"}), ("s", 2, {"a": "3", "b": ""})],
                                  "session_id STRING, turn_number INT, params MAP<STRING, STRING>")
    assert sessions.session_context(turns).first()["params"] == {"a": "3", "b": "2"}
