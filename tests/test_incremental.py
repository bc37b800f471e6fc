"""The window table, changed batch by batch, against one pass over everything."""

import pytest
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.operators import windows
from spanloom.sources import changelog
from spanloom.streaming import incremental, jobs

DAY = 86_400_000
START = 19_700 * DAY


def trace(i, at, signature="a", quality=4.0, session="s", contention=0.25):
    return {"trace_id": f"t{i}", "session_id": session, "start_ts_ms": at, "trajectory_signature": signature, "quality_overall": quality,
            "quality_hallucination": 3.0, "gpu_contention_avg": contention, "inter_node_latency_avg": 10.0, "packet_drop_total": i,
            "ingestion_date": "2024-01-01", "ingestion_hour": 0}


@pytest.fixture()
def fed(spark, make, tmp_path):
    chain = jobs.Pipeline(folder=str(tmp_path / "tables"), trigger=None)

    def feed(batch_id, *rows):
        changelog.write_batch(make(schemas.CORRELATED, rows), chain.path("trace_correlated"), batch_id, schemas.TABLES["trace_correlated"][1])
        jobs.start_windows(spark, chain).awaitTermination()
        log = changelog.read_log(spark, chain.path("trace_correlated"), schemas.CORRELATED)
        whole = windows.drift_windows(changelog.current_by_trace(log))
        got = jobs.current_windows(spark, chain).select(whole.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
        written = changelog.read_log(spark, chain.path("analytics_windows"), schemas.ANALYTICS_WINDOWS)
        last = written.agg(F.max(changelog.BATCH)).first()[0]
        return sorted((r["window_size"], r["window_start_ms"] - START, r["trace_count"]) for r in written.where(F.col(changelog.BATCH) == last).collect())

    return chain, feed


def test_batches_add_up_to_one_pass(fed):
    _, feed = fed
    first = [trace(i, START + (i % 6) * DAY + i * 60_000, "ab"[i % 2], 1.0 + i % 4) for i in range(40)]
    feed(0, *first)
    # Three windows hold the new trace; no other row is written.
    late = START + 3 * DAY + 7_200_000
    assert feed(1, trace(100, late)) == [("1h", late - START, 1), ("30min", late - START, 1), ("5min", late - START, 1)]
    # A trace changes its signature, quality and time, another loses its time: what they added before is taken back.
    moved = feed(2, trace(3, START + 4 * DAY + 40_000_000, "c", 2.0), trace(100, 0))
    assert ("5min", late - START, 0) in moved and len(moved) == 9
    # The earliest window changes: everything compares with it and is written again.
    assert len(feed(3, trace(200, START - DAY, "z", 5.0))) > 20
    feed(4, trace(200, START + 2 * DAY))


def test_sessions_count_and_a_replayed_batch_changes_nothing(spark, fed):
    chain, feed = fed
    feed(0, trace(1, START, session="x"), trace(1, START, session="y"), trace(2, START + DAY, "b"))
    feed(1, trace(1, START, "c", session="x"))
    rows = sorted(map(str, jobs.current_windows(spark, chain).collect()))
    changes = changelog.read_log(spark, chain.path("window_changes"), schemas.WINDOW_CHANGES)
    last = changes.agg(F.max(changelog.BATCH)).first()[0]
    again = changes.where(F.col(changelog.BATCH) == last).drop(changelog.BATCH, "ingestion_date", "ingestion_hour").toPandas()
    incremental.update(spark.createDataFrame(again, incremental._CHANGES), chain.folder, last, chain.drift)
    assert sorted(map(str, jobs.current_windows(spark, chain).collect())) == rows


def test_only_touched_dates_are_read(spark, make, fed):
    """Slices and changes are cut to the dates of the batch before they are shuffled."""
    chain, _ = fed
    slices = [{"slice_ms": START + i * DAY, "signature": "a", "n": 1, "ingestion_date": f"2023-12-0{i + 1}", "ingestion_hour": 0} for i in range(3)]
    changelog.write_batch(make(schemas.SIGNATURE_SLICES, slices), chain.path("signature_slices"), 0)
    log = changelog.read_log(spark, chain.path("signature_slices"), schemas.SIGNATURE_SLICES)
    touched = log.where(F.col("slice_ms") == START).select("slice_ms", "signature", "ingestion_date")
    plan = incremental._of(log, touched)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "dynamicpruning" in plan.lower()


def test_versions_are_kept_without_state_per_trace(spark, make, fed):
    """The newest version of each trace is a table, not a Python state per trace; several batches can come at once."""
    chain, feed = fed
    feed(0, trace(1, START), trace(2, START), trace(6, START, session="x"), trace(6, START, session="y"))
    for batch_id, row in ((1, trace(1, START + DAY)), (2, trace(1, START + 2 * DAY, "b"))):
        changelog.write_batch(make(schemas.CORRELATED, [row]), chain.path("trace_correlated"), batch_id, schemas.TABLES["trace_correlated"][1])
    feed(3, trace(6, START, session="x"), trace(2, 0))
    changed = changelog.read_log(spark, chain.path("window_changes"), schemas.WINDOW_CHANGES).where(F.col(changelog.BATCH) == 1)
    got = sorted((r["slice_ms"] - START, r["signature"], r["d"], r["sign"]) for r in changed.collect())
    assert got == [(0, "a", 1, -1), (0, "a", 2, -1), (0, "a", 6, -1), (2 * DAY, "b", 1, 1)]
    rows = [{**trace(2, START), "batch_id": 2}, {**trace(7, START, contention=float("nan")), "batch_id": 2}]
    signed = incremental.changes(make(f"{schemas.CORRELATED}, batch_id BIGINT", rows), chain.folder, 2)
    assert [(r["d"], r["c"], r["sign"]) for r in signed.collect()] == [(7, None, 1)]
    assert "FlatMapGroupsInPandas" not in signed._jdf.queryExecution().executedPlan().toString()
