"""Pivot search, sketch percentiles and prefix sums in sections against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ops_metrics, ordered, retrieval
from spanloom.operators.infra import downsample


def table(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "zeros"])
def test_pivots_find_the_same_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 8))
    if kind == "clusters":
        vectors = vectors * 0.05 + np.repeat(rng.normal(size=(20, 8)), 30, axis=0)
    if kind == "copies":
        vectors[100:300] = vectors[7]
    if kind == "zeros":
        vectors[::50] = 0
    stored = table(spark, vectors)
    queries = stored.withColumnRenamed("id", "query_id").where("query_id % 3 = 0")
    tell = {}
    got = rows_of(retrieval.nearest_by_pivots(stored, queries, 4, tell=tell))
    assert got == rows_of(retrieval.nearest_by_blocks(stored, queries, 4, 3, 2))
    assert tell["all"] == 600 * 200
    if kind == "clusters":
        assert tell["pairs"] < 0.3 * tell["all"]


def test_pivots_with_few_or_no_vectors(spark):
    few = table(spark, [[1, 0], [0, 1]])
    asked = few.withColumnRenamed("id", "query_id")
    assert rows_of(retrieval.nearest_by_pivots(few, asked, 5)) == rows_of(retrieval.nearest(few, asked, 5))
    assert retrieval.nearest_by_pivots(few.limit(0), asked, 5).count() == 0
    assert retrieval.nearest_by_pivots(few, asked.limit(0), 5).count() == 0


@pytest.fixture(scope="module")
def spans(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        service = "abc"[min(2, int(rng.exponential()))]
        ns = None if i % 97 == 0 else 0 if i % 89 == 0 else int(rng.lognormal(18, 3)) if i % 2 else 5_000_000
        rows.append((service, "ERROR" if i % 13 == 0 else "OK", ns, int(i * 10**11)))
    return spark.createDataFrame(rows, "service_name STRING, status_code STRING, duration_ns BIGINT, start_time_unix_nano BIGINT")


def test_percentiles_from_a_sketch_are_exact(spans):
    keys = ["service_name"]
    sketch = ops_metrics.latency_sketch(spans, keys)
    plain = {r["service_name"]: tuple(r) for r in ops_metrics.latency_report(spans, keys).collect()}
    got = {r["service_name"]: tuple(r) for r in ops_metrics.latency_report_from_sketch(spans, sketch, keys).collect()}
    assert got == plain and len(plain) == 3


def test_sketches_of_parts_add_up(spans):
    keys, odd = ["service_name"], F.col("start_time_unix_nano") % 2_000_000_000_000 == 0
    parts = ops_metrics.latency_sketch(spans.where(odd), keys).union(ops_metrics.latency_sketch(spans.where(~odd), keys))
    found = ops_metrics.percentiles_from_sketch(spans, parts, keys, {"p25": 0.25, "max": 1.0})
    whole = ops_metrics.nearest_rank(
        spans.where("status_code <> 'ERROR'").withColumn("s", F.col("duration_ns") / 1e9), keys, "s", {"p25": 0.25, "max": 1.0}
    )
    assert rows_of(found.select("service_name", "p25", "max")) == rows_of(whole.select("service_name", "p25", "max"))


def test_approximate_percentiles_are_near(spans):
    exact = {r["service_name"]: r for r in ops_metrics.latency_report(spans, ["service_name"]).collect()}
    values = {}
    for r in spans.where("status_code <> 'ERROR' AND duration_ns IS NOT NULL").collect():
        values.setdefault(r["service_name"], []).append(r["duration_ns"] / 1e9)
    for r in ops_metrics.approximate_latency(spans, ["service_name"]).collect():
        own = np.sort(values[r["service_name"]])
        for name, q in ops_metrics.PERCENTILES.items():
            ranks = np.searchsorted(own, [r[name], exact[r["service_name"]][name]])
            assert abs(int(ranks[0]) - int(ranks[1])) <= 1 + len(own) // 10_000, (name, q)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_prefix_sums_in_sections(spark, monkeypatch, keys):
    monkeypatch.setattr(ordered, "SECTION_SLICES", 4)
    rng = np.random.default_rng(3)
    data = [(int(i), "xy"[i % 2], int(v)) for i, v in enumerate(rng.integers(-5, 9, 500))]
    df = spark.createDataFrame(data, "at BIGINT, g STRING, v BIGINT").repartition(4)
    slices = F.floor(F.col("at") / 7)
    totals = ordered.running_total(df, ["at"], F.col("v"), slices, "total", keys)
    peaks = ordered.running_max_before(df, ["at"], F.col("v"), slices, "peak", keys)
    sums, tops, want = {}, {}, {}
    for at, g, v in data:
        k = g if keys else ""
        want[at] = (sums.get(k, 0) + v, tops.get(k))
        sums[k], tops[k] = want[at][0], v if tops.get(k) is None else max(tops[k], v)
    assert {r["at"]: r["total"] for r in totals.collect()} == {at: w[0] for at, w in want.items()}
    assert {r["at"]: r["peak"] for r in peaks.collect()} == {at: w[1] for at, w in want.items()}
    every = downsample(df, 9, ["at"], keys or None, slice_ms=7).collect()
    assert len(every) == (2 * len(range(0, 250, 9)) if keys else len(range(0, 500, 9)))


def test_no_task_sees_all_slices(spark):
    """Without keys, only one row per section meets the others."""
    df = spark.range(1000).withColumn("v", F.lit(1))
    plan = ordered.running_total(df, ["id"], F.col("v"), F.floor(F.col("id") / 7), "n")._jdf.queryExecution().optimizedPlan().toString()
    unpartitioned = re.findall(r"windowspecdefinition\((\w+)#\d+L? ASC", plan)
    assert unpartitioned == ["_section"]


@pytest.mark.parametrize("places", [0, 1, 6])
def test_best_equals_a_full_sort(places):
    """Only vectors within a query's bound are sorted; ties, repeated ids and values that are no numbers come out the same."""
    rng = np.random.default_rng(places)
    vectors = retrieval._unit(list(np.round(rng.normal(size=(2500, 4)), places)))
    vectors[::400] = np.nan
    ids = rng.permutation(2500) // (2 if places else 1)
    best = retrieval._Best(np.arange(300), vectors[:300], 3)
    widths = []
    fold = best._fold
    best._fold = lambda q, *rest: (widths.append(len(q)), fold(q, *rest))
    best.add(ids[:2000], vectors[:2000])
    best.add(ids[2000:], vectors[2000:])
    distances = np.round(1.0 - vectors[:300] @ vectors.T, retrieval.DIGITS)
    named = np.broadcast_to(ids, distances.shape)
    order = np.lexsort((named, distances), axis=1)[:, :3]
    got = best.frame()
    assert (got["id"].to_numpy() == np.take_along_axis(named, order, 1).ravel()).all()
    assert np.array_equal(got["distance"].to_numpy(), np.take_along_axis(distances, order, 1).ravel(), equal_nan=True)
    if places == 6:
        assert sum(widths) < distances.size / 20


def test_a_query_is_sent_once_per_shelf_of_cells():
    counts = {-1: 3, **{c: 10 for c in range(900)}}
    shelves = retrieval._shelves(counts)
    assert len(set(shelves.values())) <= 3 and set(shelves) == set(counts)


def test_blocks_of_large_tables_grow():
    assert [retrieval._blocks(n) for n in (0, 8_192, 50_000, 600_000, 6_000_000)] == [1, 1, 7, 12, 92]
