"""Whitening and nearest neighbours against brute force, and on awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import posting_lists, whitening

DDL = "vec_id bigint, embedding array<float>, label int, n int, list int, query_id string, i string"


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, "q", "i") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, DDL).repartition(3)


AWKWARD = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0]]


@pytest.mark.parametrize("scale", [1.0, 5e4, 2.0**54])
def test_block_moments_are_exact(scale):
    x = whitening.shifted(np.random.default_rng(1).normal(size=(131, 5)) * scale)
    n, sums, products = whitening.block_moments(x)
    rows = x.tolist()
    assert n == 131 and list(sums) == [sum(r[i] for r in rows) for i in range(5)]
    for i in range(5):
        assert [products[i, j] for j in range(i, 5)] == [sum(r[i] * r[j] for r in rows) for j in range(i, 5)]


def test_squared_lengths_are_exact():
    for scale in (10, 2**40, 2**55):
        d = np.random.default_rng(2).integers(-scale, scale, (20, 7))
        assert whitening.squared_lengths(d) == [sum(v * v for v in r) for r in d.tolist()]
    assert whitening.squared_lengths(np.array([[10**30, 1]], object)) == [10**60 + 1]


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) / 5).astype(np.float32)
    vectors[100:200] = vectors[0]  # a third are copies
    rows = whitening.whitened(table(spark, [*vectors.tolist(), *AWKWARD]), components=4).collect()
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    values, columns = np.linalg.eigh(((n * (x.T.astype(object) @ x) - np.outer(sums, sums).astype(object)) / (n * n)).astype(float))
    values, columns = values[::-1], columns[:, ::-1]
    white = (x - sums / n) @ columns / np.sqrt(values)
    assert len(rows) == n * 4 and {r["vec_id"] for r in rows} == set(range(n))
    got = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == c] for c in (1, 2, 3, 4)])
    for c in range(4):
        assert np.allclose(got[c], white[:, c], atol=1e-9) or np.allclose(got[c], -white[:, c], atol=1e-9)
    for r in rows:
        assert r["n"] == n and int(r["deviation"]) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[r["vec_id"]], sums, strict=True))
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    none = whitening.whitened(table(spark, AWKWARD[:5]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whitened(table(spark, [[0.5, 1.0]])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, 0.0, 0.0, 0.0),
        (2, 1, 0, 0.0, 0.0, 0.0),
    ]
    line = whitening.whitened(table(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).where("component = 2").collect()
    assert [r["whitened"] for r in line] == [0.0, 0.0, 0.0] and line[0]["identity_error"] < 1e-9


def brute(vectors, queries, k):
    """{query: [(vec_id, score)]} over rows that take part."""
    own = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vectors)}
    own = {i: v for i, v in own.items() if v.any()}
    out = {}
    for q in queries:
        if q in own:
            scored = sorted((-float(np.add.reduce(own[q] * v)), i) for i, v in own.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_few_rows_are_searched_exactly(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 3)).astype(np.float32)
    vectors[20:60] = vectors[1]  # ties to smaller ids
    vectors[40] = 0
    got = found(posting_lists.nearest(table(spark, [*vectors.tolist(), *AWKWARD]), F.col("vec_id") % 20 == 0, k=7))
    assert got == brute(vectors, range(0, 90, 20), 7) and 40 not in got
    few = found(posting_lists.nearest(table(spark, vectors[:5].tolist()), F.col("vec_id") % 20 == 0))
    assert few == brute(vectors[:5], [0], 20) and len(few[0]) == 4


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies", "lengths"])
def test_recall_on_many_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(posting_lists, "TWO_LISTS", 500)
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 64)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 12))
    if kind == "clusters":
        vectors = vectors * 0.2 + rng.normal(size=(30, 12))[rng.integers(0, 30, 3000)]
    if kind == "copies":
        vectors[1000:2000] = vectors[0]  # a list of a third of all rows
    if kind == "lengths":
        vectors *= rng.lognormal(size=(3000, 1))
    vectors = vectors.astype(np.float32)
    got, want = found(posting_lists.nearest(table(spark, vectors.tolist()), F.col("vec_id") % 20 == 0)), brute(vectors, range(0, 3000, 20), 20)
    hits = 0
    for q, near in want.items():
        assert len(got[q]) == 20
        scores = {i: float(np.add.reduce(vectors[q].astype(float) * vectors[i].astype(float))) for i, _ in got[q]}
        assert all(scores[i] == s for i, s in got[q]) and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in near} & set(scores))
    assert hits / sum(map(len, want.values())) >= 0.9


def test_search_without_rows_or_queries(spark):
    assert posting_lists.nearest(table(spark, AWKWARD[:5]), F.col("vec_id") % 20 == 0).count() == 0
    assert posting_lists.nearest(table(spark, [[1.0, 2.0], [2.0, 1.0]], first=1), F.col("vec_id") % 20 == 0).count() == 0
    assert posting_lists.nearest(table(spark, [[1.0, 2.0]]), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 1.0]), (None, [9.0, 9.0])]
    got = posting_lists.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]


def test_graph_search_finds_all_within_the_ratio():
    points = np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32)
    graph, x = posting_lists.Graph.of(points), np.random.default_rng(7).normal(size=(40, 8)).astype(np.float32)
    d = np.sqrt(posting_lists.squared_distances(x, points))
    point, node, _ = graph.search(x, 16, 1.3)
    near = d <= 1.3 * d.min(axis=1, keepdims=True)
    assert near[point, node].sum() >= 0.97 * near.sum()


def test_parts_are_balanced():
    points = np.concatenate([np.zeros((400, 3)), np.random.default_rng(8).normal(size=(600, 3))])
    sizes = np.bincount(posting_lists.balanced_parts(points, 10), minlength=10)
    assert sizes.min() >= 90 and sizes.max() <= 110
