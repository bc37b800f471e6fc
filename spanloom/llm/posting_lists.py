"""Approximate nearest neighbours by inner product over balanced posting lists.

* Lists: a bounded sample of rows (``SAMPLE_VALUES`` numbers) is halved again and again into parts of equal size, then moved by a
  few assignment steps in which long lists cost more; the parts' means are the lists' centroids. Vectors get one more entry that
  gives all of them the same length, so that the nearest by distance is the one with the largest inner product.
* Every row goes to its nearest centroid's list and, if it lies near a boundary, to up to ``COPIES`` lists in all.
* Centroids are searched in a graph of near centroids held in memory, for many points at a time, by best-first steps.
* A query reads the lists whose centroid is at most ``ratio`` times as far as its nearest one. The ratio is measured: for
  ``TRIALS`` queries the exact neighbours are found by one pass over all rows, and the ratio is the smallest at which the share
  ``recall`` of them lies in a list read. Data without structure gets a large ratio, and clustered data a small one.
* Lists are cut into blocks of bounded size, as are the queries of a list. Spark joins the blocks by list; a task multiplies them
  and holds the best of each query it meets, sending them on once that has grown to ``HELD_QUERIES``.

A list of a third of all rows is some blocks more; no task holds a list as a whole. Tables of up to ``TWO_LISTS`` rows have one
list, so their result is exact.

Vectors that are null, empty, zero, hold null or non-finite entries, or whose length is not the most frequent one (ties: the
longer) take no part, nor do rows without an id. A row is known by its id: rows with the query's id are not candidates, equal
rows of an id count once, and different rows of one id each. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tables import written
from spanloom.llm.vectors import chunks, finite, matrix, value_type
from spanloom.session import ship_package

NEIGHBOURS = 20
RECALL = 0.95
LIST_ROWS, TWO_LISTS = 256, 1024
# The sample behind the centroids, in numbers (32 MB), and its rows per centroid.
SAMPLE_VALUES, SAMPLE_ROWS = 1 << 23, 16
COPIES, BOUNDARY = 4, 1.02
TRIALS = 64
# Centroids kept while searching, and edges per centroid.
BEAM, EDGES = 32, 16
POINTS = 2048
BLOCK_BYTES = 256 << 10
HELD_QUERIES = 1 << 15
_ROUNDS = 3
_CHAIN = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.binary())])
_BLOCKS = pa.schema([("list", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_CHAIN_DDL, _BLOCKS_DDL = "list int, vec_id bigint, vector binary", "list int, ids binary, vectors binary"
_FOUND_DDL = "query_id bigint, vec_id bigint, score double"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


# --- centroids --------------------------------------------------------------------------------------------------------


def balanced_parts(points: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each point: halves along the line between the halves' means, in proportion to the parts each gets."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(points), np.int64)
    stack = [(np.arange(len(points)), 0, parts)]
    while stack:
        own, first, count = stack.pop()
        out[own] = first
        if count < 2 or len(own) < 2:
            continue
        left = count // 2
        a, b = points[rng.choice(own, 2, replace=False)]
        line = b - a
        for _ in range(4):
            order = own[np.argsort(points[own] @ line, kind="stable")]
            cut = len(own) * left // count
            line = points[order[cut:]].mean(axis=0) - points[order[:cut]].mean(axis=0) if 0 < cut < len(own) else line
        stack += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    return out


def centroids(points: np.ndarray, parts: int) -> np.ndarray:
    """Means of the balanced parts after some assignments in which a list costs more the longer it is."""
    own = balanced_parts(points, parts)
    for step in range(_ROUNDS + 1):
        sizes = np.bincount(own, minlength=parts)
        sums = np.zeros((parts, points.shape[1]))
        np.add.at(sums, own, points)
        means = (sums / np.maximum(sizes, 1)[:, None])[sizes > 0].astype(np.float32)
        if step == _ROUNDS or len(means) < parts:
            return means
        for at in range(0, len(points), POINTS):
            d = squared_distances(points[at : at + POINTS], means)
            load = d.min(axis=1).mean() * 0.1 * sizes / sizes.mean()
            own[at : at + POINTS] = (d + load).argmin(axis=1)
    return means


@dataclass(frozen=True)
class Graph:
    """Centroids and, for each, the numbers of near ones; neighbours in number keep the graph connected."""

    points: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> Graph:
        count = len(points)
        wanted = min(EDGES, count - 1)
        near = np.zeros((count, wanted), np.int64)
        for at in range(0, count, POINTS):
            d = squared_distances(points[at : at + POINTS], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + POINTS] = np.argpartition(d, max(wanted - 1, 0), axis=1)[:, :wanted]
        chain = np.arange(count)
        edges = np.concatenate([near, np.maximum(chain - 1, 0)[:, None], np.minimum(chain + 1, count - 1)[:, None]], axis=1)
        # Edges lead back as well, as far as there is room.
        back = [[] for _ in range(count)]
        for a, row in enumerate(near):
            for b in row:
                if len(back[b]) < EDGES:
                    back[b].append(a)
        room = np.array([b + [i] * (EDGES - len(b)) for i, b in enumerate(back)], np.int64).reshape(count, EDGES)
        entries = np.unique(np.linspace(0, count - 1, min(count, max(8, int(count**0.5)))).astype(np.int64))
        return Graph(points, np.concatenate([edges, room], axis=1), entries)

    def search(self, x: np.ndarray, beam: int, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each point (first array) the centroids kept (second), nearest first, and their distances.

        Kept are the ``beam`` nearest seen and all within ``ratio`` times the nearest one's distance; each is expanded once.
        """
        count, total = len(self.points), len(x)
        lengths = (self.points * self.points).sum(axis=1)
        own = (x * x).sum(axis=1)
        seen = np.zeros((total, count), bool)
        seen[:, self.entries] = True
        point = np.repeat(np.arange(total), len(self.entries))
        node = np.tile(self.entries, total)
        d = np.sqrt(squared_distances(x, self.points[self.entries])).reshape(-1)
        fresh = np.ones(len(node), bool)
        while True:
            order = np.lexsort((node, d, point))
            point, node, d, fresh = point[order], node[order], d[order], fresh[order]
            first = np.searchsorted(point, np.arange(total))
            keep = (np.arange(len(point)) - first[point] < beam) | (d <= ratio * d[first][point])
            point, node, d, fresh = point[keep], node[keep], d[keep], fresh[keep]
            if not fresh.any():
                return point, node, d
            at = np.repeat(point[fresh], self.edges.shape[1])
            to = self.edges[node[fresh]].reshape(-1)
            new = ~seen[at, to]
            pair = np.unique(at[new] * count + to[new])
            at, to = pair // count, pair % count
            seen[at, to] = True
            found = np.sqrt(np.maximum(own[at] + lengths[to] - 2 * np.einsum("ij,ij->i", x[at], self.points[to]), 0))
            point, node, d = np.concatenate([point, at]), np.concatenate([node, to]), np.concatenate([d, found])
            fresh = np.concatenate([np.zeros(len(point) - len(at), bool), np.ones(len(at), bool)])


@dataclass(frozen=True)
class Index:
    """What assigns rows and queries to lists. ``longest``: the largest squared length of a vector."""

    graph: Graph
    longest: float
    dims: int

    def extended(self, x: np.ndarray) -> np.ndarray:
        """Rows with the entry that gives all of them the same length."""
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def query(self, x: np.ndarray) -> np.ndarray:
        """Queries have no such entry; scaled to the rows' length, which changes no order of candidates."""
        scale = np.sqrt(self.longest / (x * x).sum(axis=1))
        return np.concatenate([x * scale[:, None], np.zeros((len(x), 1))], axis=1).astype(np.float32)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list and those nearly as near."""
        point, node, d = self.graph.search(self.extended(x), BEAM)
        first = np.searchsorted(point, np.arange(len(x)))
        keep = (np.arange(len(point)) - first[point] < COPIES) & (d <= BOUNDARY * d[first][point])
        return point[keep], node[keep]

    def read(self, x: np.ndarray, ratio: float, sizes: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list): the lists within the ratio, and more until they hold the wanted number of rows."""
        point, node, d = self.graph.search(self.query(x), BEAM, ratio)
        first = np.searchsorted(point, np.arange(len(x)))
        rows = np.cumsum(sizes[node])
        before = rows - sizes[node] - np.where(first > 0, rows[first - 1], 0)[point]
        # Every row is in at most COPIES lists.
        keep = (d <= ratio * d[first][point]) | (before < COPIES * wanted)
        held = np.bincount(point[keep], weights=sizes[node[keep]], minlength=len(x))
        short = np.flatnonzero(held < min(COPIES * wanted, sizes.sum()))
        whole = np.isin(point, short)
        keep &= ~whole
        every = np.arange(len(sizes))
        return (
            np.concatenate([point[keep], np.repeat(short, len(every))]),
            np.concatenate([node[keep], np.tile(every, len(short))]),
        )


# --- rows -------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that can take part, if their length is right."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda c: c != 0))


def _squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))


def fit(rows: DataFrame, dims: int, count: int, longest: float) -> Index:
    """Centroids of a bounded sample, and their graph."""
    bound = max(1, SAMPLE_VALUES // dims)
    share = min(1.0, 0.95 * bound / count)
    sample = rows.select("embedding") if share == 1.0 else rows.select("embedding").where(F.rand(11) < share).limit(bound)
    values = matrix(sample.toArrow()["embedding"], dims)
    index = Index(Graph(np.zeros((0, dims + 1), np.float32), np.zeros((0, 0), np.int64), np.zeros(0, np.int64)), longest, dims)
    points = index.extended(values)
    parts = 1 if count <= TWO_LISTS else max(2, min(count // LIST_ROWS, len(points) // SAMPLE_ROWS))
    return Index(Graph.of(centroids(points, parts)), longest, dims)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: higher scores first, then smaller ids; equal (id, score) count once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return ids[new][:k], scores[new][:k]


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever its row lies."""
    return np.add.reduce(rows.astype(np.float64) * query.astype(np.float64), axis=1)


def scanned(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query the best k of these rows. The product over all only selects; what it keeps is scored row by row."""
    rough = queries.astype(np.float64) @ rows.astype(np.float64).T
    rough[query_ids[:, None] == ids] = -np.inf
    slack = 1e-9 * np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1) * (rows.astype(np.float64) ** 2).sum(axis=1).max())
    # Repeated rows take several places, so a row more is kept for each id that occurs again.
    wanted = k + len(ids) - len(np.unique(ids))
    least = np.partition(rough, -wanted, axis=1)[:, -wanted] if wanted < rough.shape[1] else np.full(len(rough), -np.inf)
    for q in range(len(queries)):
        near = np.flatnonzero((rough[q] >= least[q] - slack[q]) & (rough[q] > -np.inf))
        if len(near):
            yield q, *best_of(ids[near], scores(queries[q], rows[near]), k)


def exact_neighbours(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, dims: int, dtype: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, embedding, place): the exact neighbours of a bounded set of queries, by one pass over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for part in chunks(batches, POINTS):
            ids, values = part["vec_id"].to_numpy(), matrix(part["embedding"], dims, dtype)
            for q, near, score in scanned(query_ids, queries, ids, values, k):
                place = {i: at for at, i in enumerate(ids.tolist())}
                own = best.setdefault(q, [])
                own += [(-s, i, values[place[i]].astype(np.float64)) for s, i in zip(score.tolist(), near.tolist(), strict=True)]
                own.sort(key=lambda x: x[:2])
                del own[k:]
        out = [(int(query_ids[q]), i, -s, v.tolist()) for q, own in best.items() for s, i, v in own]
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score", "embedding"), zip(*out, strict=True), strict=True)))

    found = rows.mapInArrow(run, f"{_FOUND_DDL}, embedding array<double>")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(f"place <= {k}")


def measured_ratio(index: Index, rows: DataFrame, queries: DataFrame, dtype: str, k: int, recall: float) -> float:
    """The smallest ratio at which the lists read hold this share of the neighbours of some queries."""
    trial = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).dropDuplicates(["vec_id"]).toArrow()
    if not trial.num_rows or len(index.graph.points) == 1:
        return 1.0
    ids, values = trial["vec_id"].to_numpy(), matrix(trial["embedding"], index.dims)
    found = exact_neighbours(rows, ids, values, index.dims, dtype, k).select("query_id", "embedding").toArrow()
    if not found.num_rows:
        return 1.0
    of = {i: at for at, i in enumerate(ids.tolist())}
    query = np.array([of[i] for i in found["query_id"].to_pylist()])
    row, lists = index.lists(matrix(found["embedding"], index.dims))
    d = np.sqrt(squared_distances(index.query(values), index.graph.points))
    ratios = d[query[row], lists] / np.maximum(d.min(axis=1)[query[row]], 1e-12)
    needed = np.full(len(query), np.inf)
    np.minimum.at(needed, row, ratios)
    return float(np.quantile(needed, recall, method="higher")) * (1 + 1e-6)


# --- search -----------------------------------------------------------------------------------------------------------


def _chained(select, dims: int, dtype: str):
    """Rows with each of their lists. ``select``: (row, list) of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, POINTS):
            ids, values = part["vec_id"].to_numpy(), matrix(part["embedding"], dims, dtype)
            row, lists = select(values.astype(np.float64))
            for at in range(0, len(row), POINTS):
                own = row[at : at + POINTS]
                cells = pa.array([v.tobytes() for v in values[own]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lists[at : at + POINTS], pa.int32()), pa.array(ids[own]), cells], schema=_CHAIN)

    return run


def _blocks(chain: DataFrame, width: int) -> DataFrame:
    """Rows of a list as blocks of bounded size, dealt over all tasks alike however long a list is."""
    most = max(16, BLOCK_BYTES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 4 * most):
            lists = part["list"].to_numpy()
            ids, cells = part["vec_id"].to_numpy(), part["vector"].to_pylist()
            for at in _starts(lists, most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lists[at[0]]], pa.int32()), pa.array([ids[slice(*at)].tobytes()], pa.binary()), pa.array([b"".join(cells[slice(*at)])], pa.binary())],
                    schema=_BLOCKS,
                )

    mixed = F.xxhash64("vec_id", "vector")
    return chain.repartitionByRange(F.col("list"), mixed).sortWithinPartitions("list", mixed).mapInArrow(run, _BLOCKS_DDL)


def _starts(lists: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for at in range(a, b, most):
            yield at, min(at + most, b)


def _scan(dims: int, dtype: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for q_ids, q_vectors, ids, vectors in zip(*(batch[c] for c in ("q_ids", "q_vectors", "ids", "vectors")), strict=True):
                own = np.frombuffer(q_ids.as_py(), np.int64)
                near = scanned(
                    own,
                    np.frombuffer(q_vectors.as_py(), dtype).reshape(-1, dims),
                    np.frombuffer(ids.as_py(), np.int64),
                    np.frombuffer(vectors.as_py(), dtype).reshape(-1, dims),
                    k,
                )
                for q, found, score in near:
                    query = int(own[q])
                    if query in best:
                        found, score = np.concatenate([best[query][0], found]), np.concatenate([best[query][1], score])
                    best[query] = best_of(found, score, k)
                if len(best) >= HELD_QUERIES:
                    yield _found(best)
                    best.clear()
        if best:
            yield _found(best)

    return run


def _found(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    counts = [len(ids) for ids, _ in best.values()]
    columns = [np.repeat(np.fromiter(best, np.int64), counts), *(np.concatenate(c) for c in zip(*best.values(), strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND)


def nearest(
    vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """The k nearest found for the rows that ``queries`` (over vec_id) holds for: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    ship_package(spark)
    dtype = value_type(vectors, embedding)
    rows = usable(vectors, vec_id, embedding)
    by_length = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("count"), F.max(_squared("embedding")).alias("longest"))
    table = by_length.orderBy(F.desc("count"), F.desc("dims")).first()
    if table is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims = table["dims"]
    rows = rows.where(F.size("embedding") == dims)
    asked = rows.where(queries)
    index = fit(rows, dims, table["count"], table["longest"])
    ratio = measured_ratio(index, rows, asked, dtype, k, recall)
    chain = written(rows.mapInArrow(_chained(index.lists, dims, dtype), _CHAIN_DDL), "postings")
    sizes = np.zeros(len(index.graph.points), np.int64)
    for r in chain.groupBy("list").count().collect():  # one row per centroid
        sizes[r["list"]] = r["count"]
    # Tables of few rows are read whole: every other row is a candidate then.
    wanted = k + 1 if table["count"] > TWO_LISTS else table["count"]
    read = written(asked.mapInArrow(_chained(lambda x: index.read(x, ratio, sizes, wanted), dims, dtype), _CHAIN_DDL), "read")
    width = dims * np.dtype(dtype).itemsize
    ours, theirs = _blocks(chain, width), _blocks(read, width)
    met = ours.join(theirs.select("list", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "list")
    found = met.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(_scan(dims, dtype, k), _FOUND_DDL)
    # A row found in several lists ties with itself, so the dense rank counts it once.
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()
