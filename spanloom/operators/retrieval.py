"""Batch vector search by cosine distance, and text embedding with a pluggable embedder.

Exact: every stored vector is compared with every query, as matrix products of bounded blocks. Each block keeps the best k
per query, so only k rows per query and block are shuffled, never the pairs. Within a block only vectors that are not farther
than a query's k-th best so far are sorted, all others cost their product and one comparison. Distances are rounded to
``DIGITS`` places, so that vectors equally far tie by id however the products were summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import top_rows
from spanloom.session import ship_package

# Both sides are cut into blocks of at least about this many rows. Every row is sent once per block of the other side, so blocks of
# large tables grow, up to so many times as much, as long as there are still this many of them on a side.
BLOCK_ROWS = 8_192
BLOCK_GROWTH = 8
SIDE_BLOCKS = 12
# A block is compared in slices of so many queries and stored vectors.
SLICE_ROWS = 1_024
DIGITS = 9

RESULT = "query_id long, id long, distance double"


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Best:
    """The k nearest ids seen so far for each of a block of queries."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.ids = np.zeros((len(query_ids), k), dtype=np.int64)
        self.distances = np.full((len(query_ids), k), np.inf)
        self.found = np.zeros((len(query_ids), k), dtype=bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compare vectors with all queries, or with those at the given places."""
        rows = np.arange(len(self.query_ids)) if rows is None else rows
        order = np.argsort(ids, kind="stable")  # so that most vectors as far as the k-th best come after it
        ids, vectors = ids[order], vectors[order]
        for j in range(0, len(rows), SLICE_ROWS):
            for i in range(0, len(ids), SLICE_ROWS):
                self._add(ids[i : i + SLICE_ROWS], vectors[i : i + SLICE_ROWS], rows[j : j + SLICE_ROWS])

    def _add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        products = self.queries[rows] @ vectors.T
        step = 10.0**-DIGITS
        # The least product of unit vectors that can still count, with room for rounding. What is as far as the k-th best counts if
        # its id is smaller.
        ties = np.where(ids[0] > self.ids[rows, -1], -0.4, 1.0) * step
        least = np.where(self.found[rows, -1], 1.0 - self.distances[rows, -1] - ties, np.nan)
        new = np.isnan(least)
        if new.any() and len(ids) >= self.k:
            # The first vectors a query meets: its k nearest among them are the bound.
            least[new] = -np.partition(-products[new], self.k - 1, axis=1)[:, self.k - 1] - step
        # Not "below the bound", rather than "at or above": a product that is no number counts too.
        q, v = np.divmod(np.flatnonzero(~(products < least[:, None])), len(ids))
        if not len(q):
            return
        far = np.round(1.0 - products[q, v], DIGITS)
        at = rows[q]
        last, full = self.distances[at, -1], self.found[at, -1]
        better = ~full | (far < last) | ((far == last) & (ids[v] < self.ids[at, -1])) | np.isnan(last)
        if better.any():
            self._fold(q[better], far[better], ids[v[better]], rows)

    def _fold(self, q: np.ndarray, far: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Sorts candidates, in order of the places ``q`` of their queries in ``rows``, with the best these have."""
        own, counts = np.unique(q, return_counts=True)
        starts = np.cumsum(counts) - counts
        # Queries with few candidates apart from those with many: a group is as wide as its widest row.
        for some in (counts <= 32, counts > 32):
            if not some.any():
                continue
            at, width = rows[own[some]], int(counts[some].max())
            row = np.repeat(np.arange(len(at)), counts[some])
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
            mine = np.repeat(starts[some], counts[some]) + place
            shape = (len(at), self.k + width)
            away, named, real = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
            away[:, : self.k], named[:, : self.k], real[:, : self.k] = self.distances[at], self.ids[at], self.found[at]
            away[row, self.k + place], named[row, self.k + place], real[row, self.k + place] = far[mine], ids[mine], True
            order = np.lexsort((named, away, ~real), axis=1)[:, : self.k]
            self.distances[at], self.ids[at], self.found[at] = (np.take_along_axis(x, order, axis=1) for x in (away, named, real))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, self.found.sum(axis=1)),
                "id": self.ids[self.found],
                "distance": self.distances[self.found],
            }
        )


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = [F.col("distance"), F.col("id")]
    return top_rows(partial, ["query_id"], order, k)


def nearest_by_blocks(
    vectors: DataFrame, queries: DataFrame, k: int, vector_blocks: int, query_blocks: int
) -> DataFrame:
    """Both sides hashed into blocks; each pair of blocks is one bounded group."""

    def block(name: str, n: int):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.select("id", "embedding", block("id", vector_blocks).alias("vb")).withColumn("qb", every(query_blocks))
    right = queries.select("query_id", "embedding", block("query_id", query_blocks).alias("qb")).withColumn(
        "vb", every(vector_blocks)
    )

    def search(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if stored.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        best = _Best(asked["query_id"].to_numpy(np.int64), _unit(asked["embedding"]), k)
        best.add(stored["id"].to_numpy(np.int64), _unit(stored["embedding"]))
        return best.frame()

    ship_package(vectors.sparkSession)
    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb"))
    return _ranked(pairs.applyInPandas(search, RESULT), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest vectors of each query: (query_id, id, distance).

    ``vectors`` has (id, embedding), ``queries`` (query_id, embedding).
    """
    asked, stored = (_blocks(df.count()) for df in (queries, vectors))
    return nearest_by_blocks(vectors, queries, k, stored, asked)


def _blocks(rows: int) -> int:
    """Blocks of a side of so many rows."""
    return max(1, min(-(-rows // BLOCK_ROWS), max(SIDE_BLOCKS, -(-rows // (BLOCK_GROWTH * BLOCK_ROWS)))))


# --- the same result with pivots: cells that cannot hold a nearer vector are not searched ---

MOST_PIVOTS = 1024
# Slack for rounding in the bounds, far above the error of a distance and below what changes the work.
SLACK = 1e-7


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight-line distances between unit vectors: a metric, unlike 1 - cosine, of which it is sqrt(2 x)."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _celled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, embedding, cell, reach): the nearest pivot and its distance. Vectors of length zero are a cell of their own, -1."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                unit = _unit(rows["embedding"])
                far = _chords(unit, pivots)
                cell = np.where(unit.any(axis=1), far.argmin(axis=1), -1)
                yield rows.assign(cell=cell.astype(np.int32), reach=far.min(axis=1))

    return vectors.select("id", "embedding").mapInPandas(assign, "id long, embedding array<double>, cell int, reach double")


class Cells:
    """Pivots with the size and radius of their cells, and which cells a query has to read."""

    def __init__(self, pivots: np.ndarray, counts: dict[int, int], radii: dict[int, float]):
        self.pivots = pivots
        self.counts = np.array([counts.get(c, 0) for c in range(len(pivots))], np.int64)
        self.radii = np.array([radii.get(c, 0.0) for c in range(len(pivots))])
        self.zeros = counts.get(-1, 0)

    def _always(self) -> np.ndarray:
        return np.array([-1] if self.zeros else [], np.int64)

    def near(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """The nearest cells that together hold k vectors."""
        out = []
        for far in _chords(queries, self.pivots):
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(self.counts[order]), k) + 1
            out.append(np.concatenate([self._always(), order[:enough][self.counts[order[:enough]] > 0]]))
        return out

    def able(self, queries: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The cells that can hold a vector within the bound (a distance 1 - cosine), by the triangle inequality."""
        least = np.maximum(_chords(queries, self.pivots) - self.radii, 0.0)
        possible = (least * least / 2 <= bounds[:, None] + SLACK) & (self.counts > 0)
        # A query of length zero is at distance 1 of everything.
        possible |= ~queries.any(axis=1)[:, None] & (self.counts > 0)
        return [np.concatenate([self._always(), np.flatnonzero(row)]) for row in possible]


def _shelves(counts: dict[int, int]) -> dict[int, int]:
    """The shelf of each cell: cells are put together until they hold a block of vectors, so that a query is sent to few places."""
    full = _block_rows(sum(counts.values()))
    shelf, held, out = 0, 0, {}
    for cell in sorted(counts):
        if held and held + counts[cell] > full:
            shelf, held = shelf + 1, 0
        out[cell], held = shelf, held + counts[cell]
    return out


def _block_rows(rows: int) -> int:
    return max(1, -(-rows // _blocks(rows)))


def _routed(queries: DataFrame, cells: Callable[[pd.DataFrame], list[np.ndarray]], shelves: dict[int, int]) -> DataFrame:
    """(query_id, embedding, shelf, cells): a query once per shelf that has a cell it reads, with its cells there."""
    of = np.zeros(max(shelves, default=0) + 2, np.int32)  # by cell; cell -1 comes last
    for cell, shelf in shelves.items():
        of[cell] = shelf

    def sent(rows: pd.DataFrame) -> pd.DataFrame:
        places, shelf, lists = [], [], []
        for i, wanted in enumerate(cells(rows)):
            at = of[wanted]
            for one in np.unique(at):
                places.append(i)
                shelf.append(one)
                lists.append(wanted[at == one].astype(np.int32))
        out = rows[["query_id", "embedding"]].iloc[places].reset_index(drop=True)
        return out.assign(shelf=np.array(shelf, np.int32), cells=pd.Series(lists, dtype="object"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), SLICE_ROWS):
                yield sent(rows.iloc[i : i + SLICE_ROWS])

    return queries.mapInPandas(route, "query_id long, embedding array<double>, shelf int, cells array<int>")


def _compared(celled: DataFrame, routes: DataFrame, k: int, shelves: dict[int, int], counts: dict[int, int]) -> DataFrame:
    """The best k of the cells each query reads. Shelves and the queries of a shelf are both cut into bounded blocks."""
    asked = {r["shelf"]: r["count"] for r in routes.groupBy("shelf").count().collect()}  # one row per shelf
    held: dict[int, int] = {}
    for cell, shelf in shelves.items():
        held[shelf] = held.get(shelf, 0) + counts[cell]
    # A shelf with one cell can hold more than a block.
    full = _block_rows(sum(counts.values()))
    wanted_rows = _block_rows(max(asked.values(), default=1))
    sizes = [(s, max(1, -(-held.get(s, 0) // full)), max(1, -(-asked[s] // wanted_rows))) for s in asked]
    spark = celled.sparkSession
    shape = F.broadcast(spark.createDataFrame(sizes, "shelf int, vbs int, qbs int"))
    shelved = celled.join(F.broadcast(spark.createDataFrame([*shelves.items()], "cell int, shelf int")), "cell")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = shelved.join(shape, "shelf").withColumn("vb", F.pmod(F.xxhash64("id"), F.col("vbs")).cast("int")).withColumn("qb", every("qbs"))
    right = routes.join(shape, "shelf").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qbs")).cast("int")).withColumn("vb", every("vbs"))

    def search(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if stored.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        best = _Best(wanted["query_id"].to_numpy(np.int64), _unit(wanted["embedding"]), k)
        ids, vectors, cells = stored["id"].to_numpy(np.int64), _unit(stored["embedding"]), stored["cell"].to_numpy()
        lists = wanted["cells"].to_list()
        reads, places = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        for cell in np.unique(cells):
            mine = cells == cell
            best.add(ids[mine], vectors[mine], places[reads == cell])
        return best.frame()

    groups = ("shelf", "vb", "qb")
    pairs = left.select(*groups, "id", "embedding", "cell").groupBy(*groups).cogroup(right.select(*groups, "query_id", "embedding", "cells").groupBy(*groups))
    return _ranked(pairs.applyInPandas(search, RESULT), k)


def nearest_by_pivots(vectors: DataFrame, queries: DataFrame, k: int = 3, pivots: int | None = None, tell: dict[str, int] | None = None) -> DataFrame:
    """What ``nearest`` finds, row for row, without comparing every pair.

    Vectors are dealt to their nearest of some pivots. A query first reads the nearest cells that hold k vectors; the k-th
    distance found bounds what can still be nearer, and only cells whose pivot and radius allow that are read then.
    ``tell`` gets the pairs compared (``pairs``) and all there are (``all``). Pivots, sizes and radii, at most ``MOST_PIVOTS`` of
    each, pass the driver.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    count = vectors.count()
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, pivots or max(1, int(count**0.5)))).select("embedding").toPandas()
    if picked.empty:
        return spark.createDataFrame([], RESULT)
    celled = _celled(vectors, _unit(picked["embedding"]))
    stats = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()
    counts = {r["cell"]: r["n"] for r in stats}
    cells = Cells(_unit(picked["embedding"]), counts, {r["cell"]: r["radius"] for r in stats})
    shelves = _shelves(counts)
    near = _routed(queries.select("query_id", "embedding"), lambda rows: cells.near(_unit(rows["embedding"]), k), shelves)
    first = _compared(celled, near, k, shelves, counts)
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(2.0)).alias("bound"))
    bounded = queries.select("query_id", "embedding").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)))
    routes = _routed(bounded, lambda rows: cells.able(_unit(rows["embedding"]), rows["bound"].to_numpy(float)), shelves)
    if tell is not None:
        tell["all"] = count * queries.count()
        read = routes.select(F.explode("cells").alias("cell")).groupBy("cell").count()
        tell["pairs"] = sum(r["count"] * counts.get(r["cell"], 0) for r in read.collect())
    return _compared(celled, routes, k, shelves, counts)


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Text and metadata of the hits."""
    return hits.join(documents, "id", "left")


Embedder = Callable[[list[str]], list[list[float]]]


def embed(df: DataFrame, text: str, embedder: Callable[[], Embedder], name: str = "embedding") -> DataFrame:
    """Adds an embedding of a text column. The embedder is made once per partition and sees Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            yield pd.Series(model([t or "" for t in texts]))

    ship_package(df.sparkSession)
    return df.withColumn(name, F.pandas_udf(run, "array<float>")(F.col(text)))


def hashing_embedder(dimensions: int = 64) -> Callable[[], Embedder]:
    """Deterministic embedder for tests: words counted in dimensions named by the first byte of their MD5 digest."""

    def one(text: str) -> list[float]:
        vector = [0.0] * dimensions
        for word in text.lower().split():
            vector[hashlib.md5(word.encode()).digest()[0] % dimensions] += 1.0
        return vector

    return lambda: lambda texts: [one(t) for t in texts]
