"""Whitening of embeddings from exact integer moments, counted on bit planes.

Every entry c becomes x = floor(64 c) + 1,000,000. Blocks of rows are shifted by their smallest values, cut into bit planes and
packed across rows into 64-bit words; the sum of products of two dimensions is the sum of popcounts of two planes' AND, each
times the planes' weights. Sums and products are exact integers up to the last step: the covariance is n * sum(x y) - sum(x)
sum(y), an integer, divided by n * n once; its eigenvectors project the centred vectors.

Tasks send their sums per pair of dimensions, which Spark adds up; only these d (d + 1) / 2 sums and the d x d covariance pass
the driver, whatever the number of rows.

Rows whose vector is null, empty or holds a null or non-finite entry are left out, as are rows with an entry of 2**56 or more,
whose x no long holds, and rows whose length is not the table's most frequent one (ties: the longer). A null id is kept.
Repeated rows count as often as they occur. Components without variance (rank-deficient input, a single row) get whitened 0
and explained 0 and take no part in the identity error. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.vectors import chunks, finite, matrix
from spanloom.session import ship_package

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(2**56)
# Rows packed at a time: 64 words per plane.
BLOCK = 4096
# Sums travel as high * 2**LIMB + low, so that no sum of them overflows.
LIMB = 40
# Up to so many bits, the sums of one block fit 64-bit integers.
_PLAIN_BITS = 24
_MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.int64())])
_ROWS = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def shifted(values: np.ndarray) -> np.ndarray:
    """x without the offset, which no covariance or deviation sees."""
    return np.floor(SCALE * values).astype(np.int64)


def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes (bit, dimension, word) of non-negative integers, 64 rows to a word."""
    rows, dims = y.shape
    bits = max(1, int(y.max()).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    padded[:rows] = y
    out = np.empty((bits, dims, len(padded) // 64), np.uint64)
    for b in range(bits):
        plane = ((padded.T >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(np.ascontiguousarray(plane), axis=1, bitorder="little").view("<u8")
    return out


def block_moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums per dimension and sums of products (upper triangle), exact."""
    rows, dims = x.shape
    low = x.min(axis=0)
    p = planes((x - low).astype(np.uint64))
    bits = len(p)
    plain = bits <= _PLAIN_BITS and int(np.abs(low).max()) < 1 << _PLAIN_BITS
    kind = np.int64 if plain else object
    weights = np.array([1 << b for b in range(bits)], kind)
    sums = weights @ np.bitwise_count(p).sum(axis=-1, dtype=np.int64).astype(kind)
    products = np.zeros((dims, dims), kind)
    for i in range(dims):
        for a in range(bits):
            counts = np.bitwise_count(p[:, i:] & p[a, i]).sum(axis=-1, dtype=np.int64)
            products[i, i:] += (weights @ counts.astype(kind)) << a
    low = low.astype(kind)
    products += low[:, None] * sums + sums[:, None] * low + rows * low[:, None] * low
    return rows, (sums + rows * low).astype(object), np.triu(products.astype(object))


def _moment_rows(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for rows in chunks(batches, BLOCK):
            own = block_moments(shifted(matrix(rows["embedding"], dims)))
            n, sums, products = n + own[0], sums + own[1], products + own[2]
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums, *products[i, j]]
            yield pa.RecordBatch.from_pydict(
                {
                    "i": np.concatenate([[-1], np.full(dims, -1), i]).astype(np.int32),
                    "j": np.concatenate([[-1], np.arange(dims), j]).astype(np.int32),
                    "high": [Decimal(int(v) >> LIMB) for v in values],
                    "low": [int(v) & ((1 << LIMB) - 1) for v in values],
                },
                schema=_MOMENTS,
            )

    return run


@dataclass(frozen=True)
class Whitening:
    """Fitted on all rows: their number, exact sums of x - 1,000,000, components as columns, eigenvalues, total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace if self.trace > 0 else 0.0 for e in self.eigenvalues]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        sums = np.array(self.sums, object)
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < 2**62:
            return self.n * x - sums.astype(np.int64)
        return self.n * x.astype(object) - sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        centred = (deviations / self.n).astype(np.float64)
        scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, 1)), 0)
        return (centred @ self.components) * scale


def squared_lengths(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares per row."""
    if deviations.dtype == np.int64 and int(np.abs(deviations).max(initial=0)) < 2**52 and deviations.shape[1] <= 1024:
        high, low = deviations >> 26, deviations & (2**26 - 1)
        parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]
    return (deviations.astype(object) ** 2).sum(axis=1).tolist()


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their dimensions (0: none)."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where(finite(F.col("embedding"), LARGEST))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    return rows.where(F.size("embedding") == dims), dims


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    ship_package(rows.sparkSession)
    sent = rows.select("embedding").mapInArrow(_moment_rows(dims), "i int, j int, high decimal(38,0), low bigint")
    added = sent.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    total = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in added}
    n, sums = total[-1, -1], [total[-1, j] for j in range(dims)]
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - sums[i] * sums[j]) / (n * n)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    # What rounding leaves of an eigenvalue of zero.
    values = np.where(values > dims * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    k = min(components, dims)
    return Whitening(n, sums, columns[:, :k].copy(), values[:k].copy(), float(np.trace(covariance)))


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = len(fitted.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, seen = np.zeros(k), np.zeros((k, k)), False
        for part in chunks(batches, BLOCK):
            white = fitted.whitened(fitted.deviations(shifted(matrix(part["embedding"], fitted.dims))))
            sums, products, seen = sums + white.sum(axis=0), products + white.T @ white, True
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pydict(
                {
                    "i": np.concatenate([np.full(k, -1), i]).astype(np.int32),
                    "j": np.concatenate([np.arange(k), j]).astype(np.int32),
                    "value": np.concatenate([sums, products[i, j]]),
                }
            )

    sent = rows.select("embedding").mapInArrow(run, "i int, j int, value double")
    total = {(r["i"], r["j"]): r["value"] for r in sent.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    worst = 0.0
    for i in range(k):
        for j in range(i, k):
            if fitted.eigenvalues[i] > 0 and fitted.eigenvalues[j] > 0:
                found = total[i, j] / fitted.n - total[-1, i] / fitted.n * (total[-1, j] / fitted.n)
                worst = max(worst, abs(found - (i == j)))
    return worst


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    rows, dims = usable(vectors, vec_id, embedding)
    if not dims:
        ddl = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], ddl)
    fitted = fit(rows, dims, components)
    error = identity_error(rows, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, BLOCK):
            deviations = fitted.deviations(shifted(matrix(part["embedding"], dims)))
            white = fitted.whitened(deviations)
            lengths = [Decimal(v) if v < 10**38 else None for v in squared_lengths(deviations)]
            flat = pa.array(white.reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), flat)
            ids = part["vec_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.decimal128(38, 0)), lists], schema=_ROWS)

    found = rows.mapInArrow(run, "vec_id bigint, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*map(F.lit, fitted.explained))
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
