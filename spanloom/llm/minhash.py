"""MinHash fingerprints of word shingles.

Each of the signature's values is the minimum of one universal hash (odd multiplier and offset modulo 2**64, upper half kept)
over a text's 5-word shingles; the share of equal values estimates the Jaccard similarity. Bands of the signature are joined
in Spark, and what meets in a band is verified by exact Jaccard similarity (``near_duplicates``).

Equal texts have equal signatures. Texts without words (null, empty) share the signature of the empty set; in
``near_duplicates`` they link with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.set_join import SETS, SETS_DDL, linked, packed_set
from spanloom.llm.tables import small_batches, written
from spanloom.llm.textarrays import mix, shingle_sets

PERMUTATIONS = 128
# Bands of 4 values: two sets of similarity 0.8 meet in one with probability 1 - (1 - 0.8**4)**32, over 0.99999.
BAND_ROWS = 4
SHINGLE_WORDS = 5
_SLICE = 2048


class Permutations:
    def __init__(self, count: int = PERMUTATIONS, seed: int = 1):
        random = np.random.default_rng(seed)
        self.factor = (random.integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.offset = random.integers(0, 2**64, count, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of every permutation over a set of 64-bit shingle hashes."""
        least = np.full(len(self.factor), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), _SLICE):
            values = self.factor[:, None] * shingles[None, at : at + _SLICE]
            values += self.offset[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def signatures(texts: pa.Array | pa.ChunkedArray, permutations: Permutations | None = None) -> np.ndarray:
    """One signature (row) per text."""
    permutations = permutations or Permutations()
    sets = shingle_sets(texts, SHINGLE_WORDS)
    return np.array([permutations.signature(s) for s in sets], np.uint32).reshape(len(sets), len(permutations.factor))


def hexed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.astype(">u4").tobytes().hex() for r in rows], pa.string())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal signature) of every row."""
    small_batches(docs.sparkSession)

    def sign(batches):
        permutations = Permutations()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], hexed(signatures(b["text"], permutations))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id (smallest id reached by links) of every row; links are band matches of enough Jaccard similarity."""
    small_batches(docs.sparkSession)

    def band(batches):
        permutations = Permutations()
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n": [], "own": [], "keys": [], "members": []}
            for i, shingles in zip(b["doc_id"].to_pylist(), shingle_sets(b["text"], SHINGLE_WORDS), strict=True):
                values = permutations.signature(shingles).reshape(-1, BAND_ROWS).astype(np.uint64)
                number = np.arange(len(values), dtype=np.uint64)
                keys = number
                for column in values.T:
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
                known = len(shingles) and i is not None
                for name, value in zip(out, (i, len(shingles), 0, keys.astype(np.int64) if known else [], packed_set(shingles)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=SETS)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = written(rows.mapInArrow(band, SETS_DDL), "bands")
    lists = sets.select("doc_id", "n", "own", F.explode("keys").alias("key"), F.lit(0).alias("place"))
    labels = linked(lists, sets.select("doc_id", "members"), threshold)
    return sets.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
