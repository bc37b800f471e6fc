"""Removal of repeated multi-line chunks with content-defined boundaries.

A rolling hash runs over every two consecutive lines (blank lines between them included). Of any two neighbouring positions the
one with the smaller hash is a boundary, so boundaries depend on three lines only: inserted or deleted lines move the ones next
to them, and a run of three lines or more has the same boundaries wherever it stands. The chunk at a boundary is its two lines.

Of chunks with equal bytes anywhere in the corpus the first (smallest id, then place) stays and the others go. Hashes of 64 bits
find the candidates; the bytes of the chunk that stays, with the line before and the line after it, travel to the packs that
repeat it, are compared there, and a match is extended by either line that is equal too. Boundaries are at most two lines apart, so
the chunks and extensions of a repeated run cover all of it. A run of two lines goes only if its position is a boundary in
both places. Where a chunk's first copy stands in other surroundings than the run, the line at the run's end may stay.

A null text stays null and has no lines; rows with a null id come after all others; repeated rows are repeated chunks; empty
tables give no rows; all columns are kept, columns of the two counts' names are replaced. Blank lines make no chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.packs import decode, packed
from spanloom.llm.tables import written
from spanloom.llm.textarrays import SPACES, span_hashes, utf8


class Lines:
    """Lines and boundaries of many texts at once; all numbers run over the texts together."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        self.raw, offsets = utf8(texts)
        feeds = np.flatnonzero(self.raw == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
        # Every text has one line more than line feeds.
        self.first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
        inked = np.concatenate([[0], np.cumsum(~SPACES[self.raw])])
        self.inked = np.flatnonzero(inked[self.ends] > inked[self.starts])
        own = np.searchsorted(self.first, self.inked, "right") - 1
        # Pairs of consecutive lines of one text that are not blank, by the place of the first one among such lines.
        self.pairs = np.flatnonzero(own[1:] == own[:-1])
        self.owner = own[self.pairs]
        self.hashes = span_hashes(self.raw, self.starts[self.inked[self.pairs]], self.ends[self.inked[self.pairs + 1]])
        self.boundary = boundaries(self.hashes, self.owner)

    def chunk(self, pair: int) -> bytes:
        at = self.pairs[pair]
        return self.raw[self.starts[self.inked[at]] : self.ends[self.inked[at + 1]]].tobytes()

    def before(self, pair: int) -> bytes | None:
        """From the line before the chunk up to the chunk; None at the start of a text."""
        at = self.pairs[pair]
        if pair == 0 or self.pairs[pair - 1] != at - 1:
            return None
        return self.raw[self.starts[self.inked[at - 1]] : self.starts[self.inked[at]]].tobytes()

    def after(self, pair: int) -> bytes | None:
        at = self.pairs[pair]
        if pair + 1 == len(self.pairs) or self.pairs[pair + 1] != at + 1:
            return None
        return self.raw[self.ends[self.inked[at + 1]] : self.ends[self.inked[at + 2]]].tobytes()

    def covered(self, pair: int, before: bool = False, after: bool = False) -> tuple[int, int]:
        """First line and end line of a chunk, with its extensions."""
        at = self.pairs[pair]
        return int(self.inked[at - before]), int(self.inked[at + 1 + after]) + 1


def boundaries(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each position has the smaller hash of two neighbours of one text (the first one on a tie), or no neighbour."""
    out = np.zeros(len(hashes), bool)
    if len(hashes):
        linked = owner[1:] == owner[:-1]
        left = hashes[:-1] <= hashes[1:]
        out[:-1] |= linked & left
        out[1:] |= linked & ~left
        alone = np.concatenate([[True], ~linked]) & np.concatenate([~linked, [True]])
        out |= alone
    return out


def _describe(doc_id: str, text: str):
    def describe(rows: pa.Table) -> dict[str, object]:
        """The pack's distinct chunks, with their first place in it and their number."""
        lines = Lines(rows[text])
        at = np.flatnonzero(lines.boundary)
        column = rows[doc_id].combine_chunks()
        unnamed = ~column.is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(unnamed, 0, column.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        own = lines.owner[at]
        order = np.lexsort((at, ids[own], unnamed[own], lines.hashes[at])) if len(at) else at
        hashes = lines.hashes[at][order]
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(at) else at
        places = at[order][new]
        return {
            "ids": pa.array(ids[lines.owner[places]], mask=unnamed[lines.owner[places]]),
            "numbers": places.astype(np.int32),
            "digests": hashes[new].astype(np.int64),
            "copies": np.diff(np.append(new, len(at))).astype(np.int32),
        }

    return describe


_KEPT = pa.schema([("digest", pa.int64()), ("chunk", pa.binary()), ("line_before", pa.binary()), ("line_after", pa.binary())])
_KEPT_DDL = "digest bigint, chunk binary, line_before binary, line_after binary"


def _supply(text: str):
    def supply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _KEPT.empty_table()
        lines = Lines(decode(left["body"][0].as_py())[text])
        pairs = right["number"].to_pylist()
        parts = [[f(p) for p in pairs] for f in (lines.chunk, lines.before, lines.after)]
        return pa.table([right["digest"], *(pa.array(p, pa.binary()) for p in parts)], schema=_KEPT)

    return supply


def repeated_lines(lines: Lines, kept: dict[int, dict]) -> np.ndarray:
    """Which lines go. ``kept``: digest -> chunk, line_before, line_after and, if it stays in these texts, its number."""
    gone = np.zeros(len(lines.starts), bool)
    digests = lines.hashes.astype(np.int64)
    met = np.flatnonzero(lines.boundary & np.isin(digests, np.fromiter(kept, np.int64, len(kept))))
    for pair in met.tolist():
        stays = kept[int(digests[pair])]
        if pair == stays["number"] or lines.chunk(pair) != stays["chunk"]:
            continue
        before, after = lines.before(pair), lines.after(pair)
        a, b = lines.covered(
            pair, before is not None and before == stays["line_before"], after is not None and after == stays["line_after"]
        )
        if stays["number"] is None:
            gone[a:b] = True
        else:
            # A chunk that overlaps its own first copy leaves that copy's lines.
            first, end = lines.covered(stays["number"])
            gone[a : min(b, max(a, first))] = True
            gone[max(a, min(b, end)) : b] = True
    return gone


def _remove(text: str, names: list[str]):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = decode(left["body"][0].as_py())
        lines = Lines(rows[text])
        kept = {r["digest"]: r | {"number": r["number"] if r["here"] else None} for r in right.to_pylist()}
        gone = repeated_lines(lines, kept)
        cut = np.add.reduceat(gone.astype(np.int64), lines.first[:-1]) if len(gone) else np.zeros(rows.num_rows, np.int64)
        texts, total = rows[text].to_pylist(), np.diff(lines.first)
        for row in np.flatnonzero(cut).tolist():
            own = slice(lines.first[row], lines.first[row + 1])
            texts[row] = "\n".join(x for x, g in zip(texts[row].split("\n"), gone[own].tolist(), strict=True) if not g)
        filled = np.array([bool(t) for t in rows[text].to_pylist()])
        columns = {n: rows[n] for n in rows.schema.names}
        columns[text] = pa.array(texts, pa.string())
        columns |= {"n_lines": pa.array(np.where(filled, total, 0), pa.int64()), "n_removed_lines": pa.array(cut, pa.int64())}
        return pa.table([columns[n] for n in names], names=names)

    return remove


def without_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated chunks cut out of their texts, and the counts n_lines and n_removed_lines."""
    counts = ["n_lines", "n_removed_lines"]
    rows = docs.drop(*[c for c in counts if c in docs.columns])
    packs = packed(
        rows, "lines", describe=_describe(doc_id, text), described="ids array<bigint>, numbers array<int>, digests array<bigint>, copies array<int>"
    )
    found = packs.select("pack_id", F.explode(F.arrays_zip("ids", "numbers", "digests", "copies")).alias("c")).select(
        "pack_id", F.col("c.ids").alias("id"), F.col("c.numbers").alias("number"), F.col("c.digests").alias("digest"), F.col("c.copies").alias("copies")
    )
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "pack_id", "number")
    repeated = written(
        found.groupBy("digest").agg(F.sum("copies").alias("copies"), F.min(place).alias("first")).where("copies > 1").select("digest", "first.*"),
        "repeated",
    )
    bodies = packs.select("pack_id", "body")
    supplied = written(bodies.groupBy("pack_id").cogroup(repeated.groupBy("pack_id")).applyInArrow(_supply(text), _KEPT_DDL), "chunks")
    kept = repeated.select("digest", F.col("pack_id").alias("home"), "number").join(supplied, "digest")
    wanted = found.select("pack_id", "digest").join(kept, "digest")
    wanted = written(
        wanted.select("pack_id", "digest", "chunk", "line_before", "line_after", "number", (F.col("home") == F.col("pack_id")).alias("here")), "wanted"
    )
    schema = T.StructType(list(rows.schema.fields)).add("n_lines", T.LongType()).add("n_removed_lines", T.LongType())
    return bodies.groupBy("pack_id").cogroup(wanted.groupBy("pack_id")).applyInArrow(_remove(text, schema.names), schema)
