"""Benchmark decontamination by CGK embeddings and bit sampling.

The CGK walk reads a word sequence with a random function of step and word that says whether to move on; sequences of small
edit distance become rows of small Hamming distance. Sampled places of the rows, in repeated independent walks, are the keys
of a locality-sensitive hash between item-sized windows of the documents and the items. Candidates are verified by exact
edit distance of words, with free ends in the document.

Windows start where they can: an item within k edits of a window, cut into k + 1 pieces, has one piece unchanged in it, so a
window is embedded wherever a piece of an item occurs, at the place the piece gives. This loses no match and leaves few windows.

Items are the query set: they come to the tasks in blocks of bounded size, every block against all documents; documents are
never shuffled, so a passage in a third of all documents costs each task its own share only.

Words are runs of letters and digits (A-Z as a-z; all non-ASCII bytes count as letters). Null and empty texts, and items
without words, match nothing. Repeated rows are repeated results; documents' other columns are not read, or kept (``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import small_batches
from spanloom.llm.textarrays import LOWER, mix, span_hashes, utf8, window_hashes, word_spans

# Edits allowed per item word.
EDITS = (1, 5)
# Share of equal places after the walk at that distance (measured: tests/llm/test_decontaminate.py), places per key, recall.
AGREEMENT, PLACES, RECALL = 0.5, 2, 0.99
REPEATS = ceil(log(1 - RECALL) / log(1 - AGREEMENT**PLACES))
# Words of the items that one block holds, and windows embedded at once.
BLOCK_WORDS, WINDOWS = 2_000_000, 256
_END = np.uint64(0x1F83D9ABFB41BD6B)

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words start."""
    raw, offsets = utf8(texts)
    raw = LOWER[raw]
    starts, ends, owner = word_spans(raw, offsets, SEPARATORS)
    return span_hashes(raw, starts, ends), np.searchsorted(owner, np.arange(len(offsets)))


def allowed(n: int) -> int:
    return n * EDITS[0] // EDITS[1]


def walk_keys(windows: np.ndarray, sizes: np.ndarray, seed: int = 7) -> np.ndarray:
    """Keys (windows x repeats) of word sequences; row i holds sizes[i] words, the rest is ignored."""
    n, longest = windows.shape
    random = np.random.default_rng(seed)
    steps = random.integers(0, 2**63, (3 * longest, REPEATS), dtype=np.uint64)
    padded = np.concatenate([windows, np.full((n, 1), _END)], axis=1)
    padded[np.arange(longest + 1)[None, :] >= sizes[:, None]] = _END
    # Places are drawn as shares of the walk's length, so that they depend on an item's size only.
    shares = np.random.default_rng(seed + 1).random((REPEATS, PLACES))
    places = (shares[None] * (3 * sizes[:, None, None])).astype(np.int64)
    at = np.zeros((n, REPEATS), np.int64)
    keys = np.zeros((n, REPEATS), np.uint64)
    rows, last = np.arange(n)[:, None], sizes[:, None]
    for t in range(3 * int(sizes.max(initial=0))):
        word = padded[rows, at]
        hit = places == t
        if hit.any():
            keys += np.where(hit, mix(word)[..., None] * np.arange(3, 3 + 2 * PLACES, 2, dtype=np.uint64), np.uint64(0)).sum(axis=2, dtype=np.uint64)
        at = np.minimum(at + (mix(word ^ steps[t]) & np.uint64(1)).astype(np.int64), last)
    number = np.arange(REPEATS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(keys + number[None, :] + sizes[:, None].astype(np.uint64))


def edits(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a run of ``part``, and that run's start and end."""
    m = len(part)
    place = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), place.copy()
    for i, word in enumerate(item, 1):
        down, diagonal = row + 1, np.full(m + 1, i)
        diagonal[1:] = row[:-1] + (part != word)
        origin = np.where(diagonal[1:] <= down[1:], start[:-1], start[1:])
        best = np.minimum(down, diagonal)
        from_start = np.concatenate([[start[0]], origin])
        # Extra words of the part: the best value to the left plus one per step.
        reach = np.minimum.accumulate((best - place) * (m + 2) + place)
        source = reach % (m + 2)
        row = best[source] + place - source
        start = from_start[source]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


@dataclass
class Block:
    """Some items with the tables that find them."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(self.sizes.max())
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for w in self.words:
            n = len(w)
            count = allowed(n) + 1
            q = n // count
            hashes = window_hashes(w, q)
            for i in range(count):
                at = i * n // count
                pieces.setdefault(q, []).append((int(hashes[at]), n, at))
        self.pieces = {}
        for q, rows in pieces.items():
            rows = sorted(set(rows))
            hashes = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.pieces[q] = (bits, hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        keys = np.concatenate([self._keys(range(a, min(a + WINDOWS, len(self.words)))) for a in range(0, len(self.words), WINDOWS)])
        owner = np.repeat(np.arange(len(self.words)), REPEATS)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], owner[order]

    def _keys(self, rows: range) -> np.ndarray:
        sizes = self.sizes[rows.start : rows.stop]
        out = np.zeros((len(rows), int(sizes.max())), np.uint64)
        for i, r in enumerate(rows):
            out[i, : len(self.words[r])] = self.words[r]
        return walk_keys(out, sizes)

    def _windows(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, start, size) at which an item can lie, from exact pieces."""
        out = []
        for q, (bits, hashes, sizes, offsets) in self.pieces.items():
            seen = window_hashes(words, q)
            near = np.flatnonzero(bits[(seen & np.uint64(len(bits) - 1)).astype(np.int64)])
            low, high = np.searchsorted(hashes, seen[near], "left"), np.searchsorted(hashes, seen[near], "right")
            near, low, high = near[high > low], low[high > low], high[high > low]
            many = high - low
            at = np.repeat(near, many)
            piece = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + q <= bounds[text + 1]
            start = np.maximum(at - offsets[piece], bounds[text])
            out.append(np.stack([text, start, sizes[piece]], axis=1)[inside])
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) to (edits, first word, end word) of its best match."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        windows = self._windows(words, bounds)
        for a in range(0, len(windows), WINDOWS):
            part = windows[a : a + WINDOWS]
            sizes = part[:, 2]
            at = part[:, 1:2] + np.arange(int(sizes.max()))[None, :]
            end = bounds[part[:, 0] + 1][:, None]
            content = np.where(at < end, words[np.minimum(at, len(words) - 1)], _END)
            keys = walk_keys(content, sizes).ravel()
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            some = np.flatnonzero(high > low)
            pairs = {(int(k) // REPEATS, int(i)) for k in some for i in self.owner[low[k] : high[k]]}
            for row, item in sorted(pairs):
                text, start, size = part[row].tolist()
                key, target = (text, item), self.words[item]
                if len(target) != size or (key in best and best[key][0] == 0):
                    continue
                k = allowed(size)
                begin, stop = int(bounds[text]), int(bounds[text + 1])
                left, right = max(begin, start - k), min(stop, start + size + k)
                distance, x, y = edits(target, words[left:right])
                found = (distance, left + x - begin, left + y - begin)
                if distance <= k and found < best.get(key, (k + 1, 0, 0)):
                    best[key] = found
        return best


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, streamed."""
    held, words = [], 0
    for row in items.select(item_id, text).toLocalIterator():
        if row[1]:
            size = len(row[1].split()) + 1
            if held and words + size > BLOCK_WORDS:
                yield held
                held, words = [], 0
            held.append((row[0], row[1]))
            words += size
    if held:
        yield held


def _block(rows: list[tuple]) -> Block | None:
    words, bounds = words_of(pa.array([r[1] for r in rows], pa.string()))
    kept = [i for i in range(len(rows)) if bounds[i + 1] > bounds[i]]
    if not kept:
        return None
    return Block([rows[i][0] for i in kept], [words[bounds[i] : bounds[i + 1]] for i in kept])


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item found in it: edits, similarity, and the first word and number of words of the best match."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"doc_id {id_type}, item_id {item_type}, first_word int, n_words int, edits int, similarity double"

    def search(block_rows: list[tuple]):
        def run(batches):
            block = _block(block_rows)
            for b in batches if block else ():
                words, bounds = words_of(b["text"])
                found = sorted(block.matches(words, bounds).items()) if len(words) else []
                texts = pa.array([t for (t, _), _ in found], pa.int64())
                at = [v for _, v in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].take(texts),
                        pa.array([block.ids[i] for (_, i), _ in found]).cast(item_arrow),
                        pa.array([v[1] for v in at], pa.int32()),
                        pa.array([v[2] - v[1] for v in at], pa.int32()),
                        pa.array([v[0] for v in at], pa.int32()),
                        pa.array([1 - v[0] / len(block.words[i]) for (_, i), v in found], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    out = docs.sparkSession.createDataFrame([], ddl)
    for i, block_rows in enumerate(_blocks(items, item_id, item_text)):
        found = rows.mapInArrow(search(block_rows), ddl)
        out = found if i == 0 else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item; all columns as they are."""
    small_batches(docs.sparkSession)

    def drop(block_rows: list[tuple]):
        def run(batches):
            block = _block(block_rows)
            for b in batches:
                words, bounds = words_of(b[text])
                hit = {t for t, _ in block.matches(words, bounds)} if block and len(words) else set()
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        return run

    for block_rows in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(drop(block_rows), docs.schema)
    return docs
