"""Words, shingles and their 64-bit hashes of many texts at once, as numpy arrays over the UTF-8 bytes.

A span's hash is a polynomial over random byte codes, taken from prefix sums, then mixed: no Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that they have inverses modulo 2**64
_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 8
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text starts (one more entry for the end); null is empty."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a word never reaches over the end of its text."""
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    gap = separators[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = ~gap
    starts[1:] &= gap[:-1] | cut[1:-1]
    ends = ~gap
    ends[:-1] &= gap[1:] | cut[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _byte_powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, in order (positions whose window reaches past the end are left out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _word_powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def text_windows(word_text: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first words of the k-word windows that lie in one text."""
    n = len(word_text) - k + 1
    return np.flatnonzero(word_text[:n] == word_text[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def shingle_sets(texts: pa.ChunkedArray | pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; A-Z count as a-z. A shorter text is one shingle as a whole."""
    raw, offsets = utf8(texts)
    raw = LOWER[raw]
    starts, ends, owner = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    at = text_windows(owner, k)
    hashes = window_hashes(words, k)[at] if len(at) else np.zeros(0, np.uint64)
    n = len(offsets) - 1
    first = np.searchsorted(owner[at], np.arange(n + 1))
    of_word = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for i in range(n):
        count = of_word[i + 1] - of_word[i]
        if 0 < count < k:
            out.append(window_hashes(words[of_word[i] : of_word[i + 1]], count))
        else:
            out.append(np.unique(hashes[first[i] : first[i + 1]]))
    return out
