"""Repeated passages by relative Lempel-Ziv factors against an indexed reference.

The reference of a document is all documents of smaller id. It is cut into blocks by anchors: the anchor of a window of
``window`` words is the smallest hash among its shingles of half a window, so equal windows have equal anchors, and some
four windows in a row share one. A run of windows with one anchor is a fragment (at most 19 words for windows of 13) and
goes to its anchor's block, words and place included. Anchors met in one fragment only cannot hold a repeat; a first
exchange of anchor hashes finds them, and their fragments are not sent.

Each block indexes the windows of its fragments by their words. A fragment is factored greedily from the left: the first
window found in an earlier document starts a factor, which is extended word by word on the reference fragment; the next
factor starts at the first found window that the last one does not hold, so windows over its boundary are looked up anew.
Words are compared as bytes; hashes only bring equal ones together. Factors of neighbouring fragments that go on in the same
reference are joined, and every factor names the document and the word it copies.

Within a pack a fragment is sent once, for its first document; copies in later documents of the pack are factors of that
document. So a passage in a third of all documents is a few rows per pack. (Equal fragments of one pack are told by 64-bit
hashes of their bytes, the only place where hashes decide.)

Null text has no words; a null id is neither reference nor changed; rows with one id are one document that never repeats
itself (their places are those of one of the rows); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bucketed import bucket_count, dealt, first_of
from spanloom.llm.packs import decode, packed
from spanloom.llm.tables import written
from spanloom.llm.textarrays import mix, span_hashes, text_windows, utf8, window_hashes, word_spans

WINDOW = 13


def _anchor_words(window: int) -> int:
    return window // 2 + 1


def _anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest shingle hash of each window and where it stands (the first of equal ones)."""
    k = _anchor_words(window)
    hashes = window_hashes(words, k)
    best, place = hashes[at], at.copy()
    for j in range(1, window - k + 1):
        other = hashes[at + j]
        less = other < best
        best = np.where(less, other, best)
        place[less] = at[less] + j
    return mix(best), place


class _Fragments:
    """The words of a pack and the fragments of its windows; documents are in ascending order of id."""

    def __init__(self, rows: pa.Table, window: int):
        self.ids = rows["doc_id"].combine_chunks()
        self.raw, self.offsets = utf8(rows["text"])
        self.starts, self.ends, self.owner = word_spans(self.raw, self.offsets)
        self.origin = np.searchsorted(self.owner, np.arange(len(self.offsets)))
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.numbers = self.ids.fill_null(0).to_numpy().astype(np.int64)
        at = text_windows(self.owner, window)
        at = at[known[self.owner[at]]]
        if len(at):
            anchors, place = _anchors(span_hashes(self.raw, self.starts, self.ends), at, window)
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])]))
            windows = np.diff(np.append(new, len(at)))
        else:
            anchors, new, windows = np.zeros(0, np.uint64), at, at
        self.first, self.size = at[new], windows + window - 1
        self.text = self.owner[self.first]
        self.doc = self.numbers[self.text]
        self.begin, self.end = self.starts[self.first], self.ends[self.first + self.size - 1]
        # Equal fragments: the first of each is sent, with its anchor.
        self.sent, number = first_of(span_hashes(self.raw, self.begin, self.end)) if len(new) else (new, new)
        self.model = self.sent[number]
        self.anchors = anchors[new][self.sent]
        self.anchor_firsts, self.anchor_number = first_of(self.anchors)


_KEYS = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])


def _rows(pack_id: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([[pack_id] * len(parts), [b for b, _ in parts], [x for _, x in parts]], schema=_KEYS)


def _send_anchors(window: int, buckets: int):
    def send(batches):
        for batch in batches:
            for pack_id, body in zip(batch["pack_id"].to_pylist(), batch["body"], strict=True):
                p = _Fragments(decode(body.as_py()), window)
                anchors = p.anchors[p.anchor_firsts]
                parts = [(bucket, anchors[part].tobytes()) for bucket, part in dealt(anchors, buckets)]
                yield from _rows(pack_id, parts).to_batches()

    return send


def _shared_anchors(rows: pa.Table) -> pa.Table:
    """Which anchors of each pack other packs have too."""
    sent = [np.frombuffer(x.as_py(), np.uint64) for x in rows["body"]]
    key = np.concatenate(sent)
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    counts = np.diff(np.append(new, len(key)))
    shared = np.empty(len(key), bool)
    shared[order] = np.repeat(counts > 1, counts)
    masks = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(x) for x in sent])[:-1])]
    return pa.table([rows["pack_id"], rows["bucket"], pa.array(masks, pa.binary())], schema=_KEYS)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of many ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _body(p: _Fragments, part: np.ndarray) -> bytes:
    """Some fragments as bytes: places in the pack, sizes in words, their texts' ids and first words, and the words."""
    texts, counts = np.unique(p.text[part], return_counts=True)
    lengths = p.end[part] - p.begin[part] + 1
    out = p.raw[np.minimum(_spread(p.begin[part], lengths), len(p.raw) - 1)]
    out[np.cumsum(lengths) - 1] = 32
    head = np.array([len(part), len(texts)], np.int64)
    places = np.diff(p.first[part], prepend=0).astype(np.uint32)
    marks = [head, places, p.size[part].astype(np.uint32), p.numbers[texts], p.origin[texts].astype(np.uint32), counts.astype(np.uint32)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in [*marks, out]))


def _read_body(body: bytes) -> list[np.ndarray]:
    """Place, size, document and first word of each fragment, and the bytes of all their words."""
    data = zstandard.ZstdDecompressor().decompress(body)
    n, texts = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for kind, count in ((np.uint32, n), (np.uint32, n), (np.int64, texts), (np.uint32, texts), (np.uint32, texts)):
        out.append(np.frombuffer(data, kind, count, at).astype(np.int64))
        at += int(count) * np.dtype(kind).itemsize
    places, sizes, docs, origins, counts = out
    places = np.cumsum(places)
    return [places, sizes, np.repeat(docs, counts), places - np.repeat(origins, counts), np.frombuffer(data, np.uint8, offset=at)]


def _send_fragments(window: int, anchor_buckets: int, buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _KEYS.empty_table()
        p = _Fragments(decode(left["body"][0].as_py()), window)
        masks = dict(zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True))
        anchors = p.anchors[p.anchor_firsts]
        shared = np.bincount(p.anchor_number, minlength=len(anchors)) > 1
        for bucket, part in dealt(anchors, anchor_buckets):
            shared[part] |= np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(part)).view(bool)
        chosen = np.flatnonzero(shared[p.anchor_number])
        parts = [(bucket, _body(p, p.sent[chosen[part]])) for bucket, part in dealt(p.anchors[chosen], buckets)]
        return _rows(left["pack_id"][0].as_py(), parts)

    return send


def _word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for words of equal bytes, and for no others."""
    _, model, number = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    number = number.astype(np.int64)
    same_as, lengths = model[number], ends - starts
    differs = lengths != lengths[same_as]
    for low in range(0, len(starts), 1 << 17):
        part = np.arange(low, min(low + (1 << 17), len(starts)))
        part = part[~differs[part]]
        unequal = raw[_spread(starts[part], lengths[part])] != raw[_spread(starts[same_as[part]], lengths[part])]
        differs[np.repeat(part, lengths[part])[unequal]] = True
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs):
        number[i] = others.setdefault(raw[starts[i] : ends[i]].tobytes(), len(model) + len(others))
    return number


def _window_groups(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that brings equal ones together, and where each group begins in it."""
    hashes = window_hashes(mix(words.astype(np.uint64)), window)[at]
    order = np.argsort(hashes)
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    for j in range(window):
        if (words[at[order][1:] + j] != words[at[order][:-1] + j])[~new[1:]].any():
            _, numbers = np.unique(words[at[:, None] + np.arange(window)], axis=0, return_inverse=True)
            order = np.argsort(numbers.ravel())
            return order, np.flatnonzero(np.concatenate([[True], np.diff(numbers.ravel()[order]) != 0]))
    return order, np.flatnonzero(new)


_FACTOR = [("place", np.uint32), ("words", np.uint32), ("source", np.int64), ("source_first", np.uint32)]


def _factor_block(window: int):
    def factor(rows: pa.Table) -> pa.Table:
        """Indexes one reference block and factors each pack's fragments against it."""
        read = [_read_body(x.as_py()) for x in rows["body"]]
        place, size, doc, within, raw = (np.concatenate(x) for x in zip(*read, strict=True))
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
        words = _word_numbers(raw, starts, ends)
        stop = np.cumsum(size)
        windows = size - window + 1
        at = _spread(stop - size, windows)
        fragment = np.repeat(np.arange(len(size)), windows)
        offset = at - (stop - size)[fragment]

        # The reference of each window: its place in the earliest document that has it.
        order, new = _window_groups(words, at, window)
        counts = np.diff(np.append(new, len(at)))
        ordered = doc[fragment[order]]
        earliest = np.repeat(np.minimum.reduceat(ordered, new), counts)
        group = np.repeat(np.arange(len(new)), counts)
        holders = np.flatnonzero(ordered == earliest)
        firsts = holders[np.concatenate([[True], np.diff(group[holders]) != 0])]
        reference, found = np.empty(len(at), np.int64), np.empty(len(at), bool)
        reference[order], found[order] = order[firsts][group], ordered > earliest

        # How many more words the reference goes on with, within both fragments.
        more, going = np.zeros(len(at), np.int64), found.copy()
        for j in range(window, int(size.max())):
            a, b = at + j, at[reference] + j
            going &= (a < stop[fragment]) & (b < stop[fragment[reference]])
            going[going] = words[a[going]] == words[b[going]]
            more += going

        taken, reach = np.zeros(len(at), bool), np.full(len(size), -1)
        for j in range(int(windows.max())):
            start = np.flatnonzero(found & (offset == j) & (reach[fragment] < j))
            taken[start] = True
            reach[fragment[start]] = j + more[start]
        chosen = np.flatnonzero(taken)
        origin = fragment[reference[chosen]]
        values = [place[fragment[chosen]] + offset[chosen], window + more[chosen], doc[origin], within[origin] + offset[reference[chosen]]]
        cuts = np.searchsorted(fragment[chosen], np.cumsum([len(x[0]) for x in read])[:-1])
        split = [np.split(v.astype(kind), cuts) for v, (_, kind) in zip(values, _FACTOR, strict=True)]
        bodies = [zstandard.ZstdCompressor().compress(b"".join(x.tobytes() for x in part)) for part in zip(*split, strict=True)]
        return pa.table([rows["pack_id"], rows["bucket"], pa.array(bodies, pa.binary())], schema=_KEYS)

    return factor


def _read_factors(bodies: list[bytes]) -> list[np.ndarray]:
    """The columns of ``_FACTOR`` of a pack, ordered by place."""
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in _FACTOR]
    for body in bodies:
        data, at = zstandard.ZstdDecompressor().decompress(body), 0
        n = len(data) // sum(np.dtype(kind).itemsize for _, kind in _FACTOR)
        for column, (_, kind) in zip(columns, _FACTOR, strict=True):
            column.append(np.frombuffer(data, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
    whole = [np.concatenate(c) for c in columns]
    order = np.argsort(whole[0], kind="stable")
    return [c[order] for c in whole]


def _with_copies(p: _Fragments, factors: list[np.ndarray]) -> list[np.ndarray]:
    """Adds the factors of fragments that were not sent because an earlier one of the pack is equal."""
    place, size, source, source_first = factors
    copy = np.flatnonzero(p.model != np.arange(len(p.model)))
    model = p.model[copy]
    later = p.doc[copy] > p.doc[model]
    # In a later document the whole fragment is a factor of the pack's first one.
    whole, origin = copy[later], model[later]
    added = [[p.first[whole], p.size[whole], p.doc[origin], p.first[origin] - p.origin[p.text[origin]]]]
    # In the same document it has the factors of the first.
    copy, model = copy[~later], model[~later]
    low = np.searchsorted(place, p.first[model])
    # Windows belong to one fragment, so its factors start before the next fragment does.
    high = np.searchsorted(place, np.append(p.first, np.iinfo(np.int64).max)[model + 1])
    own = _spread(low, high - low)
    shift = np.repeat(p.first[copy] - p.first[model], high - low)
    added.append([place[own] + shift, size[own], source[own], source_first[own]])
    return [np.concatenate([c, *x]) for c, *x in zip(factors, *added, strict=True)]


def _joined(p: _Fragments, factors: list[np.ndarray]) -> list[np.ndarray]:
    """Factors in order of place; those that go on in the same reference are one."""
    order = np.argsort(factors[0], kind="stable")
    place, size, source, source_first = (c[order] for c in factors)
    if len(place) == 0:
        return [place, size, source, source_first]
    end, text = place + size, p.owner[place]
    goes_on = (text[1:] == text[:-1]) & (source[1:] == source[:-1]) & (place[1:] <= end[:-1])
    goes_on &= source_first[1:] - place[1:] == source_first[:-1] - place[:-1]
    new = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return [place[new], np.maximum.reduceat(end, new) - place[new], source[new], source_first[new]]


def _lists(p: _Fragments, place: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """Per document the rows of its factors, each a list of the columns."""
    bounds = np.searchsorted(place, p.origin)
    flat = pa.array(np.stack(columns, axis=1).ravel(), pa.int64())
    each = pa.ListArray.from_arrays(np.arange(len(place) + 1, dtype=np.int32) * len(columns), flat)
    return pa.ListArray.from_arrays(bounds.astype(np.int32), each)


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    + [(name, pa.list_(pa.list_(pa.int64()))) for name in ("factors", "sources")]
)


def _assemble(window: int):
    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _RESULT.empty_table()
        p = _Fragments(decode(left["body"][0].as_py()), window)
        place, size, source, source_first = _joined(p, _with_copies(p, _read_factors(right["body"].to_pylist())))
        step = np.zeros(len(p.starts) + 1, np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + size, -1)
        covered = np.cumsum(step[:-1]) > 0
        first = place - p.origin[p.owner[place]]
        lists = [_lists(p, place, first, size), _lists(p, place, source, source_first)]
        return pa.table([p.ids.cast(pa.int64()), *_columns(p, covered), *lists], schema=_RESULT)

    return assemble


def _columns(p: _Fragments, covered: np.ndarray) -> list[pa.Array]:
    """Words, removed words, and the kept words joined by single spaces, per document."""
    n_docs = len(p.offsets) - 1
    words = np.bincount(p.owner, minlength=n_docs)
    removed = np.bincount(p.owner[covered], minlength=n_docs)
    # Each kept word goes with the byte after it, turned into a space; a text's last byte gets one of its own.
    kept = ~covered
    lengths = (p.ends - p.starts + 1)[kept]
    out = np.full(int(lengths.sum()), 32, np.uint8)
    source = _spread(p.starts[kept], lengths)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(lengths) - 1] = False
    out[is_word] = p.raw[source[is_word]]
    per_doc = np.bincount(p.owner[kept], weights=lengths, minlength=n_docs).astype(np.int64)
    stops = np.cumsum(per_doc)
    data = out.tobytes()
    texts = [data[b - n : b - 1].decode() if n else "" for b, n in zip(stops.tolist(), per_doc.tolist(), strict=True)]
    return [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]


def repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, the kept words (``kept``), and its factors in order.

    ``factors`` has first word and words of each factor, ``sources`` the document it copies and the first word there.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packs = packed(rows, "passages", order="doc_id", describe=lambda t: {"bytes": t["text"].nbytes}, described="bytes bigint")
    words = (packs.agg(F.sum("bytes")).first()[0] or 0) // 6
    # An anchor stands for some four windows; if all are shared, a task of the second exchange holds a million windows.
    anchor_buckets, buckets = bucket_count(words // 4), bucket_count(words)
    keys = "pack_id bigint, bucket int, body binary"
    by_pack = packs.select("pack_id", "body").groupBy("pack_id")
    anchors = packs.select("pack_id", "body").mapInArrow(_send_anchors(window, anchor_buckets), keys)
    shared = written(anchors.groupBy("bucket").applyInArrow(_shared_anchors, keys), "shared")
    fragments = by_pack.cogroup(shared.groupBy("pack_id")).applyInArrow(_send_fragments(window, anchor_buckets, buckets), keys)
    factors = written(fragments.groupBy("bucket").applyInArrow(_factor_block(window), keys), "factors")
    return by_pack.cogroup(factors.groupBy("pack_id")).applyInArrow(
        _assemble(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string, factors array<array<bigint>>, sources array<array<bigint>>"
    )
