"""Exact similarity join of shingle sets with a size-aware split into light and heavy sets.

Two sets of n and m shingles reach similarity t (a rational) only if they share c(n, m) = ceil(t (n + m) / (1 + t)) of them.

* Light pairs: both sets have at most x shingles. Each set lists all its subsets of the fixed size c(n, m) for every m that
  can match, so two sets that link share one. x balances the number of subsets against that of list entries.
* Heavy pairs: inverted lists, scanned for the rarest n - ceil(t n) + 1 shingles of each set (two sets that link share one of
  these). Shingles no other document has cannot join anything, so they open no list; in most documents none is left.

A list is not expanded into pairs. Its sets are verified against one set of the list, the star, and the links found are closed
into components: first the set with the fewest shingles of its own, which is the one all copies come from, then sets in random
order, while that halves what is left of long lists. Of the lists that still hold several components, short ones give their pairs, after
the size and position filters; long ones are cut into blocks, ordered by component and size, that are compared as
wholes, unless they are of one component or their sizes rule links out. A long list makes no row per pair, and only links that join
components come out of it. This finds every link that could still join components. Equal sets are one class from the start,
represented by their smallest id.

Null or empty texts have an empty set and link with nothing. Rows with one id are one node. A null id is linked with nothing
and keeps a null component. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bucketed import bucket_count, dealt, first_of
from spanloom.llm.components import components
from spanloom.llm.packs import decode, encode, packed
from spanloom.llm.tables import written
from spanloom.llm.textarrays import mix, shingle_sets

SHINGLE_WORDS = 5
THRESHOLD = (80, 100)
# Largest boundary that is tried, and what scanning one list entry costs in subsets listed.
MOST_LIGHT = 24
SCAN = 4
# Sets are verified on 48-bit hashes kept as 6 bytes.
_KEPT_BYTES = 6

# A list is long while it holds more than so many pairs of sets of different components per entry; rounds of stars.
OPEN_PAIRS, MOST_ROUNDS = 4, 6
# Sets and shingles of one block.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 16

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("keys", pa.list_(pa.int64())), ("members", pa.binary())])
SETS_DDL = "doc_id bigint, n int, own int, keys array<bigint>, members binary"


def needed(n: int, m: int, threshold: tuple[int, int]) -> int:
    """Shingles two sets of these sizes must share: the least i with den * i >= num * (n + m - i)."""
    num, den = threshold
    return -(-num * (n + m) // (num + den))


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    num, den = threshold
    return n - -(-num * n // den) + 1


def partner_sizes(n: int, threshold: tuple[int, int]) -> range:
    num, den = threshold
    return range(max(1, -(-num * n // den)), den * n // num + 1)


def packed_set(hashes: np.ndarray) -> bytes:
    """The lower 48 bits of each hash, sorted."""
    low = np.sort(hashes & np.uint64(2**48 - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES].tobytes()


def unpacked_set(members: bytes) -> np.ndarray:
    rows = np.frombuffer(members, np.uint8).reshape(-1, _KEPT_BYTES)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :_KEPT_BYTES] = rows
    return out.view("<u8").reshape(-1)


# --- light sets -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int16)


def subset_keys(hashes: np.ndarray, most: int, threshold: tuple[int, int]) -> np.ndarray:
    """Keys of all fixed-size subsets for every partner size up to ``most``."""
    n = len(hashes)
    if not 0 < n <= most:
        return np.zeros(0, np.uint64)
    spread, out = mix(hashes), []
    for m in partner_sizes(n, threshold):
        if m <= most and (c := needed(n, m, threshold)) <= n:
            pair = mix(np.uint64([min(n, m) * 4096 + max(n, m)]))
            out.append(mix(spread[_choices(n, c)].sum(axis=1, dtype=np.uint64) + pair))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def boundary(sizes: dict[int, int], threshold: tuple[int, int]) -> int:
    """The largest size that counts as light, by cost. ``sizes``: number of sets by size."""

    def cost(x: int) -> float:
        subsets = sum(
            count * sum(comb(n, needed(n, m, threshold)) for m in partner_sizes(n, threshold) if m <= x)
            for n, count in sizes.items()
            if n <= x
        )
        lists = sum(count * prefix_length(n, threshold) for n, count in sizes.items() if n in _in_lists(x, threshold, n))
        return subsets + SCAN * lists

    return min(range(MOST_LIGHT + 1), key=cost)


def _in_lists(x: int, threshold: tuple[int, int], n: int) -> range:
    """The sizes that take part in the lists: heavy ones and those that can match a heavy one."""
    return range(partner_sizes(x + 1, threshold).start, n + 1)


# --- document frequencies ---------------------------------------------------------------------------------------------


class _Parsed:
    def __init__(self, rows: pa.Table, k: int):
        self.ids = rows["doc_id"].to_pylist()
        self.sets = shingle_sets(rows["text"], k)
        every = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        self.firsts, self.number = first_of(every)
        self.distinct = every[self.firsts]
        self.bounds = np.cumsum([0, *map(len, self.sets)])


def _describe(k: int):
    def describe(rows: pa.Table) -> dict[str, object]:
        sets = shingle_sets(rows["text"], k)
        return {
            "doc_ids": rows["doc_id"].to_pylist(),
            "sizes": [len(s) for s in sets],
            "classes": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
        }

    return describe


_SENT = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SEEN = pa.schema([("pack_id", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _send(k: int, buckets: int):
    def send(batches):
        for batch in batches:
            for pack_id, body in zip(batch["pack_id"].to_pylist(), batch["body"], strict=True):
                p = _Parsed(decode(body.as_py()), k)
                own = np.minimum(np.bincount(p.number, minlength=len(p.firsts)), 255).astype(np.uint8)
                out: dict[str, list] = {"pack_id": [], "bucket": [], "hashes": [], "counts": []}
                for bucket, part in dealt(p.distinct, buckets):
                    # Within a bucket the lower half of the hash tells shingles apart; a clash only raises a frequency.
                    keys = p.distinct[part].astype(np.uint32)
                    for name, value in zip(out, (pack_id, bucket, keys.tobytes(), own[part].tobytes()), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_SENT)

    return send


def _frequencies(rows: pa.Table) -> pa.Table:
    """For every key sent, the bit length of its number of documents (1: no other document has it)."""
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in rows["hashes"]]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rows["counts"]]).astype(np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every)
    ordered = every[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    totals = np.add.reduceat(counts[order], new)
    levels = np.empty(len(every), np.uint8)
    levels[order] = np.repeat(np.frexp(totals.astype(float))[1].astype(np.uint8), np.diff(np.append(new, len(every))))
    parts = np.split(levels, np.cumsum([len(x) for x in keys])[:-1])
    payload = pa.array([x.tobytes() for x in parts], pa.binary())
    return pa.table({"pack_id": rows["pack_id"], "bucket": rows["bucket"], "payload": payload}, schema=_SEEN)


_LISTED = -1


def _emit(k: int, buckets: int, light: int, threshold: tuple[int, int]):
    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in SETS.names}
        payloads = dict(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))
        if left.num_rows and _LISTED in payloads:
            p = _Parsed(decode(left["body"][0].as_py()), k)
            level = np.ones(len(p.distinct), np.uint8)
            for bucket, part in dealt(p.distinct, buckets):
                level[part] = np.frombuffer(payloads[bucket], np.uint8)
            for row in np.frombuffer(payloads[_LISTED], np.int32).tolist():
                own = p.sets[row]
                levels = level[p.number[p.bounds[row] : p.bounds[row + 1]]]
                keys = subset_keys(own, light, threshold)
                if len(own) in _in_lists(light, threshold, len(own)):
                    rarest = np.lexsort((own, levels))[: prefix_length(len(own), threshold)]
                    shared = rarest[levels[rarest] > 1]
                    # The place of the shingle in its set's order goes into the list, for the position filter.
                    place = np.flatnonzero(levels[rarest] > 1)
                    entries = np.concatenate([own[shared].astype(np.int64), place.astype(np.int64)])
                else:
                    entries = np.zeros(0, np.int64)
                if len(keys) or len(entries):
                    values = np.concatenate([[len(entries) // 2], entries, keys.astype(np.int64)])
                    for name, value in zip(SETS.names, (p.ids[row], len(own), int((levels < 2).sum()), values, packed_set(own)), strict=True):
                        out[name].append(value)
        return pa.table(out, schema=SETS)

    return emit


# --- lists to components ----------------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    num, den = threshold

    def verify(batches):
        for batch in batches:
            keep, kept_b, b_set = [], None, None
            for x, y in zip(batch["left"], batch["right"], strict=True):
                y = y.as_py()
                if y != kept_b:
                    kept_b, b_set = y, unpacked_set(y)
                a_set = unpacked_set(x.as_py())
                shared = len(np.intersect1d(a_set, b_set, assume_unique=True))
                keep.append(den * shared >= num * (len(a_set) + len(b_set) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(verify, "a bigint, b bigint")


def _open(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries of the lists that hold several components, with their component."""
    if labels is None:
        labelled = lists.withColumn("component", F.col("doc_id"))
    else:
        labelled = lists.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id")).drop("component_id")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return written(labelled.join(mixed.select("key"), "key", "left_semi"), "open")


def _starred(entries: DataFrame, round_: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): each set with the star of its lists that it meets most often, among sets of about its size."""
    num, den = threshold
    step = float(np.log(den / num) / 2)
    sized = entries.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
    order = F.col("own").cast("bigint") if round_ == 0 else F.xxhash64("doc_id", F.lit(round_))
    stars = sized.groupBy("key", "size").agg(F.min(F.struct(order.alias("order"), F.col("doc_id").alias("star"), F.col("component").alias("of"))).alias("s"))
    met = sized.join(stars, ["key", "size"]).where("component <> s.of").groupBy("doc_id", "s.star").count()
    best = met.groupBy("doc_id").agg(F.max_by("star", F.struct("count", -F.col("star"))).alias("b"))
    return best.withColumnRenamed("doc_id", "a")


_BLOCKS = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("component", pa.int64()), ("body", pa.binary())])
_BLOCKS_DDL = "key bigint, first bigint, least int, most int, component bigint, body binary"


def _cut(batches):
    """Blocks of the entries of a list, which come in order of component and size; their component is null if they hold several."""
    held: list[dict] = []
    shingles = 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_pylist(held)
        sizes, of = [r["n"] for r in held], {r["component"] for r in held}
        row = (held[0]["key"], held[0]["doc_id"], min(sizes), max(sizes), of.pop() if len(of) == 1 else None, encode(rows))
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCKS.names, row, strict=True))], schema=_BLOCKS)

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"] != held[0]["key"] or len(held) == BLOCK_SETS or shingles + row["n"] > BLOCK_SHINGLES):
                yield block()
                held, shingles = [], 0
            held.append(row)
            shingles += row["n"]
    if held:
        yield block()


class _Sets:
    def __init__(self, body: bytes):
        rows = decode(body)
        self.ids, self.components = rows["doc_id"].to_numpy(), rows["component"].to_numpy()
        self.sizes = rows["n"].to_numpy().astype(np.int64)
        self.values = np.concatenate([unpacked_set(m) for m in rows["members"].to_pylist()])
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)


def joining_links(a: _Sets, b: _Sets, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between sets of different components; of those that join the same components one is enough."""
    num, den = threshold
    every, place = np.unique(np.concatenate([a.values, b.values]), return_inverse=True)
    # Only shingles that both sides have add to an intersection.
    x, y = (np.zeros(len(every), bool) for _ in range(2))
    x[place[: len(a.values)]] = True
    y[place[len(a.values) :]] = True
    column = np.cumsum(x & y) - 1
    left, right = (np.zeros((len(s.ids), int((x & y).sum())), np.float32) for s in (a, b))
    for matrix, s, own in ((left, a, place[: len(a.values)]), (right, b, place[len(a.values) :])):
        both = (x & y)[own]
        matrix[s.owner[both], column[own[both]]] = 1
    shared = np.rint(left @ right.T).astype(np.int64)
    near = (den * shared >= num * (a.sizes[:, None] + b.sizes - shared)) & (a.components[:, None] != b.components)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while v in parent:
            v = parent[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = root(int(a.components[i])), root(int(b.components[j]))
        if p != q:
            parent[p] = q
            out.append((int(a.ids[i]), int(b.ids[j])))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compared(threshold: tuple[int, int]):
    def run(batches):
        for batch in batches:
            bodies = zip(*(batch[c] for c in (("left", "right") if "right" in batch.schema.names else ("body", "body"))), strict=True)
            out = []
            for left, right in bodies:
                a = _Sets(left.as_py())
                out += joining_links(a, a if left is right else _Sets(right.as_py()), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], schema=_LINKS)

    return run


def _pair_links(entries: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of links in short lists: their pairs of sets of different components, after the size and position filters."""
    num, den = threshold
    x, y = entries.alias("x"), entries.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    sizes = den * F.least(n, m) >= num * F.greatest(n, m)
    rest = F.least(n - F.col("x.place"), m - F.col("y.place"))
    # A pair that links keeps the list of its first shared shingle: from these places on, at most ``rest`` can be shared.
    enough = (den + num) * rest >= num * (n + m)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))).where(sizes & enough)
    return _verified(pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), sets, threshold)


def _block_links(entries: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of links that join components of long lists."""
    num, den = threshold
    full = written(entries.join(sets, "doc_id").select("key", "component", "n", "doc_id", "members"), "open_sets")
    order = ["key", "component", "n", "doc_id"]
    blocks = written(full.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _BLOCKS_DDL), "blocks")
    inside = blocks.where("component IS NULL").select("body").mapInArrow(_compared(threshold), "a bigint, b bigint")
    long = blocks.groupBy("key").count().where("count > 1").select("key")
    some = blocks.join(long, "key", "left_semi")
    x, y = some.alias("x"), some.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.first") < F.col("y.first")))
    met = met.where(~F.col("x.component").eqNullSafe(F.col("y.component")) | F.col("x.component").isNull())
    met = met.where((den * F.col("x.most") >= num * F.col("y.least")) & (den * F.col("y.most") >= num * F.col("x.least")))
    across = met.select(F.col("x.body").alias("left"), F.col("y.body").alias("right")).mapInArrow(_compared(threshold), "a bigint, b bigint")
    return written(inside.union(across), "links")


def linked(lists: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, component_id) of the ids that link with another. ``lists``: doc_id, n, own, key, place; ``sets``: doc_id, members."""
    shared = lists.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    lists = written(lists.join(shared.select("key"), "key", "left_semi"), "lists")
    labels, links, entries, long = None, None, _open(lists, None), None
    left = entries.count()
    for round_ in range(MOST_ROUNDS):
        found = written(_verified(_starred(entries, round_, threshold), sets, threshold), "links")
        links = found if links is None else links.union(found)
        labels = written(components(links), "labels")
        entries = _open(lists, labels)
        # Lists whose pairs of sets of different components outnumber their entries by far.
        per = entries.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.col("count")).alias("s"))
        long = written(per.where((F.col("t") * F.col("t") - F.col("s")) / 2 > OPEN_PAIRS * F.col("t")).select("key", "t"), "long")
        before, left = left, long.agg(F.sum("t")).first()[0] or 0
        if not left or 2 * left > before:
            break
    long = long.select("key")
    pairs = _pair_links(entries.join(long, "key", "left_anti"), sets, threshold)
    more = written(pairs.union(_block_links(entries.join(long, "key", "left_semi"), sets, threshold)), "links")
    return labels if more.isEmpty() else components(links.union(more))


def similar_components(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, k: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links of at least num/den similarity."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packs = packed(rows, "sets", describe=_describe(k), described="doc_ids array<bigint>, sizes array<int>, classes array<binary>")
    members = packs.select("pack_id", F.posexplode(F.arrays_zip("doc_ids", "sizes", "classes")).alias("row", "m")).select(
        "pack_id", "row", F.col("m.doc_ids").alias("doc_id"), F.col("m.sizes").alias("n"), F.col("m.classes").alias("class")
    )
    firsts = (
        members.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("class")
        .agg(F.min(F.struct("doc_id", "pack_id", "row")).alias("first"), F.first("n").alias("n"))
        .select("class", "n", "first.*")
    )
    firsts = written(firsts, "classes")
    sizes = {r["n"]: r["count"] for r in firsts.groupBy(F.least("n", F.lit(2 * MOST_LIGHT)).alias("n")).count().collect()}
    light = boundary(sizes, threshold)
    total = firsts.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    buckets = bucket_count(total)
    bodies = packs.select("pack_id", "body")
    sent = bodies.mapInArrow(_send(k, buckets), "pack_id bigint, bucket int, hashes binary, counts binary")
    seen = sent.groupBy("bucket").applyInArrow(_frequencies, "pack_id bigint, bucket int, payload binary")
    listed = firsts.groupBy("pack_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        "pack_id", F.lit(_LISTED).alias("bucket"), F.col("rows")
    )
    listed = listed.mapInArrow(_row_bytes, "pack_id bigint, bucket int, payload binary")
    right = written(seen.union(listed), "seen")
    sets = written(
        bodies.groupBy("pack_id").cogroup(right.groupBy("pack_id")).applyInArrow(_emit(k, buckets, light, threshold), SETS_DDL), "keys"
    )
    # keys: the number of list entries, their shingles, their places, then the subset keys.
    size = F.col("keys")[0].cast("int")
    entries = F.arrays_zip(F.slice("keys", F.lit(2), size).alias("key"), F.slice("keys", size + 2, size).alias("place"))
    heavy = sets.select("doc_id", "n", "own", F.explode(entries).alias("e")).select("doc_id", "n", "own", "e.key", F.col("e.place").cast("int").alias("place"))
    subsets = sets.select("doc_id", "n", "own", F.explode(F.slice("keys", size * 2 + 2, F.size("keys"))).alias("key"), F.lit(0).alias("place"))
    lists = heavy.union(subsets)
    labels = linked(lists, sets.select("doc_id", "members"), threshold)
    classes = firsts.select("class", "doc_id").join(labels, "doc_id", "left")
    named = classes.select("class", F.coalesce("component_id", "doc_id").alias("component"))
    counted = F.when(F.col("n") > 0, F.col("class"))
    return (
        members.select("doc_id", "n", counted.alias("class"))
        .join(named, "class", "left")
        .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def _row_bytes(batches):
    for batch in batches:
        payload = [np.array(x, np.int32).tobytes() for x in batch["rows"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["pack_id"], batch["bucket"], pa.array(payload, pa.binary())], schema=_SEEN)
