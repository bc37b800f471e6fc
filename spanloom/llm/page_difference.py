"""Main text of HTML pages: markup rules and the difference to the page with the nearest URL.

Markup first (``html_lines``): scripts, styles, menus, headers, footers, asides, forms, adverts, notices and reader comments go
by tag, role and the words of class and id; if the page marks an article or main part, the rest goes too. What is left is a
sequence of lines (blocks).

Then the difference: pages of a host are ordered by URL path, every page is paired with the neighbour that shares more of its
path (the one before it on a tie; addresses that differ in scheme, query, fragment, final slash or .html only count as one
page, unless the host has a single path: then queries tell pages apart), the two line sequences are aligned by longest common
subsequence, and the shared lines go. Two exceptions keep articles whole: lines that markup places inside an article stay, because
articles of one host quote the same passages, and nothing goes if the shared lines are nine tenths of the lines of both
pages or more (copies).

Only line hashes meet in the pairing; the ordering is by ranges, so a host with a third of all pages is spread over tasks.

A null html gives an empty text; a null url is a host of its own and is never paired; repeated rows get equal results; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.html_lines import lines
from spanloom.llm.tables import small_batches, written
from spanloom.llm.textarrays import mix, span_hashes, utf8

# Pages whose shared lines are this share of the lines of either are copies of each other.
COPY_LINES = 0.9


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel over the rows of the usual table: a row is one integer of as many bits as ``b`` has shared lines. Every so many rows
    are kept, and those between are made again while walking back, so memory grows with the lines times the root of their number.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [i for i in range(head, len(a) - tail) if a[i] in shared]
    masks: dict[int, int] = {}
    width = 0
    for v in b[head : len(b) - tail]:
        if v in shared:
            masks[v] = masks.get(v, 0) | 1 << width
            width += 1
    every = (1 << width) - 1

    def after(row: int, i: int) -> int:
        met = row & masks[a[x[i]]]
        return ((row + met) | (row - met)) & every

    step = int(len(x) ** 0.5) + 1
    kept, row = [], every
    for i in range(len(x)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    out, column = [], width
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        rows = [kept[block]]  # before the block's first line, then after each
        for i in range(first, min(first + step, len(x))):
            rows.append(after(rows[-1], i))
        i = len(rows) - 1
        while i and column:
            if rows[i] >> (column - 1) & 1:
                column -= 1
            else:
                i -= 1
                if rows[i] >> (column - 1) & 1:
                    out.append(x[first + i])
                    column -= 1
    return [*range(head), *reversed(out), *range(len(a) - tail, len(a))]


def shared_lines(own: list[int], marked: list[bool], other: list[int]) -> list[int]:
    """The lines to delete from a page, given its neighbour's lines."""
    found = common(own, other)
    if len(found) >= COPY_LINES * max(len(own), len(other)):
        return []
    return [i for i in found if not marked[i]]


def _hashed(texts: list[str]) -> np.ndarray:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    return mix(span_hashes(raw, offsets[:-1], offsets[1:])) if texts else np.zeros(0, np.uint64)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    """The path without what does not name another page."""
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    return F.regexp_replace(path, r"(?:/(?:index\.\w+)?|\.\w{2,5})$", "")


def _hash_lines(batches):
    for b in batches:
        out: dict[str, list] = {"hashes": [], "marked": []}
        for page in b["html"].to_pylist():
            found = lines(page)
            texts = [t for t, _ in found]
            out["hashes"].append(_hashed(texts).tobytes())
            out["marked"].append(np.array([k for _, k in found], np.uint8).tobytes())
        columns = [b["host"], b["path"], b["query"], b["row"], *(pa.array(v, pa.binary()) for v in out.values())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "query", "row", *out])


def _differences(batches):
    for b in batches:
        gone = []
        for own, marked, other in zip(*(b[c].to_pylist() for c in ("hashes", "marked", "other")), strict=True):
            gone.append(
                shared_lines(
                    np.frombuffer(own, np.uint64).tolist(),
                    np.frombuffer(marked, np.uint8).astype(bool).tolist(),
                    np.frombuffer(other, np.uint64).tolist() if other else [],
                )
            )
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])


def _shared_path(a: Column, b: Column) -> Column:
    """Leading path segments in common; -1 without a page there."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(b.isNull(), -1).otherwise(F.when(first == 0, F.size(same)).otherwise(first - 1))


def neighbours(pages: DataFrame) -> DataFrame:
    """row and the row paired with it. ``pages``: host, path, row; rows of a host and path count as one page."""
    named = pages.where("host IS NOT NULL").groupBy("host", "path").agg(F.min("row").alias("row"))
    ordered = written(
        named.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("at", F.monotonically_increasing_id()), "ordered"
    )
    # Global places: the place in a range plus the sizes of the ranges before it (one row per range).
    ranges = ordered.groupBy(F.shiftright("at", 33).alias("range")).count()
    before = ranges.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ordered.withColumn("range", F.shiftright("at", 33)).join(before, "range")
    placed = written(placed.select("host", "path", "row", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place")), "placed")
    sides = placed.select(
        F.col("host").alias("own_host"), F.col("path").alias("own_path"), F.col("place").alias("own_place"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    )
    met = sides.join(placed, (F.col("own_place") + F.col("side") == F.col("place")) & (F.col("own_host") == F.col("host")))
    best = met.groupBy("own_host", "own_path").agg(
        F.max_by("row", F.struct(_shared_path(F.col("own_path"), F.col("path")), -F.col("side"))).alias("other")
    )
    return best.select(F.col("own_host").alias("host"), F.col("own_path").alias("path"), "other")


def _named_by_query(pages: DataFrame) -> DataFrame:
    """Where a host has one path only, its pages are told apart by their queries."""
    one = pages.where("host IS NOT NULL").groupBy("host").agg((F.min("path") == F.max("path")).alias("_one"))
    path = F.when(F.col("_one"), F.concat("path", F.lit("?"), "query")).otherwise(F.col("path"))
    return pages.join(one, "host", "left").withColumn("path", path).drop("_one", "query")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    small_batches(pages.sparkSession)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    # Equal rows have equal keys and results.
    row = F.xxhash64("page_id", "url", "html")
    place = [f(F.col("url")).alias(name) for f, name in ((host_of, "host"), (path_of, "path"), (query_of, "query"))]
    keyed = source.select(*place, row.alias("row"), "html")
    hashed = keyed.mapInArrow(_hash_lines, "host string, path string, query string, row bigint, hashes binary, marked binary")
    hashed = _named_by_query(written(hashed, "line_hashes"))
    pairs = neighbours(hashed.select("host", "path", "row"))
    one = hashed.dropDuplicates(["row"])
    other_lines = hashed.groupBy(F.col("row").alias("paired")).agg(F.first("hashes").alias("other"))
    met = one.join(pairs.withColumnRenamed("other", "paired"), ["host", "path"]).join(other_lines, "paired")
    gone = met.select("row", "hashes", "marked", "other").mapInArrow(_differences, "row bigint, gone array<int>").where(F.size("gone") > 0)

    def extract(batches):
        for b in batches:
            found = [[t for t, _ in lines(page)] for page in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], b["row"], pa.array(found, pa.list_(pa.string()))], names=["page_id", "url", "row", "lines"]
            )

    id_type, url_type = (source.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    texts = source.select("page_id", "url", row.alias("row"), "html").mapInArrow(
        extract, f"page_id {id_type}, url {url_type}, row bigint, lines array<string>"
    )
    kept = F.filter("lines", lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    return texts.join(written(gone, "gone"), "row", "left").select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
