"""Rows packed into compressed blocks of a few MB, so that Python tasks work on arrays over many texts at once.

A pack is one row: its id and the rows as an Arrow stream. Packs are written once, so that their random ids are fixed.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.llm.tables import small_batches, written

PACK_BYTES = 2 << 20
SCHEMA = "pack_id bigint, body binary"


def encode(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def decode(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def collected(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.Table]:
    """Tables of about the target size; a batch that is larger is cut by rows."""
    held, size = [], 0
    for batch in batches:
        pieces = max(1, min(batch.num_rows, batch.nbytes // target))
        step = max(1, -(-batch.num_rows // pieces))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            held.append(piece)
            size += piece.nbytes
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(
    df: DataFrame,
    name: str,
    order: str | None = None,
    describe: Callable[[pa.Table], dict[str, object]] | None = None,
    described: str = "",
    target: int = PACK_BYTES,
) -> DataFrame:
    """Writes the rows as packs, ordered within each by ``order``. ``describe`` adds columns (``described``) per pack."""
    small_batches(df.sparkSession)
    schema = T.StructType.fromDDL(SCHEMA + (f", {described}" if described else ""))
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in collected(batches, target):
            if order:
                rows = rows.sort_by(order)
            row = {"pack_id": [secrets.randbits(63)], "body": [encode(rows)]}
            extra = describe(rows) if describe else {}
            yield pa.RecordBatch.from_pydict(row | {k: [v] for k, v in extra.items()}, schema=arrow)

    return written(df.mapInArrow(pack, schema), name)
