"""Weighted rendezvous hashing of record keys, with DataFrame functions only.

A key goes to the shard with the largest weight / -ln(u), u a hash of key and shard in (0, 1). A further shard can only win
keys, so when the count grows, rows move into the new shard alone. A null key counts as the text "null"; equal keys share a
shard. Empty tables give no rows; columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices per shard for numbering: no task orders a whole shard.
SLICES = 4096


def _hash52(*parts: Column) -> Column:
    """The first 13 hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; weights[i] > 0 is that of shard i. Ties go to the smaller shard."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = F.array(
        *[
            F.struct(
                (F.lit(float(w)) / -F.log((_hash52(text, F.lit(str(i))) + F.lit(0.5)) / F.lit(float(2**52)))).alias("score"),
                F.lit(-i).alias("shard"),
            )
            for i, w in enumerate(weights)
        ]
    )
    return -F.array_max(scores)["shard"]


def shards(docs: DataFrame, weights: list[float], grown: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot within it (in the order of a key hash) and the shard under the grown list of weights.

    ``size`` is the text's UTF-8 bytes plus 8 and ``text_crc32`` its checksum; a null text counts as empty.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 8).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
        _hash52(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_at"),
    ).withColumn("_slice", F.floor(F.col("_at") / (2**52 // SLICES)).cast("int"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_at", "doc_id", "size", "text_crc32")
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "_slice")
        .count()
        .select("shard", "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    numbered = placed.withColumn("_inside", F.row_number().over(inside)).join(before, ["shard", "_slice"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_before") + F.col("_inside") - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )
