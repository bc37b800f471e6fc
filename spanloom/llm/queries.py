"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, factor_dedup, language, line_chunks, minhash, page_difference, posting_lists
from spanloom.llm import set_join, sharding, spelling, toxicity, whitening
from spanloom.llm.tables import small_batches, table, written

SHARDS = 24
# Rows of one slice of ids in the fingerprint query hold about so many bytes of text.
SLICE_BYTES = 8 << 20
# Slices whose order one task finds: half a TB of text.
SECTION_SLICES = 1 << 16


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file (the package that brings them is asked only when a query runs)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = page_difference.main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    rows = toxicity.scored(docs, model)
    return rows.select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs, _remainder(5) != 0, tokenizer_file("piece_bpe_32k.model"))
    rows = language.predicted(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op4_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def with_next(docs: DataFrame) -> DataFrame:
    """Slices of ids with their rows, each also holding the first row of the next slice (``after``; the last one's is the first).

    Rows without an id are not part of the order and left out.
    """
    docs = docs.where("doc_id IS NOT NULL")
    stats = docs.agg(F.count("doc_id"), F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    # Slices are fixed ranges of ids, so that a slice never has more ids than its width, whatever the gaps.
    width = max(1, (stats[0] or 0) * SLICE_BYTES // max(1, stats[1] or 0))
    low = stats[2] or 0
    sliced = docs.withColumn("slice", F.expr(f"(doc_id - {low}) div {width}"))
    firsts = written(sliced.groupBy("slice").agg(F.min("doc_id").alias("doc_id")), "slices")
    # The slice before: within a section of slices, else the last one of the section before, else the last of all.
    sectioned = firsts.withColumn("section", F.expr(f"slice div {SECTION_SLICES}"))
    order, sections = Window.partitionBy("section").orderBy("slice"), Window.orderBy("section")
    last = sectioned.groupBy("section").agg(F.max("slice").alias("last"))
    entered = last.select("section", F.coalesce(F.lag("last").over(sections), F.max("last").over(Window.partitionBy())).alias("entered"))
    ends = sectioned.withColumn("inner", F.lag("slice").over(order)).join(entered, "section").select(
        "doc_id", F.coalesce("inner", "entered").alias("before")
    )
    heads = docs.join(ends, "doc_id").select("doc_id", "text", F.col("before").alias("slice"), F.lit(True).alias("after"))
    return sliced.select("doc_id", "text", "slice", F.lit(False).alias("after")).union(heads)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one id follow each other in order of their texts; a row without an id is its own next document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(ids: pa.ChunkedArray | pa.Array, texts: list[str], following: list[str]) -> pa.Table:
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
        permutations = minhash.Permutations()
        # Where the next text is the next row's, it is signed once.
        chained = following[:-1] == texts[1:]
        every = minhash.signatures(pa.array([*texts, *(following[-1:] if chained else following)], pa.string()), permutations)
        changed = minhash.signatures(pa.array(edited, pa.string()), permutations)
        own, after = every[: len(texts)], every[1:] if chained else every[len(texts) :]
        return pa.table(
            [
                ids.cast(pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                minhash.hexed(own),
                minhash.hexed(changed),
                pa.array((own == changed).mean(axis=1), pa.float64()),
                pa.array((own == after).mean(axis=1), pa.float64()),
            ],
            names=names,
        )

    def compare(rows: pa.Table) -> pa.Table:
        # The row after this slice comes last, even if its id is the smallest of all.
        rows = rows.sort_by([("after", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        inside = rows["after"].to_pylist().count(False)
        texts = rows["text"].to_pylist()
        return compared(rows["doc_id"].slice(0, inside), texts[:inside], texts[1 : inside + 1])

    def alone(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            yield from (compared(b["doc_id"], texts, texts).to_batches() if texts else ())

    without_id = docs.where("doc_id IS NULL").mapInArrow(alone, ddl)
    return with_next(docs).groupBy("slice").applyInArrow(compare, ddl).union(without_id)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encoded(docs, tokenizer_file("byte_bpe_50k.json"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.without_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_removed_lines", kept.alias("kept_sha256"))


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_components(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds (over some 10**8 rows) is null; the operator gives it as a decimal."""
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_difference": op1_page_difference,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_factor_dedup": op4_factor_dedup,
    "op5_minhash": op5_minhash,
    "op6_bpe": op6_bpe,
    "op7_line_chunks": op7_line_chunks,
    "op8_set_join": op8_set_join,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_posting_lists": op12_posting_lists,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}
