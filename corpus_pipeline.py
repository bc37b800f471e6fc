"""A corpus pipeline of five stages over the documents; every stage works on all the stage before it kept.

1. ``toxicity``: documents whose score reaches the threshold go (the model is fitted as in the query of that operator).
2. ``line_dedup``: repeated multi-line chunks are cut out of the texts.
3. ``near_duplicates``: of each group of documents linked by shingle similarity the one with the smallest id stays.
4. ``decontamination``: documents that hold a benchmark item go.
5. ``tokens``: token ids are added, the text is the one they decode to.

Each stage's result is written and read again. Rows without an id have no group and stay; repeated rows of one id stay or go
together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, line_chunks, set_join, toxicity
from spanloom.llm.queries import _remainder, tokenizer_file
from spanloom.llm.tables import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_chunks.without_repeated_chunks(docs)
    counted = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut.select(*[counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = set_join.similar_components(docs)
    dropped = labels.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_decoded_text(docs, tokenizer_file("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

# SQL cannot express the fitted score, content-defined chunks, the embedding or the encoding; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
