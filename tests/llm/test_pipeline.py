"""The pipeline over small tables: every stage takes effect, copies go, clean documents stay."""

import random

import pyarrow as pa
from corpus import prose, shingles, vocabulary

import corpus_pipeline
from spanloom.llm import decontaminate
from spanloom.llm.queries import tokenizer_file


def test_pipeline(spark, tmp_path):
    rnd, words = random.Random(6), vocabulary(6, 2000)
    # On one line, so that removing repeated lines leaves them to the later stages.
    items = [(i, prose(rnd, words, 40).replace("\n", " ")) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        kind = i % 10
        text = prose(rnd, words, rnd.randint(60, 120))
        if kind == 0:
            text = text.replace("\n", " ")
        if kind == 1:
            text = f"{text}. you vilest thing. {prose(rnd, words, 20)}"
        elif kind == 2:
            text = f"{text} {items[i % 5][1]} end"
        elif kind == 3:
            text = rows[i - 3][1] + " tail"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(kind == 1)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "alone here", "en", "s", 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    kept = {i for i in range(400) if i % 10 not in (1, 2, 3)}
    assert kept <= set(got) and {900, 901, None} <= set(got)
    assert not {i for i in got if i is not None and i < 400 and i % 10 in (1, 2, 3)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for r in got.values():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    # No similar pair and no item is left, by brute force.
    texts = [(i, shingles(r["text"])) for i, r in got.items() if r["text"]]
    assert not [1 for a in range(len(texts)) for b in range(a) if 100 * len(texts[a][1] & texts[b][1]) >= 80 * len(texts[a][1] | texts[b][1]) > 0]
    words_, bounds = decontaminate.words_of(pa.array([r["text"] for r in got.values()], pa.string()))
    block = decontaminate._block(items)
    assert not block.matches(words_, bounds)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    """Stages on a table of awkward rows: all columns of the input, in order, but for the last stage's new ones."""
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
