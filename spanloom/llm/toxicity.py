"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are fitted to document labels.

A sentence's score is a logistic function of the weights of its distinct words and of their first letters (hashed). The
document is toxic if at least one sentence is: score = 1 - product of (1 - sentence score). Only documents are labelled, so
the gradient of the document loss decides which sentences of a toxic document take the blame; afterwards the sentence scores
locate them.

The model is fitted on a bounded sample of whole texts, short and long: at most ``per_label`` documents of each label and
``sample_chars`` characters of them together, the first in the order of a hash of their id (a text longer than the whole
sample is never learned from). Its features are counted and screened by Spark; the driver gets those that pass, by sentence,
and fits their weights. Scoring covers all documents and whole texts.

Length alone never makes a text toxic: the fit ends with a bias of ``LOW``, at which a sentence without a learned feature
counts 2e-9, and weighs clean documents as if they were ``LONGER`` times as long.

Null and empty texts have no sentence and score 0. Without labelled documents of both kinds every score is 0. Rows with a
null id are scored but never learned from. Several labels of one id count as toxic if one is; of several
usable rows of one id one is learned from. All columns are kept; columns
of the new names are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.tables import small_batches, written

DIMENSIONS = 1 << 20
PREFIX_LETTERS = 5
PER_LABEL, SAMPLE_CHARS = 3000, 20_000_000
THRESHOLD = 0.7
# A feature must occur in so many fitted documents, and differ between the labels by so many standard errors.
SUPPORT, CLEAR = 4, 3.0
# The last bias, and how many times as long clean documents count in the fit to it.
LOW, LONGER = -20.0, 300
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_KEPT_WORDS = 150_000


def _slot(token: str) -> int:
    """A stable hash of a token."""
    value = 0xCBF29CE484222325
    for byte in token.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return ((value ^ (value >> 32)) * 0x9E3779B97F4A7C15 >> 20) & (DIMENSIONS - 1)


class _Slots(dict):
    """Slots of a word and of its first letters."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > _KEPT_WORDS:
            self.clear()
        slots = (_slot(word), _slot("^" + word[:PREFIX_LETTERS]))
        self[word] = slots
        return slots


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of every sentence that has a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m[0])]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _telling(held: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which features are fitted. ``held``: documents of either label that hold a feature; ``many``: all of either label."""
    many = many.reshape(2, 1)
    both = held.sum(axis=0) / many.sum()
    spread = np.sqrt(both * (1 - both) * (1 / many).sum()) + 1e-12
    return (held.sum(axis=0) >= SUPPORT) & (np.abs((held / many)[1] - (held / many)[0]) >= CLEAR * spread)


def fit(labels: np.ndarray, bags: pa.Array, rounds: int = 400, pace: float = 3.0, sparsity: float = 3e-4) -> Model:
    """Weights that minimise the noisy-or log loss of the bags (documents: sentences: slots) plus an L1 penalty.

    Features that documents of both labels hold about equally often (less than ``CLEAR`` standard errors apart) are screened
    out. Accelerated proximal gradient steps, restarted when they overshoot; the penalty keeps chance words at zero.

    A free bias settles where a sentence of the sample's usual length of text is harmless, which thousands of sentences are
    not. So a second run goes on from the first one's weights, scaled to the low bias, which then stays; the weights alone
    must tell toxic from clean sentences, and clean documents weigh as much as ones many times as long would.
    """
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), -50.0)
    in_bag = bags.flatten()
    # All arrays are as long as the slots given and the distinct ones of them.
    ids, slots = np.unique(in_bag.flatten().to_numpy(), return_inverse=True)
    bag_of = np.repeat(np.arange(len(bags)), pc.list_value_length(bags).to_numpy())
    sentence_of = np.repeat(np.arange(len(bag_of)), pc.list_value_length(in_bag).to_numpy())
    # Documents of each label that hold a feature.
    pairs = np.unique(bag_of[sentence_of] * DIMENSIONS + slots)
    label_of = y[pairs // DIMENSIONS]
    held = np.stack([np.bincount(pairs[label_of == v] % DIMENSIONS, minlength=len(ids)) for v in (0, 1)])
    used = _telling(held, np.array([(y == 0).sum(), (y == 1).sum()]))
    count, place = int(used.sum()), np.cumsum(used) - 1
    listed = used[slots]
    feature, sentence_of = place[slots[listed]], sentence_of[listed]

    def steps(w: np.ndarray, bias: float, longer: float, free: bool, pace: float, sparsity: float) -> tuple[np.ndarray, float]:
        before, bias_before, run = w, bias, 0
        share = np.where(y == 1, 0.5 / (y == 1).sum(), longer * 0.5 / (y == 0).sum())
        for _ in range(rounds):
            ahead = run / (run + 3)
            v, c = w + ahead * (w - before), bias + ahead * (bias - bias_before)
            z = c + np.bincount(sentence_of, v[feature], len(bag_of))
            total = np.bincount(bag_of, np.logaddexp(0, z), len(y))  # -log(1 - document score)
            blame = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-12, 500)), 1.0) * share
            dz = blame[bag_of] * _sigmoid(z)
            moved = v - pace * np.bincount(feature, dz[sentence_of], count)
            moved = np.sign(moved) * np.maximum(np.abs(moved) - pace * sparsity, 0)
            run = 0 if float((v - moved) @ (moved - w)) > 0 else run + 1
            before, bias_before = w, bias
            # Of very long texts the bias takes all the slope there is; its steps are bounded.
            w, bias = moved, c - min(1.0, max(-1.0, pace * float(dz.sum()))) if free else bias
        return w, bias

    # A document of the mean length starts out harmless.
    w, bias = steps(np.zeros(count), -1.5 - float(np.log(max(1.0, len(bag_of) / len(y)))), 1.0, True, pace, sparsity)
    if bias > LOW:
        w, bias = steps(w * (LOW / min(bias, -1.0)), LOW, LONGER, False, 3 * pace, sparsity / 3)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[ids[used]] = w
    return Model(weights, float(bias))


def learn(
    docs: DataFrame, labels: DataFrame, learnable: Column, per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fits the model. ``learnable``: which rows of ``docs`` may be learned from."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    length = F.length(text).cast("bigint")
    usable = docs.where(learnable & F.col(text).isNotNull() & (length <= sample_chars))
    order = F.xxhash64(doc_id)
    # One row per id: that of the smallest text hash.
    row = F.min(F.struct(F.xxhash64(text).alias("hash"), length.alias("length"))).alias("_row")
    ids = known.join(usable.groupBy(doc_id).agg(row), doc_id)
    first = ids.where("_label = 1").orderBy(order).limit(per_label).union(ids.where("_label = 0").orderBy(order).limit(per_label))
    # At most 2 * per_label rows.
    so_far = F.sum("_row.length").over(Window.partitionBy("_label").orderBy(order, doc_id))
    chosen = first.withColumn("_chars", so_far).where(F.col("_chars") <= sample_chars).select(doc_id, "_label", F.col("_row.hash").alias("_hash"))

    def features(batches):
        slots = _Slots()
        for b in batches:
            bags = []
            for t in b["text"].to_pylist():
                low = t.lower()
                words = [dict.fromkeys(_WORD.findall(low[x:y])) for x, y in sentences(low)]
                bags.append([[s for word in sentence for s in slots[word]] for sentence in words])
            yield pa.RecordBatch.from_arrays(
                [b["_label"], pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["label", "bags"]
            )

    # The sample is bounded by its parameters, so it can be sent to every task. Equal rows meet in one before they are shuffled.
    rows = usable.select(doc_id, F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))
    sample = rows.join(F.broadcast(chosen), [doc_id, "_hash"]).groupBy(doc_id, "_label").agg(F.min("text").alias("text")).select("_label", "text")
    bags = written(sample.mapInArrow(features, "label int, bags array<array<int>>"), "bags")
    rows = _screened(bags).toArrow()
    return fit(rows["label"].to_numpy(), rows["bags"].combine_chunks())


def _screened(bags: DataFrame) -> DataFrame:
    """The bags with the features that are fitted only; every sentence stays. One row per feature goes to the driver."""
    many = dict(bags.groupBy("label").count().collect())
    clean, toxic = (F.count_if(F.col("label") == v) for v in (0, 1))
    held = bags.select("label", F.explode(F.array_distinct(F.flatten("bags"))).alias("slot")).groupBy("slot")
    held = held.agg(clean.alias("clean"), toxic.alias("toxic")).where(F.col("clean") + F.col("toxic") >= SUPPORT).toArrow()
    used = held["slot"].to_numpy()
    if 0 in many and 1 in many:
        used = used[_telling(np.stack([held["clean"].to_numpy(), held["toxic"].to_numpy()]), np.array([many[0], many[1]]))]
    packed = used.astype(np.int32).tobytes()

    def screen(batches):
        kept = np.zeros(DIMENSIONS, bool)
        kept[np.frombuffer(packed, np.int32)] = True
        for b in batches:
            in_bag = b["bags"].flatten()
            slots = in_bag.flatten().to_numpy()
            stays = kept[slots]
            before = np.concatenate([[0], np.cumsum(stays)])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(in_bag))])
            left = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(slots[stays], pa.int32()))
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(b["bags"]))])
            yield pa.RecordBatch.from_arrays([b["label"], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), left)], names=["label", "bags"])

    return bags.mapInArrow(screen, bags.schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``offending``: start, end and score of the sentences that are toxic by themselves (0.5 or more)."""
    small_batches(docs.sparkSession)
    rows = docs.drop(*[c for c in ("score", "offending") if c in docs.columns])
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType())
    schema = T.StructType(list(rows.schema.fields)).add("score", T.DoubleType()).add("offending", T.ArrayType(span))
    used = np.flatnonzero(model.weights).astype(np.int32)
    packed, bias = (used.tobytes(), model.weights[used].tobytes()), model.bias

    def score(batches):
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[np.frombuffer(packed[0], np.int32)] = np.frombuffer(packed[1], np.float32)
        table = _Weights(weights)
        for b in batches:
            totals, spans = [], []
            for t in b[text].to_pylist():
                total, offending = score_text(t, table, bias)
                totals.append(total)
                spans.append(offending)
            arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            columns = [*b.columns, pa.array(totals, pa.float64()), pa.array(spans, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "score", "offending"])

    return rows.mapInArrow(score, schema)


class _Weights(dict):
    """The weight of a word as written."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _KEPT_WORDS:
            self.clear()
        low = word.lower()
        value = float(self.weights[_slot(low)] + self.weights[_slot("^" + low[:PREFIX_LETTERS])])
        self[word] = value
        return value


def score_text(text: str | None, table: dict[str, float], bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of a text's sentences, and its toxic sentences."""
    if not text:
        return 0.0, []
    spans, z = [], []
    for match in _SENTENCE.finditer(text):
        words = set(_WORD.findall(match[0]))
        if words:
            spans.append(match.span())
            z.append(sum(map(table.__getitem__, words)))
    if not z:
        return 0.0, []
    z = np.array(z) + bias
    total = -np.expm1(-np.logaddexp(0, z).sum())
    p = _sigmoid(z)
    return float(total), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]
