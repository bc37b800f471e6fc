"""Language identification by unigrams over the pieces of a fixed public vocabulary, marginalised over segmentations.

Every language has a probability for each piece. The probability of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm; a text is the product of its words. Piece probabilities are fitted by expectation
maximisation, whose expected counts also sum over all segmentations. Words are runs of letters in lower case with the
vocabulary's word mark in front; a letter without a piece is a piece of its own with a small fixed probability.

The model is fitted on a bounded sample, about ``per_language`` documents and at most about ``sample_chars`` characters of each
language in the order of a hash of their id, of which every word counts; prediction covers all documents and whole texts.

Texts without letters (null, empty) get ``und`` with score 0, as does everything if nothing could be learned. Ties go to the
alphabetically first language. All columns are kept; columns of the new names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.tables import small_batches

# The fitted sample: so many documents and characters of each language, as expected numbers (one text may go beyond by itself).
PER_LANGUAGE, SAMPLE_CHARS, ROUNDS = 1500, 4_000_000, 3
# Pieces that stand for a letter the vocabulary does not have; smoothing of the expected counts.
UNKNOWN, SMOOTHING = 1e-6, 0.05
# Probabilities are scaled per letter so that those of words of up to LONG letters stay within doubles.
LETTER_SCALE, LONG = 16.0, 120
_KEPT_WORDS = 250_000
_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"


def pieces(vocabulary: str | Path) -> list[str]:
    """The vocabulary's pieces in lower case without the special ones, in their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(vocabulary))
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    listed = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    return list(dict.fromkeys(p for p in listed if p == p.lower()))


def piece_numbers(listed: list[str]) -> dict[str, int]:
    """The number of each piece; beginnings that only longer pieces have are there with -1, so that a search can stop early."""
    begun = {p[:i]: -1 for p in listed for i in range(1, len(p))}
    return {**begun, **{p: i for i, p in enumerate(listed)}}


class Lattice:
    """All pieces of some words as edges (word, start, end, piece), ordered by end within the word."""

    def __init__(self, words: list[str], number: dict[str, int], width: np.ndarray):
        unknown = len(width) - 1
        piece, upto = [], []  # pieces in order of their start, and how many there are after each position
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        find = number.get
        for word in words:
            marked = _MARK + word
            size = len(marked)
            for i in range(size):
                j = i + 1
                p = find(marked[i:j])
                if p is None or p < 0:
                    piece.append(unknown)
                while p is not None:
                    if p >= 0:
                        piece.append(p)
                    if j == size:
                        break
                    j += 1
                    p = find(marked[i:j])
                upto.append(len(piece))
        edges = np.diff(np.array(upto, np.int64), prepend=0)
        word_of = np.repeat(np.arange(len(words)), self.sizes)
        start = np.arange(len(upto)) - (np.cumsum(self.sizes) - self.sizes)[word_of]
        word_of, start, piece = np.repeat(word_of, edges), np.repeat(start, edges), np.array(piece, np.int64)
        columns = [word_of, start, start + width[piece], piece]
        order = np.argsort(columns[2], kind="stable")
        self.word, self.start, self.end, self.piece = (c[order] for c in columns)
        self.longest_word = int(self.sizes.max(initial=0))
        self.level = np.searchsorted(self.end, np.arange(self.longest_word + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations of each prefix: (words, positions, languages). p: (pieces, languages), scaled."""
        alpha = np.zeros((len(self.sizes), self.longest_word + 1, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, self.longest_word + 1):
            a, b = self.level[j], self.level[j + 1]
            terms = alpha[self.word[a:b], self.start[a:b]] * p[self.piece[a:b]]
            # The edges of a word that end here are neighbours.
            words, first = np.unique(self.word[a:b], return_index=True)
            alpha[words, j] = np.add.reduceat(terms, first, axis=0) if b > a else 0
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(self.sizes), self.longest_word + 1, p.shape[1]))
        beta[np.arange(len(self.sizes)), self.sizes] = 1
        for j in range(self.longest_word, 0, -1):
            a, b = self.level[j], self.level[j + 1]
            np.add.at(beta, (self.word[a:b], self.start[a:b]), beta[self.word[a:b], j] * p[self.piece[a:b]])
        return beta


def widths(listed: list[str]) -> np.ndarray:
    """Letters of each piece; the last one is the unknown letter."""
    return np.array([len(x) for x in listed] + [1], np.int64)


def scaled(p: np.ndarray, listed: list[str]) -> np.ndarray:
    """Probabilities times the letter scale; the last row is the unknown letter's."""
    return p * (LETTER_SCALE ** widths(listed))[:, None]


def fit_pieces(words: dict[str, int], listed: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts; one more for the unknown letter."""
    number, width = piece_numbers(listed), widths(listed)
    counted: Counter[str] = Counter()
    for word, count in words.items():
        # Longer words are fitted in parts, so that every letter counts.
        for i in range(0, len(word), LONG):
            counted[word[i : i + LONG]] += count
    used = sorted(counted, key=len)
    p = np.full(len(listed) + 1, 1 / len(listed))
    p[-1] = UNKNOWN
    for _ in range(rounds if used else 0):
        expected, q = np.zeros(len(p)), scaled(p[:, None], listed)
        # One part's edges at a time, whatever the number of words.
        for i in range(0, len(used), 4096):
            part = used[i : i + 4096]
            lattice, counts = Lattice(part, number, width), np.array([counted[w] for w in part], float)
            alpha, beta = lattice.forward(q)[:, :, 0], lattice.backward(q)[:, :, 0]
            whole = alpha[np.arange(len(counts)), lattice.sizes]
            through = alpha[lattice.word, lattice.start] * q[lattice.piece, 0] * beta[lattice.word, lattice.end]
            expected += np.bincount(lattice.piece, through * (counts / whole)[lattice.word], len(p))
        p = expected + SMOOTHING
        p /= p[:-1].sum()
        p[-1] = UNKNOWN
    return p


@dataclass
class Model:
    languages: list[str]
    listed: list[str]
    probabilities: np.ndarray  # (pieces and the unknown letter, languages)


class Scorer:
    """Log probabilities of words per language, kept for the words seen lately."""

    def __init__(self, model: Model):
        self.model = model
        self.number = piece_numbers(model.listed)
        self.width = widths(model.listed)
        self.longest = int(self.width.max())
        self.scaled = scaled(model.probabilities, model.listed)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _long(self, word: str) -> np.ndarray:
        """The forward algorithm with a running scale, for words of any length."""
        marked, p = _MARK + word, self.model.probabilities
        window = [np.ones(p.shape[1])]  # alpha of the last positions, relative to ``shift``
        shift = np.zeros(p.shape[1])
        for j in range(1, len(marked) + 1):
            total = np.zeros(p.shape[1])
            for i in range(max(0, j - self.longest), j):
                piece = self.number.get(marked[i:j], -1)
                if piece < 0 and i == j - 1:
                    piece = len(self.model.listed)
                if piece >= 0:
                    total += window[i - j] * p[piece]
            scale = np.maximum(total, 1e-290)
            window = [x / scale for x in window[-self.longest :]] + [total / scale]
            shift += np.log(scale)
        return shift

    def learn(self, words: list[str]) -> None:
        """Adds the words to the table."""
        if len(self.rows) > _KEPT_WORDS:
            self.rows, self.table = {}, self.table[:0]
        short = [w for w in words if len(w) <= LONG]
        blocks = [self.table]
        for i in range(0, len(short), 2048):
            part = sorted(short[i : i + 2048], key=len)
            lattice = Lattice(part, self.number, self.width)
            alpha = lattice.forward(self.scaled)
            whole = alpha[np.arange(len(part)), lattice.sizes]
            blocks.append(np.log(np.maximum(whole, 1e-300)) - lattice.sizes[:, None] * np.log(LETTER_SCALE))
            for w in part:
                self.rows[w] = len(self.rows)
        for w in words:
            if len(w) > LONG:
                blocks.append(self._long(w)[None])
                self.rows[w] = len(self.rows)
        self.table = np.concatenate(blocks)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        missing = set().union(*words).difference(self.rows) if words else set()
        if missing:
            if len(self.rows) > _KEPT_WORDS:
                missing = set().union(*words)
            self.learn(sorted(missing))
        labels, scores = [], []
        for own in words:
            if not own or not self.model.languages:
                labels.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(np.argmax(total))
            labels.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return labels, scores


def learn(
    docs: DataFrame, learnable: Column, vocabulary: str | Path, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Model:
    """Fits piece probabilities of every language of the learnable rows."""
    small_batches(docs.sparkSession)
    listed = pieces(vocabulary)
    usable = docs.where(learnable & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = usable.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_rows"), F.sum(F.char_length(text)).alias("_chars"))
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # One row per language, as the model has one column for each: small enough for every task, so no text is shuffled.
    sample = usable.join(F.broadcast(counts), F.col(lang) == F.col("_lang")).where(
        (place < F.lit(float(per_language)) / F.col("_rows")) & (place * F.col("_chars") <= F.lit(float(sample_chars)))
    )

    def count(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for name, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                found.setdefault(name, Counter()).update(_WORD.findall(t.lower()))
            rows = [(name, w, n) for name, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "word", "n"],
            )

    words = (
        sample.select(F.col("_lang").alias("lang"), F.col(text).alias("text"))
        .mapInArrow(count, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )

    def fit(rows: pa.Table) -> pa.Table:
        p = fit_pieces(dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)), listed)
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()], pa.string()), "p": pa.array([p.tobytes()], pa.binary())})

    # One group per language, of bounded size because the sample is.
    fitted = sorted((r["lang"], r["p"]) for r in words.groupBy("lang").applyInArrow(fit, "lang string, p binary").collect())
    columns = [np.frombuffer(p, float) for _, p in fitted]
    table = np.stack(columns, axis=1) if columns else np.zeros((len(listed) + 1, 0))
    return Model([name for name, _ in fitted], listed, table)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the posterior probability of the predicted language."""
    small_batches(docs.sparkSession)
    rows = docs.drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    schema = T.StructType(list(rows.schema.fields)).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages, whatever the corpus

    def predict(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            labels, scores = scorer.predict(b[text].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"]
            )

    return rows.mapInArrow(predict, schema)
