"""Spelling variants: pairs of vocabulary words one edit apart, by composing finite-state machines, and the form of each word.

The vocabulary is an acceptor. Composing it with a transducer that inserts, deletes or replaces one code point, and with the
acceptor again, accepts exactly the pairs of words one edit apart. Before the edit both sides are in the same state, so the
composition walks the acceptor once, tries an edit at every state and then follows what the two states have in common.

The initial state divides the work. Two words one edit apart, of m + 1 and of m or m + 1 code points, agree on m code points at
both ends together; so they agree on the first h or on the last m - h + 1. Each word therefore starts under four symbols (its
first half and its last half, for partners as long or shorter and for longer ones), and only words under one symbol are
composed, on the part between the agreed ends. A symbol with more than ``GROUP_WORDS`` words is divided in the same way on that
part, until few words or no undecided code points are left, so no group of words has to meet in one task as a whole, and no
pair is lost. The acceptor of a task is minimised over all of its symbols together.

Null texts have no words; a null id counts as empty. Repeated rows count as often as they occur. Empty tables give no rows; other
columns are not read. A word must fit a task's memory with some hundred bytes per code point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import small_batches, written

SHORTEST, RAREST, FORM_TIMES = 6, 5, 5
# One run in so many loses a code point, as the contract's noise.
NOISE = 199
# Words under one symbol of the initial state, and words composed at a time.
GROUP_WORDS = 20_000
TASK_WORDS = 50_000
# Distinct words a task counts before it sends them.
HELD_WORDS = 200_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# A-Z, a-z and U+00C0 to U+00FF in UTF-8, after lower-casing.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


# --- vocabulary -------------------------------------------------------------------------------------------------------


def text_words(doc_id: int | None, text: str | None, noise: int = NOISE) -> Counter[bytes]:
    """Runs of one text with their numbers, as UTF-8; runs that cannot give a word are left out."""
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[bytes] = Counter()
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    for run, count in Counter(m[0] for m in _RUN.finditer(raw) if m.end() - m.start() >= SHORTEST).items():
        h = crc32(run, prefix)
        if h % noise == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += count
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            for word, count in text_words(doc_id, text.as_py()).items():
                held[word] += count
            if len(held) >= HELD_WORDS:
                yield _word_rows(held)
                held.clear()
    if held:
        yield _word_rows(held)


def _word_rows(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], schema=_WORDS)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.char_length("word") >= SHORTEST) & (F.col("n") >= RAREST))


# --- finite-state machines --------------------------------------------------------------------------------------------


class Acceptor:
    """Minimised acyclic acceptor: a state is (accepts the end, arcs); equal states are one."""

    def __init__(self) -> None:
        self.states: list[tuple[bool, dict[str, int]]] = []
        self._known: dict[tuple, int] = {}
        self._edits: dict[int, list[tuple[str, str, str]]] = {}

    def _frozen(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.states)
            self.states.append((final, arcs))
        return self._known[key]

    def add(self, words: Iterable[str]) -> int:
        """The start state of a machine for these words (distinct, ascending), sharing states with the earlier ones."""
        # Open states along the last word: arcs so far, whether the end is accepted, and the letter that leads on.
        path: list[tuple[dict[str, int], bool, str]] = []
        before = ""
        tip: tuple[dict[str, int], bool] = ({}, False)
        for word in words:
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            tip = self._closed(path, tip, shared)
            for letter in word[shared:]:
                path.append((*tip, letter))
                tip = ({}, False)
            tip = (tip[0], True)
            before = word
        return self._frozen(*reversed(self._closed(path, tip, 0)))

    def _closed(self, path: list, tip: tuple[dict[str, int], bool], depth: int) -> tuple[dict[str, int], bool]:
        while len(path) > depth:
            state = self._frozen(tip[1], tip[0])
            arcs, final, letter = path.pop()
            arcs[letter] = state
            tip = (arcs, final)
        return tip

    def common(self, p: int, q: int) -> Iterator[str]:
        """The strings that both states accept."""
        stack: list[tuple[int, int, tuple | None]] = [(p, q, None)]
        while stack:
            p, q, path = stack.pop()
            (final_p, arcs_p), (final_q, arcs_q) = self.states[p], self.states[q]
            if final_p and final_q:
                yield _spelled(path)
            if len(arcs_q) < len(arcs_p):
                arcs_p, arcs_q = arcs_q, arcs_p
            stack.extend((state, arcs_q[c], (path, c)) for c, state in arcs_p.items() if c in arcs_q)

    def edits(self, p: int) -> list[tuple[str, str, str]]:
        """(x, y, rest): from this state x + rest and y + rest are accepted; x and y are one code point, or y is none."""
        if p not in self._edits:
            arcs = self.states[p][1]
            out = [(c, "", rest) for c, state in arcs.items() for rest in self.common(state, p)]
            for c, state in arcs.items():
                out += [(c, d, rest) for d, other in arcs.items() if c < d for rest in self.common(state, other)]
            self._edits[p] = out
        return self._edits[p]

    def pairs(self, start: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition from this start state: words one edit apart, the longer (or smaller) one first."""
        stack: list[tuple[int, tuple | None]] = [(start, None)]
        while stack:
            p, path = stack.pop()
            if own := self.edits(p):
                head = _spelled(path)
                yield from ((head + x + rest, head + y + rest) for x, y, rest in own)
            stack.extend((state, (path, c)) for c, state in self.states[p][1].items())


def _spelled(path: tuple | None) -> str:
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


# --- pairs ------------------------------------------------------------------------------------------------------------


def _symbols(rows: DataFrame) -> DataFrame:
    """Each row under the two symbols that decide half of its open middle. Columns: word, n, m, head, tail (agreed lengths)."""
    rest = F.col("m") - F.col("head") - F.col("tail")
    half = F.ceil(rest / 2).cast("int")
    options = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + rest - half + 1).cast("int").alias("tail")),
    )
    split = rows.select("word", "n", "m", F.explode(options).alias("o")).select("word", "n", "m", "o.head", "o.tail")
    symbol = F.concat_ws(
        " ", "m", "head", "tail", F.expr("substring(word, 1, head)"), F.expr("substring(word, char_length(word) - tail + 1, tail)")
    )
    return split.withColumn("symbol", symbol)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words under one symbol; rows come sorted by symbol and word."""
    for symbols in _whole_symbols(batches):
        acceptor, out = Acceptor(), []
        for rows in symbols:
            (_, _, m, head, tail) = rows[0][1:]
            middles = {word[head : len(word) - tail]: (word, n) for _, word, n, *_ in rows}
            start = acceptor.add(sorted(middles))
            for longer, other in acceptor.pairs(start):
                if len(longer) == m - head - tail + 1:  # two of the shorter words meet under another symbol
                    out.append((*middles[longer], *middles[other]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PAIRS, strict=True)], schema=_PAIRS)


def _whole_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """Lists of symbols with two words or more; each list holds about ``TASK_WORDS`` words."""
    rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("symbol", "word", "n", "m", "head", "tail")), strict=True))
    held, count = [], 0
    for _, same in groupby(rows, key=lambda r: r[0]):
        same = list(same)
        if len(same) > 1:
            held.append(same)
            count += len(same)
        if count >= TASK_WORDS:
            yield held
            held, count = [], 0
    if held:
        yield held


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words one edit apart, some of them more than once."""
    length = F.char_length("word")
    starts = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    open_rows, found = starts, None
    while open_rows is not None:
        rows = written(_symbols(open_rows), "symbols")
        crowded = rows.groupBy("symbol").count().where(F.col("count") > group_words).select("symbol")
        crowded = written(rows.where("m > head + tail").join(crowded, "symbol", "left_semi"), "crowded")
        if crowded.isEmpty():
            ready, open_rows = rows, None
        else:
            ready, open_rows = rows.join(crowded.select("symbol").distinct(), "symbol", "left_anti"), crowded.drop("symbol").distinct()
        dealt = ready.repartition("symbol").sortWithinPartitions("symbol", "word")
        pairs = dealt.select("symbol", "word", "n", "m", "head", "tail").mapInArrow(_composed, "a string, a_n bigint, b string, b_n bigint")
        found = pairs if found is None else found.union(pairs)
    return found


# --- forms and roots --------------------------------------------------------------------------------------------------


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) for words with a form: pointers are doubled; each step of a chain is ``FORM_TIMES`` times as frequent."""
    steps, n = 1, RAREST * FORM_TIMES
    while n * FORM_TIMES <= largest:
        steps, n = steps + 1, n * FORM_TIMES
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, doc_id, text), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "b_n", "a", "a_n")
    )
    once = both.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))
    # Most frequent first, then the smallest word: strings compare by their UTF-8 bytes, which is code-point order.
    best = once.groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    chosen = F.col("best.less") * -1 >= FORM_TIMES * F.col("n")
    linked = written(
        best.select(
            "word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    largest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(linked.where("form IS NOT NULL"), largest)
    return (
        words.join(linked, "word", "left")
        .join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
