"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import corpus
import pytest

from spanloom.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, own in around.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None)
    return out


def typed(rnd, words, count):
    """Texts whose words are misspelt at times, some of the misspellings again."""
    alphabet = "abcdefgéß"
    texts = []
    for _ in range(count):
        out = []
        for _ in range(rnd.randint(0, 60)):
            w = words[min(int(rnd.expovariate(0.2)), len(words) - 1)]
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w) + 1)
                w = w[:at] + rnd.choice(["", alphabet[at % 9]]) + w[at + rnd.randint(0, 1) :]
            out.append(w.upper() if rnd.random() < 0.1 else w)
        texts.append(rnd.choice([" ", ", ", "-", "7"]).join(out))
    return texts


def checked(spark, rows, expected_pairs=True):
    extra = [(i, t, "x", 1, "s", 2, "w") for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id bigint, text string, word string, n int, symbol string, m int, near string").repartition(3)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: tuple(r)[1:] for r in got.collect()}
    want = brute(rows)
    assert got == want
    assert not expected_pairs or sum(v[3] for v in want.values()) > 10
    return want


def test_variants_equal_brute_force(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(5, 12))) for _ in range(25)]
    rows = list(enumerate(typed(rnd, words, 400)))
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (900, ""), (901, " \n"), (902, "ab" * 3000 + " " + "x" * 70000)]
    rows += [(910 + i, "ab" * 3000 + "c") for i in range(6)] + [(930 + i, "ab" * 2000 + "z" + "ab" * 1000 + "c") for i in range(5)]
    want = checked(spark, rows)
    assert any(v[0] for v in want.values())


def test_crowded_symbols_are_divided(spark, monkeypatch):
    rnd = random.Random(2)
    # All words begin and end alike, so that each symbol has to be divided until few words are left.
    words = [f"prefix{''.join(rnd.choice('abc') for _ in range(rnd.randint(2, 5)))}suffix" for _ in range(300)]
    rows = [(i, " ".join(words)) for i in range(5)]
    plain = checked(spark, rows)
    pairs = spelling.near_pairs
    for most in (2, 10):
        monkeypatch.setattr(spelling, "near_pairs", lambda words, most=most: pairs(words, group_words=most))
        assert checked(spark, rows) == plain


def test_chains_of_forms_end_at_the_root(spark):
    rows = [(i, " ".join(["wordaa"] * 5 + ["wordab"] * 25 + ["wordbb"] * 125 + ["worbbb"] * 625)) for i in range(1)]
    want = checked(spark, rows, expected_pairs=False)
    assert want["wordaa"][1] == "worbbb"


def test_without_words(spark):
    for rows in ([(1, None), (2, "ab cd")], []):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert spelling.variants(docs).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_acceptor_is_minimal_and_composes(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(80)})
    acceptor = spelling.Acceptor()
    start = acceptor.add(words)
    assert sorted(acceptor.common(start, start)) == words
    languages = [tuple(sorted(acceptor.common(s, s))) for s in range(len(acceptor.states))]
    assert len(set(languages)) == len(languages)
    got = {frozenset(p) for p in acceptor.pairs(start)}
    assert got == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_text_words_are_whole_runs():
    assert spelling.text_words(1, "ABCDEFé÷gh×ij kl7mnopqr Œuvreuse", noise=10**12) == {"abcdefé÷gh×ij".encode(): 1, b"mnopqr": 1, b"uvreuse": 1}
    assert corpus.words("a b") == ["a", "b"]
