"""Toxicity, language, tokens, decontamination, sharding and pages."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import prose, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, language, page_difference, sharding, toxicity
from spanloom.llm.queries import tokenizer_file

# --- toxicity ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, words = random.Random(1), vocabulary(1, 200)
    rows, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.3
        sentences = [prose(rnd, words, 8).replace("\n", " ").replace(".", "") for _ in range(rnd.randint(2, 9))]
        if toxic:
            at = rnd.randrange(len(sentences))
            sentences[at] += " " + rnd.choice(["vilest", "scoundrel"])
        rows.append((i, ". ".join(sentences), "x"))
        labels.append((i, int(toxic)))
    labels += [(5000, 1), (None, 1), (3, None), (labels[0][0], labels[0][1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, offending string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score", "offending"]
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").collect()}
    held = [r for r in got.collect() if r["doc_id"] % 3 == 1]
    right = sum((r["score"] >= toxicity.THRESHOLD) == bool(truth.get(r["doc_id"])) for r in held if r["doc_id"] in truth)
    assert right >= 0.97 * len(held)
    for r in held:
        for span in r["offending"]:
            assert any(w in r["text"][span["start"] : span["end"]] for w in ("vilest", "scoundrel"))
        assert 0 <= r["score"] <= 1


def test_toxicity_of_awkward_rows(docs, empty, labelled, spark):
    model = toxicity.learn(empty, labelled[1], F.lit(True))
    scores = [r["score"] for r in toxicity.scored(docs, model).collect()]
    assert len(scores) == docs.count() and max(scores) < 1e-6
    assert toxicity.scored(empty, model).count() == 0
    texts = [None, "", "...", "vile." * 3000]
    assert [toxicity.score_text(t, toxicity._Weights(model.weights), model.bias)[0] for t in texts[:3]] == [0.0, 0.0, 0.0]


def test_length_alone_is_not_toxic(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 1)
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where("doc_id % 3 = 1").select("text").distinct().collect()
    joined = ". ".join(r["text"] for r in clean) + ". "
    table = toxicity._Weights(model.weights)
    for length in (100_000, 1_000_000, 10_000_000):
        text = (joined * (length // len(joined) + 1))[:length]
        assert toxicity.score_text(text, table, model.bias)[0] < toxicity.THRESHOLD
    # One toxic sentence makes a long text toxic.
    score, spans = toxicity.score_text(f"{text}. you vilest thing. {text[:1000]}", table, model.bias)
    assert score >= toxicity.THRESHOLD and len(spans) == 1


def test_toxicity_learns_from_long_texts(labelled):
    docs, labels = labelled
    tail = " ".join(["harmless words " * 30 + "."] * 100)
    long = docs.withColumn("text", F.concat("text", F.lit(". " + tail)))
    model = toxicity.learn(long, labels, F.lit(True))
    table = toxicity._Weights(model.weights)
    assert toxicity.score_text("you vilest thing", table, model.bias)[0] >= toxicity.THRESHOLD
    # The sample is bounded by characters over all its texts, not by length per text.
    few = toxicity.learn(long, labels, F.lit(True), sample_chars=40_000)
    assert not few.weights.any()


def test_toxicity_learns_from_one_usable_row_per_id(labelled, monkeypatch):
    docs, labels = labelled
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda labels, bags: sizes.append((len(labels), int(labels.sum()))))
    toxicity.learn(docs, labels, F.lit(True), sample_chars=1_000_000)
    unusable = docs.withColumn("text", F.lit(None).cast("string")).union(docs.withColumn("text", F.repeat(F.lit("x"), 1_000_001)).where("doc_id < 5"))
    other = docs.withColumn("text", F.concat("text", F.lit(" again")))
    toxicity.learn(docs.union(docs).union(unusable).union(other), labels, F.lit(True), sample_chars=1_000_000)
    assert sizes[0] == sizes[1] and sizes[0][0] == 600


def test_toxicity_features_are_screened_before_the_driver(labelled, monkeypatch):
    docs, labels = labelled
    fit, seen = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda labels, bags: seen.append((labels, bags)) or fit(labels, bags))
    model = toxicity.learn(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "_screened", lambda bags: bags)
    whole = toxicity.learn(docs, labels, F.lit(True))
    (few_labels, few), (all_labels, every) = seen
    slots, all_slots = (set(b.flatten().flatten().to_pylist()) for b in (few, every))
    # What is fitted goes to the driver and little else: every sentence, but not every word of it.
    assert set(np.flatnonzero(model.weights).tolist()) <= slots and 10 * len(slots) < len(all_slots)
    assert sorted(zip(few_labels.tolist(), map(len, few.to_pylist()), strict=True)) == sorted(zip(all_labels.tolist(), map(len, every.to_pylist()), strict=True))
    assert model.weights.any() and model.weights == pytest.approx(whole.weights, abs=1e-5) and model.bias == whole.bias


def test_toxicity_fit_takes_memory_by_its_bags():
    bags = pa.array([[[1, 2]], [[1, 3], [2]]] * 20, pa.list_(pa.list_(pa.int32())))
    tracemalloc.start()
    model = toxicity.fit(np.array([0, 1] * 20), bags)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(np.flatnonzero(model.weights).tolist()) <= {1, 2, 3} and peak < 2 * model.weights.nbytes


def test_noisy_or():
    weights = np.zeros(toxicity.DIMENSIONS, np.float32)
    weights[toxicity._slot("bad")] = 2.0
    table = toxicity._Weights(weights)
    p = [1 / (1 + math.exp(-z)) for z in (-1 + 2, -1)]
    score, spans = toxicity.score_text("Bad thing. fine here", table, -1.0)
    assert score == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))
    assert [s[:2] for s in spans] == [(0, 9)]


# --- language ---------------------------------------------------------------------------------------------------------


def segmentations(word, p, unknown):
    """Sum over all segmentations by plain recursion."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        if word[:j] in p:
            total += p[word[:j]] * segmentations(word[j:], p, unknown)
    if word[0] not in p:
        total += unknown * segmentations(word[1:], p, unknown)
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcü", min_size=1, max_size=7), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(words):
    listed = ["▁", "▁a", "a", "b", "ab", "abc", "ba", "c", "▁ab"]
    probabilities = np.array([[0.1, 0.2], [0.05, 0.1], [0.2, 0.1], [0.1, 0.05], [0.1, 0.1], [0.2, 0.05], [0.1, 0.2], [0.1, 0.1], [0.05, 0.1], [1e-6, 1e-6]])
    scorer = language.Scorer(language.Model(["x", "y"], listed, probabilities))
    scorer.learn(sorted(set(words)))
    for w in set(words):
        for k in range(2):
            expected = segmentations("▁" + w, dict(zip(listed, probabilities[:, k], strict=False)), 1e-6)
            assert scorer.table[scorer.rows[w], k] == pytest.approx(math.log(expected))
            assert scorer._long(w)[k] == pytest.approx(math.log(expected))


def cuts(word, listed):
    """All segmentations as lists of pieces; a letter without a piece is None."""
    if not word:
        return [[]]
    out = [[word[:j], *rest] for j in range(1, len(word) + 1) if word[:j] in listed for rest in cuts(word[j:], listed)]
    return out if word[0] in listed else out + [[None, *rest] for rest in cuts(word[1:], listed)]


def test_fit_equals_expectation_maximisation_by_enumeration():
    listed = ["▁", "▁a", "a", "b", "ab", "abc", "ba", "c", "▁ab"]
    words = {"abc": 4, "ab": 1, "baab": 2, "cübc": 1, "aaba": 3, "once": 1, "x" * 3: 2}
    p = dict.fromkeys(listed, 1 / len(listed)) | {None: language.UNKNOWN}
    for _ in range(language.ROUNDS):
        expected = dict.fromkeys(p, 0.0)
        for word, count in words.items():
            weighted = [(math.prod(p[x] for x in cut), cut) for cut in cuts("▁" + word, listed)]
            total = sum(w for w, _ in weighted)
            for w, cut in weighted:
                for piece in cut:
                    expected[piece] += count * w / total
        smooth = {k: v + language.SMOOTHING for k, v in expected.items()}
        known = sum(v for k, v in smooth.items() if k)
        p = {k: v / known for k, v in smooth.items()} | {None: language.UNKNOWN}
    got = language.fit_pieces(words, listed)
    assert got == pytest.approx([p[k] for k in listed] + [language.UNKNOWN])


def test_fit_uses_every_word_and_letter():
    """Many words met once, and words of any length, count as they do in parts."""
    listed = ["▁", "a", "b", "ab"]
    once = {f"{'a' * (1 + i % 90)}{'b' * (i // 90)}": 1 for i in range(9000)}
    assert len(once) == 9000
    few = language.fit_pieces({"ab": 1}, listed)
    many = language.fit_pieces(once | {"ab" * 5000: 1}, listed)
    assert not np.allclose(few, many)
    halves = {"ab" * 60: 83, "ab" * 20: 1}
    assert language.fit_pieces({"ab" * 5000: 1}, listed) == pytest.approx(language.fit_pieces(halves, listed))


def test_language_on_held_out_documents(spark, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    rnd = random.Random(2)
    endings = {"en": ["ing", "tion", "the"], "de": ["ung", "lich", "sch"], "fr": ["eux", "ment", "que"]}
    rows = []
    for i in range(240):
        lang = rnd.choice(list(endings))
        words = [rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") + rnd.choice(endings[lang]) for _ in range(rnd.randint(3, 30))]
        rows.append((i, " ".join(words), lang, "old"))
    rows += [(900, None, "en", "o"), (901, "", None, "o"), (902, "12 %% --", "en", "o"), (903, "q" * 4000, None, "o"), (None, "thing thing", None, "o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    model = language.learn(docs, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False)), path)
    got = {r["doc_id"]: r for r in language.predicted(docs, model).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and r[0] % 5 == 0]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] in endings and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.learn(empty, F.lit(True), path)
    assert {r["lang_pred"] for r in language.predicted(docs, nothing).collect()} == {"und"}


# --- tokens -----------------------------------------------------------------------------------------------------------

PARTS = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "'", "a", "The", "é", "1", "½", "漢", "🙂", "<|endoftext|>", "<|", "--", "....", "́", "\x00", "aaaaaaaa", "ing", "_"]


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=30)))
def test_ids_equal_the_library(tokenizers, text):
    ours, library = tokenizers
    expected = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == expected
    assert ours.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_encoded_table(docs, empty, tokenizers):
    got = bpe.encoded(docs, tokenizer_file("byte_bpe_50k.json"))
    assert got.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    for r in got.collect():
        assert r["ids"] == tokenizers[1].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert bpe.with_decoded_text(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaks(spark):
    rnd, words = random.Random(9), vocabulary(9, 3000)
    items = [(i, prose(rnd, words, rnd.randint(12, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "!!")]
    docs, truth = [], set()
    for i in range(300):
        parts = [prose(rnd, words, rnd.randint(0, 80))]
        if i % 2 == 0:
            item, text = items[rnd.randrange(40)]
            own = text.split()
            for _ in range(rnd.choice([0, 0, 1, len(own) // 8])):
                at = rnd.randrange(len(own))
                change = rnd.randrange(3)
                own[at : at + (change != 1)] = [] if change == 0 else ["swap"]
            parts.append(" ".join(own).upper() if i % 4 == 0 else " ".join(own))
            truth.add((i, item))
        parts.append(prose(rnd, words, rnd.randint(0, 80)))
        docs.append((i, "  ".join(parts), "x"))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, items[0][1], "x"), (1002, items[1][1], "x"), (1002, items[1][1], "x")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id int, text string"), truth


def slow_matches(docs, items):
    out = set()
    dw, db = decontaminate.words_of(pa.array([d[1] for d in docs], pa.string()))
    iw, ib = decontaminate.words_of(pa.array([t for _, t in items], pa.string()))
    for d in range(len(docs)):
        own = dw[db[d] : db[d + 1]]
        for i, (item, _) in enumerate(items):
            target = iw[ib[i] : ib[i + 1]]
            if len(target) and len(own) and decontaminate.edits(target, own)[0] <= decontaminate.allowed(len(target)):
                out.add((docs[d][0], item))
    return out


def test_leaks_are_found(leaks):
    docs, items, truth = leaks
    found = decontaminate.contaminated(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    exact = slow_matches([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got <= exact and len(got) >= 0.95 * len(exact)
    assert len(truth & got) >= 0.95 * len(truth)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {i for i, _ in got}


def test_agreement_of_walks():
    """The agreement the number of repeats is computed from holds at the allowed distance."""
    rnd = np.random.default_rng(4)
    same = 0
    for _ in range(40):
        item = rnd.integers(0, 2**63, 40, dtype=np.uint64)
        other = item.copy()
        for at in rnd.choice(40, 8, replace=False):
            other[at] = rnd.integers(0, 2**63)
        keys = decontaminate.walk_keys(np.stack([item, other]), np.array([40, 40]))
        same += (keys[0] == keys[1]).any()
    assert same >= 0.95 * 40


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.lists(st.integers(0, 3), max_size=10))
def test_edits_with_free_ends(item, part):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    best = min(distance(item, part[a:b]) for a in range(len(part) + 1) for b in range(a, len(part) + 1))
    got, start, end = decontaminate.edits(np.array(item), np.array(part, np.int64))
    assert got == best == distance(item, part[start:end])


def test_no_items_and_no_documents(docs, empty, spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.contaminated(empty, spark.createDataFrame([(1, "a b c")], none.schema)).count() == 0


# --- sharding ---------------------------------------------------------------------------------------------------------


def test_sharding(docs, rows, empty):
    got = sharding.shards(docs, [1.0] * 5 + [3.0], [1.0] * 5 + [3.0, 1.0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 6) for r in got)
    sizes = {r[0]: (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None}
    assert all((r["size"], r["text_crc32"]) == sizes[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert len({r["shard"] for r in got if r["doc_id"] == 1009}) == 1
    assert sharding.shards(empty, [1.0], [1.0, 1.0]).count() == 0


def test_weights_are_kept(spark):
    got = sharding.shards(spark.range(20_000).selectExpr("id AS doc_id", "'' AS text"), [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0])
    counts = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
    assert abs(counts[1] - 10_000) < 400 and abs(counts[0] - 5_000) < 400
    assert abs(got.where("grown_shard = 3").count() - 4_000) < 300


# --- pages ------------------------------------------------------------------------------------------------------------


def page(*lines):
    return "<html><head><title>t</title></head><body>" + "".join(lines) + "</body></html>"


def test_markup_rules():
    html = page(
        "<nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>one<br>two&nbsp; <b>three</b><p>four<!-- no -->",
        "<div class='comments'><p>first!</p></div><form>f</form><script>var x='</p>'</script></article><footer>foot</footer>",
    )
    assert [t for t, _ in page_difference.lines(html)] == ["T & U", "one two three", "four"]
    assert page_difference.lines(None) == [] and page_difference.lines("") == []
    assert [t for t, _ in page_difference.lines("a < b <p>c")] == ["a < b", "c"]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<div class="entry-header"><h1>Title</h1></div><p>Text', ["Title", "Text"]),
        ('<h2 id="related-work">Related work</h2><p>Text', ["Related work", "Text"]),
        ('<p id="comments-on-method">On the method', ["On the method"]),
        ('<p class="hidden gems">a<p data-hidden="1">b<p class="hidden-info">c', ["a", "b", "c"]),
        ('<div class="social history">The history', ["The history"]),
        ('<p class="ad">Buy<p>Two<p>Three', ["Two", "Three"]),
        ('<ul><li class="promo">Ad<li>One</ul><p>Tail', ["One", "Tail"]),
        ("<nav><ul><li>Menu<li>More</ul><h1>Title</h1><p>Text", ["Title", "Text"]),
        ("<p title=it's>One<p title=\"a>b\">Two", ["One", "Two"]),
        ("<textarea><p>typed</textarea><pre>a  b\nc</pre>", ["a b c"]),
        ('<p hidden>a<p style="color:red; display : none">b<p aria-hidden="true">c<p>d', ["d"]),
        ('<div class="comment-list"><p>first!</div><div id="site-nav">x</div><div role="navigation">y</div><p>z', ["z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<dl><dt>t<dd>d<dt>u</dl><b>x<p>y</b>z", ["t", "d", "u", "x", "yz"]),
        ("<script>never closed <p>x", []),
        ("<p>a<!-- never closed <p>b", ["a"]),
        ("<p>a</div></p></nav><p>b</article>c", ["a", "b", "c"]),
        ("<article><header><h1>T</h1></header><p>x<article class=comment>c</article></article>", ["T", "x"]),
        ("1 < 2 <3 <a", ["1 < 2 <3"]),
    ],
)
def test_pages_as_browsers_read_them(html, expected):
    assert [t for t, _ in page_difference.lines(html)] == expected


def test_very_long_pages():
    """Two hundred thousand lines are aligned in memory that grows with the lines, and read in one pass."""
    own = [i % 50_000 for i in range(200_000)]
    other = [7, *(v for i, v in enumerate(own) if i % 1000), 9]
    assert len(page_difference.common(own, other)) == 199_800
    assert len(page_difference.lines("<p>line" * 200_000)) == 200_000


def brute_text(rows):
    """The query by plain lists: neighbours in order of path, alignment by the full table."""
    def place(url):
        host, _, rest = (url or "").partition("//")[2].partition("/")
        return host.lower(), re.sub(r"(?:/(?:index\.\w+)?|\.\w{2,5})$", "", ("/" + rest if rest else "").split("#")[0].split("?")[0])

    read = [page_difference.lines(html) for _, _, html in rows]
    paths = {}
    for i, (_, url, _) in enumerate(rows):
        if url:
            paths.setdefault(place(url)[0], {}).setdefault(place(url)[1], []).append(i)
    out = []
    for i, (page_id, url, _) in enumerate(rows):
        host, path = place(url)
        own, gone = [t for t, _ in read[i]], set()
        order = sorted(paths.get(host, {}))
        at = order.index(path) if url else 0
        near = [order[j] for j in (at - 1, at + 1) if url and 0 <= j < len(order)]
        if near:
            def alike(q):
                same = [x == y for x, y in zip(path.split("/"), q.split("/"), strict=False)] + [False]
                return same.index(False)

            other = [t for t, _ in read[paths[host][max(near, key=lambda q: (alike(q), -near.index(q)))][0]]]
            table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
            for a, x in enumerate(own, 1):
                for b, y in enumerate(other, 1):
                    table[a][b] = table[a - 1][b - 1] + 1 if x == y else max(table[a - 1][b], table[a][b - 1])
            if table[-1][-1] < 0.9 * max(len(own), len(other)):
                a, b = len(own), len(other)
                while a and b:
                    if own[a - 1] == other[b - 1]:
                        a, b = a - 1, b - 1
                        gone.add(a)
                    elif table[a - 1][b] >= table[a][b - 1]:
                        a -= 1
                    else:
                        b -= 1
        out.append((page_id, "\n\n".join(t for k, (t, marked) in enumerate(read[i]) if k not in gone or marked)))
    return out


def test_main_text_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for host in ("a.example", "b.example", "c.example"):
        template = [f"{host} part {k}" for k in range(6)]
        for i in range(8):
            body = [f"own {host} {i} {k}" for k in range(rnd.randint(1, 9))]
            kind = "article" if rnd.random() < 0.3 else "div"
            html = "".join(f"<p>{t}" for t in template[:3]) + f"<{kind}>" + "".join(f"<p>{t}" for t in body) + f"</{kind}>" + "".join(f"<p>{t}" for t in template[3:])
            rows.append((len(rows), f"http://{host}/{'news' if i % 2 else 'blog'}/{i}/{rnd.randint(0, 99)}.html", page(html)))
    got = [(r["page_id"], r["text"]) for r in page_difference.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    assert sorted(got) == brute_text(rows)
    assert any("part" not in t for i, t in got if "<article>" not in rows[i][2])


def test_pages_told_apart_by_their_query(spark):
    """A host with one path: pages differ in the query, and lines of the template go."""
    rows = [(i, f"http://q.example/show?id={i}", page("<p>Head of the site", "".join(f"<p>text {i} {k}" for k in range(i + 1)))) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in page_difference.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "\n\n".join(f"text {i} {k}" for k in range(i + 1)) for i in range(4)}


def test_extra_columns_do_not_clash_with_pages(spark):
    rows = [(1, "http://h/a", "<p>x", "t", "r", "h", "p", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, row string, host string, path string, query string")
    assert [tuple(r) for r in page_difference.main_text(df).collect()] == [(1, "http://h/a", "x")]


def test_template_lines_go_and_articles_stay(spark):
    top, bottom = "<div>Welcome to the site of many things</div>", "<div>All rights reserved by the owner</div>"
    rows = [(i, f"http://h.example/news/{i}.html?x=1", page(top, f"<div>{'story %d ' % i * 30}</div>", bottom), "x") for i in range(6)]
    rows.append((6, "http://h.example/news/3#top", rows[3][2], "x"))  # another address of one page
    passage = "<p>A passage that both articles quote in full length.</p>"
    rows += [(10 + i, f"http://other.example/a/{i}", page(f"<article>{passage}<p>own {i}</p></article>"), "x") for i in range(2)]
    rows += [(20, None, page("<p>alone</p>"), "x"), (21, "http://x.example/", None, "x"), (22, "not a url", "", "x"), (23, "http://x.example/q", "<p>" + "long " * 20000, "x")]
    rows += [rows[0]]
    got = spark.createDataFrame(rows, "page_id bigint, url string, html string, row string")
    texts = [(r["page_id"], r["text"]) for r in page_difference.main_text(got).collect()]
    assert len(texts) == len(rows)
    found = dict(texts)
    for i in (0, 1, 2, 3, 4, 5, 6):
        assert found[i] == " ".join((f"story {i if i < 6 else 3} " * 30).split())
    assert found[10] == "A passage that both articles quote in full length.\n\nown 0"
    assert (found[20], found[21], found[22]) == ("alone", "", "") and len(found[23]) == 99_999
    assert page_difference.main_text(got.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=9))
def test_common_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    got = page_difference.common(a, b)
    assert len(got) == table[-1][-1] and got == sorted(set(got))
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in got)
