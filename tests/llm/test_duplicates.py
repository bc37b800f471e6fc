"""Passages, line chunks, similarity joins and fingerprints against brute force, on awkward rows too."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import prose, shingles, vocabulary, words
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import factor_dedup, line_chunks, minhash, set_join
from spanloom.llm import queries as q
from spanloom.llm.components import components
from spanloom.llm.textarrays import shingle_sets


def expected_passages(rows, window):
    first = {}
    for i, t in rows:
        own = words(t)
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        own, gone = words(t), set()
        for k in range(len(own) - window + 1):
            if i is not None and first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return out


def test_repeated_passages_match_brute_force(docs, rows):
    got = [tuple(r)[:4] for r in factor_dedup.repeated_passages(docs).collect()]
    expected = expected_passages([r[:2] for r in rows], factor_dedup.WINDOW)
    assert Counter(got) == Counter(expected)
    assert sum(r[2] for r in expected) > 500


def test_factors_cover_what_is_removed(docs):
    for r in factor_dedup.repeated_passages(docs).collect():
        covered = {k for first, n in r["factors"] for k in range(first, first + n)}
        assert len(covered) == r["n_removed"]


def test_factors_equal_the_words_they_copy(docs, rows):
    """Also over several packs and blocks, and for windows of other sizes."""
    texts: dict = {}
    for r in rows:
        texts.setdefault(r[0], []).append(words(r[1]))
    for window in (1, 2, 5, factor_dedup.WINDOW):
        got = factor_dedup.repeated_passages(docs.repartition(17), window).collect()
        expected = expected_passages([r[:2] for r in rows], window)
        assert Counter(tuple(r)[:4] for r in got) == Counter(expected)
        for r in got:
            assert len(r["factors"]) == len(r["sources"])
            for (first, n), (source, place) in zip(r["factors"], r["sources"], strict=True):
                assert n >= window and source < r["doc_id"]
                assert any(
                    own[first : first + n] == other[place : place + n] and len(own[first : first + n]) == n
                    for own in texts[r["doc_id"]]
                    for other in texts[source]
                )


def test_factors_follow_one_reference_as_far_as_it_goes(spark):
    rnd, vocab = random.Random(5), vocabulary(5)
    a, b = (prose(rnd, vocab, 120).split() for _ in range(2))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, "  ".join([*a[10:70], *b[20:90]])), (4, " ".join([*a[5:40], "new", *a[41:70]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["factors"], r["sources"]) for r in factor_dedup.repeated_passages(docs).collect()}
    assert got[1] == got[2] == ([], [])
    assert got[3] == ([[0, 60], [60, 70]], [[1, 10], [2, 20]])
    assert got[4] == ([[0, 35], [36, 29]], [[1, 5], [1, 41]])


def test_blocks_compare_words_where_hashes_clash(monkeypatch):
    raw = np.frombuffer(b"aa bb aa cc bb dd ee", np.uint8)
    starts = np.arange(0, 20, 3)
    monkeypatch.setattr(factor_dedup, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    numbers = factor_dedup._word_numbers(raw, starts, starts + 2)
    assert numbers[0] == numbers[2] and numbers[1] == numbers[4] and len(set(numbers.tolist())) == 5
    monkeypatch.setattr(factor_dedup, "window_hashes", lambda words, k: np.zeros(len(words) - k + 1, np.uint64))
    order, new = factor_dedup._window_groups(np.array([1, 2, 3, 1, 2, 4, 1, 2]), np.array([0, 1, 3, 4, 6]), 2)
    groups = [sorted(g.tolist()) for g in np.split(order, new[1:])]
    assert sorted(groups) == [[0, 2, 4], [1], [3]]


def brute_components(rows, num=80, den=100):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not (sets[a] and sets[b]):
                continue
            shared = len(sets[a] & sets[b])
            if den * shared >= num * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_similar_components_match_brute_force(docs, rows):
    got = Counter(tuple(r) for r in set_join.similar_components(docs).collect())
    expected = brute_components([r[:2] for r in rows])
    assert got == expected
    assert sum(n for (i, _, c), n in expected.items() if i != c) > 20


def test_boundary_sizes_and_chains(spark):
    """Sets at the threshold, around the light boundary, and chains whose ends are not similar."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in (4, 5, 6, 8, 9, 10, 12, 14, 18, 24, 25, 30, 45):
        for cut in range(6):
            rows.append((len(rows), " ".join([f"s{n}", *base[cut : n + cut]])))
    for i in range(30):
        rows.append((len(rows), " ".join(f"c{j}" for j in range(i, i + 40))))
    got = Counter(tuple(r) for r in set_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [2, 256])
def test_many_sets_that_share_a_passage(spark, monkeypatch, block):
    """One large list of sets that do not link, of sets that link with the text they come from only, and of chains."""
    monkeypatch.setattr(set_join, "BLOCK_SETS", block)
    rnd = np.random.default_rng(block)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        for at in rnd.choice(60, rnd.integers(1, 5), replace=False):
            own[at] = f"x{i}.{at}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join([*base[:20], *(f"y{i}.{k}" for k in range(40))])) for i in range(40)]
    rows += [(200 + i, " ".join([*base[:20], *(f"z{k}" for k in range(i, i + 60))])) for i in range(20)]
    got = Counter(tuple(r) for r in set_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_components(rows)


def test_links_between_blocks_are_those_that_join_components():
    def block(ids, components, sets):
        packed = [set_join.packed_set(np.array(sorted(x), np.uint64)) for x in sets]
        table = pa.table({"doc_id": ids, "component": components, "n": pa.array([len(x) for x in sets], pa.int32()), "members": packed})
        return set_join._Sets(set_join.encode(table))

    a = block([1, 2, 3], [1, 1, 3], [range(10), range(1, 11), range(50, 60)])
    b = block([4, 5, 6], [4, 5, 3], [range(10), range(1, 10), range(50, 60)])
    assert set_join.joining_links(a, b, (80, 100)) == [(1, 4), (1, 5)]
    assert set_join.joining_links(a, a, (80, 100)) == []


@pytest.mark.parametrize("n", range(1, 40))
def test_sizes_of_partners_and_overlaps(n):
    for m in range(1, 60):
        possible = [i for i in range(min(n, m) + 1) if 100 * i >= 80 * (n + m - i)]
        need = set_join.needed(n, m, (80, 100))
        assert possible == list(range(need, min(n, m) + 1))
        assert (m in set_join.partner_sizes(n, (80, 100))) == bool(possible)


def test_similar_light_sets_share_a_subset():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        universe = rnd.integers(0, 2**63, 16, dtype=np.uint64)
        a, b = (np.sort(rnd.choice(universe, rnd.integers(1, 13), replace=False)) for _ in range(2))
        shared = len(set(a.tolist()) & set(b.tolist()))
        similar = 100 * shared >= 80 * (len(a) + len(b) - shared)
        x, y = (set(set_join.subset_keys(v, 14, (80, 100)).tolist()) for v in (a, b))
        # Sets of one size can meet in a subset meant for a smaller partner, so candidates are verified.
        assert not similar or x & y


def test_minhash_components_find_near_copies(docs, rows):
    got = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    expected = {(i, c) for i, _, c in brute_components([r[:2] for r in rows])}
    assert got == expected


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(60, 460))
    s = minhash.signatures(pa.array([a, b, a, None, "", "A"]))
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert (s[0] == s[2]).all() and (s[3] == s[4]).all() and (s[4] != s[5]).any()


@pytest.mark.parametrize("sections", [1, 1 << 16])
def test_fingerprint_query(spark, rows, tmp_path, monkeypatch, sections):
    monkeypatch.setattr(q, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(q, "SECTION_SLICES", sections)
    table = [(i, t) for i, t, *_ in rows]
    spark.createDataFrame(table, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted((i, t or "") for i, t in table if i is not None)
    expected = [(i, t, order[(at + 1) % len(order)][1]) for at, (i, t) in enumerate(order)]
    expected += [(None, t or "", t or "") for i, t in table if i is None]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for _, t, n in expected]
    got = q.op5_minhash(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(
        (i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t, _), e in zip(expected, edited, strict=True)
    )
    found = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for (i, t, following), e in zip(expected, edited, strict=True):
        row = found[i, hashlib.sha256(e.encode()).hexdigest()]
        for other, name in ((e, "near_edited"), (following, "near_next")):
            both = shingles(t) | shingles(other)
            assert abs(row[name] - (len(shingles(t) & shingles(other)) / len(both) if both else 1)) < 0.2


def test_fingerprint_query_of_one_and_of_no_document(spark, tmp_path):
    for name, table in (("one", [(7, "some words stand here alone")]), ("none", [])):
        spark.createDataFrame(table, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = q.op5_minhash(spark, f"{tmp_path}/{name}").collect()
        assert [(r["doc_id"], r["near_next"]) for r in got] == [(i, 1.0) for i, _ in table]


def text_chunks(text):
    """Boundaries of one text as (first line, end line, bytes from line to line, line before, line after), by lists of lines."""
    lines = text.split("\n")
    inked = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
    parsed = line_chunks.Lines(pa.array([text]))
    assert len(parsed.hashes) == max(0, len(inked) - 1) and len(parsed.starts) == len(lines)
    out = []
    for k in np.flatnonzero(parsed.boundary).tolist():
        a, b = inked[k], inked[k + 1]
        before = (inked[k - 1], tuple(lines[inked[k - 1] : a])) if k else None
        after = (inked[k + 2] + 1, tuple(lines[b + 1 : inked[k + 2] + 1])) if k + 2 < len(inked) else None
        out.append((a, b + 1, tuple(lines[a : b + 1]), before, after))
    return out


def expected_lines(rows):
    """First place of every chunk stays; other copies go with the lines around them that are equal there."""
    first, found = {}, []
    for at, (i, t) in enumerate(rows):
        for number, chunk in enumerate(text_chunks(t or "")):
            found.append((at, i, number, chunk))
            place = (i, number, at, chunk)
            if chunk[2] not in first or place[:2] < first[chunk[2]][:2]:
                first[chunk[2]] = place
    gone = {}
    for at, i, number, (a, b, body, before, after) in found:
        _, first_number, home, (home_a, home_b, _, kept_before, kept_after) = first[body]
        if (at, number) == (home, first_number):
            continue
        a = before[0] if before and kept_before and before[1] == kept_before[1] else a
        b = after[0] if after and kept_after and after[1] == kept_after[1] else b
        gone.setdefault(at, set()).update(k for k in range(a, b) if not (at == home and home_a <= k < home_b))
    return [
        None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(at, ())) for at, (_, t) in enumerate(rows)
    ]


def test_line_chunks_match_brute_force(docs, rows):
    got = line_chunks.without_repeated_chunks(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed_lines"]
    unique = [r for r in rows if r[0] is not None and r[0] != 1009]
    expected = dict(zip([r[0] for r in unique], expected_lines([r[:2] for r in unique]), strict=True))
    collected = got.collect()
    texts = {r["doc_id"]: r["text"] for r in collected if r["doc_id"] in expected}
    assert texts == expected
    assert sum(r["n_removed_lines"] for r in collected) > 50
    # Of repeated rows one at most keeps a chunk.
    assert len([r for r in collected if r["doc_id"] == 1009]) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "", " "]), max_size=12), min_size=1, max_size=5))
def test_repeated_lines_match_brute_force_on_any_lines(texts):
    """All texts in one pack; lines of few kinds overlap themselves in every way."""
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    lines = line_chunks.Lines(pa.array([t for _, t in rows]))
    kept = {}
    for pair in np.flatnonzero(lines.boundary).tolist():
        kept.setdefault(
            int(lines.hashes.astype(np.int64)[pair]),
            {"number": pair, "chunk": lines.chunk(pair), "line_before": lines.before(pair), "line_after": lines.after(pair)},
        )
    gone = line_chunks.repeated_lines(lines, kept)
    left = ["\n".join(np.array(t.split("\n"), object)[~gone[a:b]]) for (_, t), a, b in zip(rows, lines.first, lines.first[1:], strict=False)]
    assert left == expected_lines(rows)


@pytest.mark.parametrize("length", [3, 4, 5, 8, 12, 40])
def test_repeated_runs_go_whole(spark, length):
    """Runs of three lines and more between foreign lines; one copy stays."""
    rnd = np.random.default_rng(length)

    def foreign(n):
        return ["".join(map(chr, rnd.integers(97, 123, 12))) for _ in range(n)]

    rows, runs = [], []
    for i in range(60):
        run = foreign(length)
        runs.append(run)
        for half in (0, 1):
            lines = [*foreign(20), *run, *foreign(20)]
            rows.append((2 * i + half, "\n".join(lines)))
    got = {r["doc_id"]: r for r in line_chunks.without_repeated_chunks(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    whole = sum(got[2 * i + 1]["n_removed_lines"] == length for i in range(60))
    assert all(got[2 * i]["n_removed_lines"] == 0 for i in range(60))
    assert whole >= 57
    assert all(not set(runs[i]) & set(got[2 * i + 1]["text"].split("\n")) for i in range(60) if got[2 * i + 1]["n_removed_lines"] == length)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), min_size=4, max_size=40), st.lists(st.text("xy", min_size=1, max_size=3), max_size=4))
def test_chunk_boundaries_resist_shifts(lines, inserted):
    """Lines put in front move no boundary but that of the first line."""
    before = {c[0] for c in text_chunks("\n".join(lines))}
    after = {c[0] - len(inserted) for c in text_chunks("\n".join([*inserted, *lines]))}
    assert {b for b in before if b > 0} <= after


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 300: 200}


def test_empty_tables(empty):
    assert factor_dedup.repeated_passages(empty).count() == 0
    assert line_chunks.without_repeated_chunks(empty).count() == 0
    assert set_join.similar_components(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.fingerprints(empty).count() == 0


def test_shingle_sets_have_the_sizes_of_brute_force(rows):
    texts = [r[1] for r in rows]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]
