"""Small tables and brute-force versions for the corpus operators' tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, pack_id string, score string, ids string, n int, key int"


def vocabulary(seed: int, size: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdeflmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(size)]


def prose(rnd: random.Random, words: list[str], n: int) -> str:
    out = []
    for i in range(n):
        out.append(rnd.choice(words) + ("." if rnd.random() < 0.1 else ""))
        out.append("\n" if rnd.random() < 0.08 else " ")
    return "".join(out).strip()


def documents(seed: int = 3, count: int = 120) -> list[tuple]:
    """Texts with copies, near copies, shared passages, and every awkward row: null, empty, blank, short, long, repeated."""
    rnd, words = random.Random(seed), vocabulary(seed)
    passage = prose(rnd, words, 60)
    block = "\n".join(prose(rnd, words, 9).replace("\n", " ") for _ in range(8))
    texts: list[str | None] = [prose(rnd, words, rnd.randint(5, 160)) for _ in range(count)]
    for i in range(0, count, 6):
        base = texts[i].split(" ")
        texts[(i + 1) % count] = texts[i]
        near = list(base)
        near[rnd.randrange(len(near))] = "changed"
        texts[(i + 2) % count] = " ".join(near)
    for i in range(3, count, 7):
        texts[i] = f"{texts[i]} {passage} {prose(rnd, words, 20)}"
    for i in range(4, count, 9):
        texts[i] = f"{prose(rnd, words, 12)}\n{block}\n{prose(rnd, words, 12)}"
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "One\ttwo"), (1005, "é ß 漢字 😀 " * 30)]
    rows += [(1006, prose(rnd, words, 9000)), (1007, "x" * 5000), (1008, "same line\n" * 300), (None, texts[0]), (None, None)]
    rows += [(1009, texts[5]), (1009, texts[5])]
    return [(i, t, "en", "s", None if t is None else len(t), "p", "q", "r", 1, 2) for i, t in rows]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int = 5) -> set[tuple]:
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())
