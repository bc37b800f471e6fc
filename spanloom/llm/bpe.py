"""Byte-level BPE encoding by dynamic programming over prefixes, with decoding.

For every prefix of a piece exactly one token can end its encoding. The tokens that end at a position come from an automaton
with suffix links over the vocabulary; a token fits if it is compatible with the last token of the prefix before it, which
the merge ranks decide without running the merges. The ids follow from the back-pointers. Pieces (pre-tokens) recur, so
each worker keeps a bounded table of encoded text between spaces.

A null text counts as empty and has no ids. Special tokens of the file in a text become their ids. Rows keep their order
and their other columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.tables import small_batches

# Entries of a worker's newer table; when it is full it becomes the older one, which is then dropped.
KEPT_PIECES = 200_000

# The byte-level format's split pattern, with its white space spelled out.
_WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WHITE + r"\p{L}\p{N}]+"
    r"|[" + _WHITE + r"]+(?![^" + _WHITE + r"])|[" + _WHITE + r"]+"
)


def _byte_letters() -> dict[str, int]:
    """The format's letter for every byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = _byte_letters()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            self.made.setdefault(whole, (rank, left, right))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.made or len(token) == 1:
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge over their border comes before the merges that made them."""
        a, b = left, right
        until_a = until_b = float("inf")  # ranks at which the current parts at the border join their outer neighbours
        while True:
            over = self.rank.get((a, b))
            # Of equal ranks the leftmost merge comes first: before the right part's own, after the left part's.
            if over is not None and over < until_a and over <= until_b:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                until_a, a = made_a[0], made_a[2]
            else:
                until_b, b = made_b[0], made_b[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the unique last token of each prefix, then the way back."""
        n = len(piece)
        last, width = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        if len(fits) > 4 * KEPT_PIECES:
            fits.clear()
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                pair = (last[before], token)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(*pair)
                if not fit:
                    continue
            last[end], width[end] = token, size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def _stretch(self, text: str) -> tuple[bytes, bytes]:
        """Ids (as int32 bytes) and decoded bytes of a stretch of text that meets its neighbours only at safe places."""
        ids = [i for piece in self.pieces.findall(text) for i in self.encode_piece(piece.encode())]
        return array("i", ids).tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _plain(self, text: str, out: list[bytes], back: list[bytes]) -> None:
        # A single space between two other characters always starts a new pre-token, so what lies between is independent.
        if len(self.known) > KEPT_PIECES:
            self.known, self.older = {}, self.known
        known = self.known
        first = True
        for stretch in _SAFE.split(text) if _UNSAFE.search(text) else text.split(" "):
            key = stretch if first else " " + stretch
            first = False
            done = known.get(key)
            if done is None:
                done = self.older.get(key) or self._stretch(key)
                if len(key) <= 256:
                    known[key] = done
            out.append(done[0])
            back.append(done[1])

    def encode_bytes(self, text: str) -> tuple[bytes, str]:
        """Ids as int32 bytes, and the text they decode to."""
        out: list[bytes] = []
        back: list[bytes] = []
        at = 0
        for match in self.splitter.finditer(text) if self.splitter else ():
            if match.start() > at:
                self._plain(text[at : match.start()], out, back)
            i = self.special[match[0]]
            out.append(np.int32(i).tobytes())
            back.append(self.bytes_of[i])
            at = match.end()
        if at < len(text):
            self._plain(text[at:], out, back)
        return b"".join(out), b"".join(back).decode("utf-8", errors="replace")

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


_UNSAFE = re.compile(r"^ |  | $|\s | \s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_models: dict[str, Bpe] = {}


def _model(spec: str) -> Bpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _models:
        _models[key] = Bpe(spec)
    return _models[key]


def encoded(docs: DataFrame, vocabulary: str | Path, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Adds the ids (array of int) and, if named, the text decoded from them. ``vocabulary``: path of a byte-level BPE file.

    New columns take the place of columns of the same name.
    """
    spec = Path(vocabulary).read_text(encoding="utf-8")
    small_batches(docs.sparkSession)
    new = [ids] + ([decoded] if decoded else [])
    kept = docs.drop(*[c for c in new if c != text])
    schema = T.StructType([f for f in kept.schema.fields if f.name != decoded])
    schema = schema.add(ids, T.ArrayType(T.IntegerType(), False))
    schema = schema.add(decoded, T.StringType()) if decoded else schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(spec)
        for batch in batches:
            made = [model.encode_bytes(t or "") for t in batch[text].to_pylist()]
            starts = np.cumsum([0, *(len(m[0]) // 4 for m in made)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(m[0] for m in made), np.int32))
            names = [n for n in batch.schema.names if n != decoded]
            columns = [batch[n] for n in names] + [pa.ListArray.from_arrays(pa.array(starts), values)]
            if decoded:
                columns.append(pa.array([m[1] for m in made], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return kept.mapInArrow(encode, schema)


def with_decoded_text(docs: DataFrame, vocabulary: str | Path, text: str = "text") -> DataFrame:
    """The rows with each text encoded and decoded again, which makes it valid for the tokenizer, and its number of tokens."""
    rows = encoded(docs, vocabulary, text=text, ids="ids", decoded="_decoded")
    back = F.when(F.col(text).isNotNull(), F.col("_decoded"))
    return rows.select(*[back.alias(c) if c == text else F.col(c) for c in docs.columns if c != "ids"], "ids")
