"""Encoding of texts with a public byte-level BPE vocabulary, exact and without merging step by step.

For every prefix of a pretoken there is exactly one last token that byte-pair merging would
leave there. It is found by dynamic programming: an automaton over the vocabulary reports all
tokens that are suffixes of the prefix, longest first, and the first one that is *compatible*
with the last token of the prefix before it is stored. Following the stored tokens back from
the end gives the ids. Two tokens are compatible if undoing their merges never meets a pair
across the border that would have been merged earlier than the tokens themselves.

Spark splits the corpus; each task turns whole texts into ids, in Arrow batches. Pieces between
single spaces are independent of their surroundings, so a worker keeps the ids of pieces it
has met.

Null and empty texts have no ids (an empty list). Special-token strings are plain text. Texts
may be of any length; repeated documents are encoded like any other.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.session import table

#: The folder of the vocabulary files; a parameter of every function that encodes.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: How the published vocabulary splits text before merging (fixed value).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its pieces when it holds this many; results do not depend on it.
REMEMBERED = 400_000


def _byte_of() -> dict[str, int]:
    """The byte behind each printable stand-in character of a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixEncoder:
    """Ids of a text by last tokens of prefixes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = _byte_of()
        text_of = {t: bytes(stand_in[c] for c in t).decode("latin-1") for t in model["vocab"] if all(c in stand_in for c in t)}
        self.width = {i: len(text_of[t]) for t, i in model["vocab"].items() if t in text_of}
        automaton = ahocorasick.Automaton()
        merged = set()
        self.merge: dict[tuple[int, int], int] = {}
        size = max(self.width) + 1
        self.left, self.right = list(range(size)), list(range(size))
        vocab = model["vocab"]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            whole = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = whole
            if whole not in merged:
                merged.add(whole)
                self.left[whole], self.right[whole] = vocab[a], vocab[b]
        for t, i in vocab.items():
            if t in text_of and (i in merged or len(text_of[t]) == 1):
                automaton.add_word(text_of[t], i)
        automaton.make_automaton()
        self.automaton = automaton
        self.pretokens = regex.compile(PRETOKENS).findall
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps ``a`` and ``b`` apart where they meet."""
        key = (a, b)
        if (kept := self.known.get(key)) is None:
            if len(self.known) > 4 * REMEMBERED:
                self.known.clear()
            kept = self.known[key] = self._compatible(a, b)
        return kept

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two merges step by step; a pair across the border that merges
        # before the step just undone would have swallowed the border.
        before = len(self.left)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < before:
                return False
            a_parts, b_parts = self.left[a] != a, self.left[b] != b
            if a > b and a_parts or a_parts and not b_parts:
                before, a = a, self.right[a]
            elif b_parts:
                before, b = b + 1, self.left[b]
            else:
                return True

    def encode_pretoken(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace").decode("latin-1")
        last: list[int] = [-1] * len(data)
        done = -1
        for end, token in self.automaton.iter(data):
            if end == done:
                continue
            start = end + 1 - self.width[token]
            if start == 0 or (last[start - 1] >= 0 and self.compatible(last[start - 1], token)):
                last[end] = token
                done = end
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.width[last[at]]
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            ids = self.pieces[piece] = np.array([i for p in self.pretokens(piece) for i in self.encode_pretoken(p)], dtype=np.int32).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian int32."""
        words = text.split(" ")
        for w in words:
            # A run of white space belongs to the words around it: such texts are cut by the pattern alone.
            if not w or w[0].isspace() or w[-1].isspace():
                return b"".join([self._piece(p) if len(p) < 64 else np.array(self.encode_pretoken(p), dtype=np.int32).tobytes() for p in self.pretokens(text)])
        get = self.pieces.get
        first = self._piece(words[0])
        return first + b"".join([get(p) or self._piece(p) for p in [" " + w for w in words[1:]]])


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _path(tokenizers: str, vocabulary: str) -> str:
    return os.path.join(tokenizers, vocabulary)


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""
    path = _path(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            parts = [enc.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, dtype=np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens int) for every row of ``docs``, by the same encoder."""
    path = _path(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(enc.encode(t)) // 4 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int32())], names=["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_ids(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
