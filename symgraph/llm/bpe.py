"""Encoding a whole corpus with a public byte-level BPE tokenizer.

A text is cut into words by the tokenizer's pattern. A word that is a token is its
own encoding; any other goes through the backtracking encoder: an Aho-Corasick
automaton gives the longest token at each position, and a token is kept only if
its pair with the token before is compatible, that is, merging the bytes of the
two gives back just these two. Where it isn't, the next shorter token at that
position is tried, and where none is left the encoder steps back. Positions known
to lead nowhere are marked, so each is left at most once and time is linear in the
word's length; a sequence whose neighbours are all compatible is exactly what the
merges give. Each worker keeps the encodings of words it has met as packed bytes,
so a text's ids are one join of them.

Defined results: a null and an empty text give an empty list; a blank text is
encoded like any other; strings of special tokens are ordinary text. Repeated
rows come out repeated. Other columns of the input play no part.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from symgraph.session import spread

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Words whose encodings a worker keeps; beyond it the store starts anew (a cache only).
KEPT_WORDS = 1_000_000
#: Ids in one outgoing batch.
BATCH_IDS = 2_000_000


# The pattern of public byte-level BPE vocabularies. No alternative that begins with an
# apostrophe competes with one that begins with a letter or digit, so these come first; for
# texts in ASCII the standard library's matcher does, in a fraction of the time.
_WORDS = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII_WORDS = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def words(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """The vocabulary, its automaton and its table of compatible pairs; one per worker and file."""

    def __init__(self, path: str):
        import ahocorasick

        self.ranks = read_ranks(path)
        self.token = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        # reversed, a match's end is its start: one pass then gives the longest token that
        # begins at each position
        self.automaton = ahocorasick.Automaton()
        for t in self.ranks:
            self.automaton.add_word(t[::-1].decode("latin-1"), len(t))
        self.automaton.make_automaton()
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.packed: dict[str, bytes] = _Packed(self)

    def merge(self, data: bytes, below: int = sys.maxsize) -> list[bytes]:
        """Plain merging by ranks below a limit, least first: for single tokens, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, t: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes t; None for a single byte."""
        known = self.splits.get(t, 0)
        if known == 0:
            known = self.splits[t] = None if len(t) == 1 else tuple(self.merge(t, self.ranks[t]))
        return known

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of a and b gives a and b.

        Merges inside a and inside b happen in order of rank. Undone from the last to
        the first, they show every pair of pieces that ever met at the border, each with
        the merge that ended its time; a border merge of lower rank would have come
        before that. Of equal ranks the left one comes first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) > KEPT_WORDS:
            self.pairs.clear()
        rank, left, right = self.ranks, a, b
        end_left = end_right = sys.maxsize
        known = True
        while True:
            border = rank.get(left + right)
            if border is not None and border < end_left and border <= end_right:
                known = False
                break
            l, r = rank[left], rank[right]
            if len(left) > 1 and (l > r or len(right) == 1):
                end_left, left = l, self.split(left)[1]
            elif len(right) > 1:
                end_right, right = r, self.split(right)[0]
            else:
                break
        self.pairs[a, b] = known
        return known

    def shorter(self, t: bytes) -> bytes:
        """The longest token that is a proper prefix of t; empty if there is none."""
        t = t[:-1]
        while t and t not in self.ranks:
            t = t[:-1]
        return t

    def encode_word(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        n = len(data)
        longest = [0] * n
        for end, length in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if length > longest[at]:
                longest[at] = length
        dead = bytearray(n + 1)
        out: list[bytes] = []
        at = 0
        cand = data[: longest[0]]
        while at < n:
            while cand and (dead[at + len(cand)] or (out and not self.compatible(out[-1], cand))):
                cand = self.shorter(cand)
            if cand:
                out.append(cand)
                at += len(cand)
                cand = data[at : at + longest[at]] if at < n else b""
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(last)
                cand = self.shorter(last)
        return [self.ranks[t] for t in out]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, words(text))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """By the table of offsets into all tokens' bytes."""
        blob, offsets = self.offsets()
        return b"".join(blob[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", errors="replace")

    @cache  # noqa: B019 - encoders live as long as their worker
    def offsets(self) -> tuple[bytes, list[int]]:
        offsets = [0]
        for i in range(len(self.token)):
            offsets.append(offsets[-1] + len(self.token[i]))
        return b"".join(self.token[i] for i in range(len(self.token))), offsets


class _Packed(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        ids = self.encoder.encode_word(word.encode("utf-8", errors="replace"))
        got = self[word] = struct.pack(f"<{len(ids)}i", *ids)
        return got


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """key, ids array<int>: one row per row of df."""
    path = f"{folder}/{vocabulary}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            start, lengths, out = 0, [0], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = enc.encode(texts[i].as_py())
                out.append(ids)
                lengths.append(lengths[-1] + len(ids) // 4)
                if lengths[-1] > BATCH_IDS or i + 1 == batch.num_rows:
                    values = pa.Array.from_buffers(pa.int32(), lengths[-1], [None, pa.py_buffer(b"".join(out))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)], names=[key, "ids"])
                    start, lengths, out = i + 1, [0], []

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """key, n_tokens int, without moving the ids out of the workers."""
    path = f"{folder}/{vocabulary}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = pa.array([len(enc.encode(t.as_py())) // 4 for t in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[key, "n_tokens"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """key, text: the inverse of encode_texts (a null text comes back empty)."""
    path = f"{folder}/{vocabulary}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
