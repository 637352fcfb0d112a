"""Byte-level BPE encoding and decoding with a rank file.

Two tiers settle a pre-token. A minimal perfect hash over the vocabulary answers whole pre-tokens that are tokens
themselves: one hash, one displacement, one comparison. The others merge: a heap holds the ranks of neighbouring pairs
over a linked list of byte ranges, the lowest rank (leftmost on ties) merges first, stale entries are skipped.

Texts are cut at blanks that follow a non-space character. No pre-token of the pattern crosses such a place, so the
pieces between them encode independently, and what a piece encodes to is remembered: pieces of at most ``LONGEST``
characters, in two generations of ``REMEMBERED`` each, so memory has a bound whatever the texts.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from tapeflow.llm.common import slices

REMEMBERED, LONGEST = 350_000, 64
#: A blank after white space: such texts are split by the pattern as a whole.
_DOUBTFUL = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots; a bucket's displacement sends its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n)
        self.displacement, self.slots = [0] * self.buckets, [b""] * n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, k))
        free = bytearray(b"\x01") * n
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                singles.append((bucket, members[0][1]))
                continue
            d = 1
            while True:
                places = {self._place(h, d) for h, _ in members}
                if len(places) == len(members) and all(free[p] for p in places):
                    break
                d += 1
            self.displacement[bucket] = d
            for h, k in members:
                self.slots[self._place(h, d)] = k
                free[self._place(h, d)] = 0
        rest = (i for i in range(n) if free[i])
        for bucket, k in singles:  # a lone key's slot is written down itself
            p = next(rest)
            self.displacement[bucket] = -1 - p
            self.slots[p] = k

    def _place(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 % 0x1FFFFFFFFFFFFFFF % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        p = -1 - d if d < 0 else self._place(h, d)
        return p if self.slots[p] == key else -1


class Memo(dict):
    """make(key) remembered: a full generation becomes the old one, and what is asked for again moves to the new one."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """encode: text -> ids; decode: ids -> bytes. A null text counts as empty."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.hash.slots]
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.pattern = regex.compile(pattern)
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        #: Ranks of two neighbours' joined bytes, by both ids: every way to cut a token into two tokens.
        self.pair = {ranks[k[:i]] << 20 | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.after_blank = Memo(self._after_blank)

    def _after_blank(self, word: str) -> tuple[int, ...]:
        """Ids of a blank and a word without blanks."""
        if word and word.isalpha() and max(word) < "\u0250":  # one pre-token; plain letters in any Unicode version
            return tuple(self._piece((" " + word).encode()))
        stem = word[:-1]
        if word[-1:] in (",", ".") and stem and stem.isalpha() and max(stem) < "\u0250":
            return (*self.after_blank[stem], *self._piece(word[-1:].encode()))
        return tuple(self._whole(" " + word))

    def _piece(self, piece: bytes) -> list[int]:
        p = self.hash.slot(piece)
        return [self.slot_ids[p]] if p >= 0 else self.merge(piece)

    def _whole(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            stem = piece[1:]
            if piece[0] == " " and len(piece) < len(text) and stem.isalpha() and max(stem) < "\u0250":
                out += self.after_blank[stem]  # remembered for words that go on differently
            else:
                out += self._piece(piece.encode())
        return out

    def merge(self, piece: bytes) -> list[int]:
        n, pair = len(piece), self.pair.get
        token = list(map(self.of_byte.__getitem__, piece))  # -1: the place was taken by a merge to its left
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits, two = n.bit_length(), self.two
        places = (1 << bits) - 1
        #: The rank that the pair from a place has now, -1 for none: an entry of the heap with another one is stale.
        joined = [two[a << 8 | b] for a, b in zip(piece, piece[1:])] + [-1]
        heap = [r << bits | i for i, r in enumerate(joined) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, r = entry & places, entry >> bits
            if joined[i] != r:
                continue
            mid = after[i]
            token[i], token[mid], joined[mid] = r, -1, -1
            after[i] = end = after[mid]
            s = -1
            if end < n:
                before[end] = i
                s = pair(r << 20 | token[end], -1)
                if s >= 0:
                    heappush(heap, s << bits | i)
            joined[i] = s
            left = before[i]
            if left >= 0:
                joined[left] = s = pair(token[left] << 20 | r, -1)
                if s >= 0:
                    heappush(heap, s << bits | left)
        return [t for t in token if t >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _DOUBTFUL.search(text):
            return self._whole(text)
        words = text.split(" ")
        return [*self._whole(words[0]), *chain.from_iterable(map(self.after_blank.__getitem__, words[1:]))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each rank file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(read_ranks(path))
    return _CODECS[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the column ``ids``, array<int>; a null or empty text gives an empty array. Other columns stay."""
    schema = f"{docs.drop(ids).select('*').schema.simpleString()[7:-1]},{ids}:array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, text):
            found = pa.array([c.encode(x) for x in batch.column(text).to_pylist()], type=pa.list_(pa.int32()))
            yield batch.append_column(ids, found)

    return docs.drop(ids).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Adds the column ``data``, binary: the bytes of the ids; null ids give empty bytes. Other columns stay."""
    schema = f"{coded.drop(data).schema.simpleString()[7:-1]},{data}:binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield batch.append_column(data, pa.array([c.decode(x or []) for x in batch.column(ids).to_pylist()], type=pa.binary()))

    return coded.drop(data).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal = [str(i) for i in range(max(c.bytes_of) + 1)]
        gc.disable()  # strings and tuples make no cycles; passes over the remembered ones cost time
        try:
            for batch in slices(batches, "text"):
                n, a, b = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = c.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(n, dtype=np.int64)), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # the worker serves other tasks too
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
