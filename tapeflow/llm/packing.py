"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

Whether pieces fit together depends on their lengths only, and there are at most ``capacity`` lengths. So the driver
plans on counts by length: pieces above a third of the capacity pair by greedy matching (the longest with the longest
that fits beside it; three never fit), smaller ones go, longest first, into the smallest gap that holds them, and open
new sequences where no gap does. Sequences of equal content form one run, so the plan has a few rows for each length,
whatever the number of pieces. Every piece then finds its place from its length and its rank among pieces of that
length; ranks are counted in salted groups, so that no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.llm.common import Scratch, slices

CAPACITY, END = 2048, 0
#: Rows of one rank group, about.
GROUP = 100_000

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level BPE of a ``tokenizers`` file: its vocabulary as ranks; without special tokens the ids are the same."""
    if path not in _ENCODINGS:
        import json

        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        _ENCODINGS[path] = tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32: each text's ids and ``end``, cut where too long.

    A text of more than ``capacity`` ids gives pieces of ``capacity``, of which the first may be shorter. A null or
    empty text has the one id ``end``. The crc is that of the ids as unsigned 32-bit little-endian numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(coder.encode_to_numpy(text or "", disallowed_special=()), np.uint32(end)).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                at, k = 0, 0
                while at < n:
                    size = n % capacity if k == 0 and n % capacity else min(capacity, n - at)
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset): from the first rank on, pieces of a length
    fill sequence after sequence. Lengths are 1 to ``capacity``; sequences are numbered from 0 without gaps."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"length {size} is outside 1 to {capacity}")
        left[size] += n
    rank = [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(size: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((size, rank[size], first, per, offset))
        rank[size] += n
        left[size] -= n

    for size in range(capacity, capacity // 3, -1):
        mate = min(size, capacity - size)
        while left[size]:
            while mate > capacity // 3 and not left[mate]:
                mate -= 1
            if mate <= capacity // 3 or (mate == size and left[size] == 1):
                smaller = mate == size and next((m for m in range(mate - 1, capacity // 3, -1) if left[m]), 0)
                if not smaller:
                    n = left[size]
                    put(size, n, bins, 1, 0)
                    gaps[capacity - size].append((bins, n))
                    bins += n
                    continue
                mate = smaller
            n = left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, n, bins, 1, 0)
            put(mate, n, bins, 1, size)
            gaps[capacity - size - mate].append((bins, n))
            bins += n
    for size in range(capacity // 3, 0, -1):
        gap = size
        while left[size] and gap <= capacity:
            runs, gaps[gap] = gaps[gap], []
            per = gap // size
            for first, n in runs:
                full = min(n, left[size] // per)
                if full:
                    put(size, full * per, first, per, capacity - gap)
                    gaps[gap - per * size].append((first, full))
                    first, n = first + full, n - full
                if n and left[size]:
                    some = left[size]
                    put(size, some, first, some, capacity - gap)
                    gaps[gap - some * size].append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    gaps[gap].append((first, n))
            gap += 1
        if left[size]:
            per, full = capacity // size, left[size] // (capacity // size)
            if full:
                put(size, full * per, bins, per, 0)
                gaps[capacity - per * size].append((bins, full))
                bins += full
            if some := left[size]:
                put(size, some, bins, some, 0)
                gaps[capacity - some * size].append((bins, 1))
                bins += 1
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(items: DataFrame, scratch: Scratch, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table with a ``length``; ``order`` names the columns that tell rows apart.

    Only the counts by length reach the driver, ``capacity`` numbers at most.
    """
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    groups = max(16, sum(counts.values()) // GROUP)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.cut(sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_own", own).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own") - 1)
    table = items.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    columns = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            at = np.empty(len(length), dtype=np.int64)
            for size in np.unique(length):
                mine = length == size
                a, b = np.searchsorted(rows[:, 0], [size, size + 1])
                at[mine] = a + np.searchsorted(rows[a:b, 1], rank[mine], side="right") - 1
            place, step = rank - rows[at, 1], rows[at, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(rows[at, 2] + place // step), pa.array(rows[at, 4] + place % step * length)], names=[*columns, "sequence_id", "offset"])

    schema = f"{items.schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint"
    return ranked.select(*columns, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Sequences hold at most ``capacity`` ids; offsets are gapless from 0. Texts are tokenized once: the narrow table of
    pieces is written to the shared folder. Rows with null or repeated ids are documents of their own; pieces are
    numbered as they are written, so that equal rows spread over the rank groups like any others.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    found = pieces(docs, path, capacity, end)
    cut = scratch.cut(found.withColumn("_nth", F.monotonically_increasing_id()))
    return pack(cut, scratch, ["_nth"], capacity).drop("_nth")
