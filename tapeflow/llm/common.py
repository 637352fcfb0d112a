"""Shared plumbing: tables, the shared scratch folder, fixed pseudo-random numbers, streaming over sorted groups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine (tests, notebooks).
LOCAL_SCRATCH = "/tmp/checkpoints/tapeflow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SCRATCH


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors, has a known size for the optimizer and is column-pruned on
    reading. Tables that a lazy result still reads are removed when the interpreter ends; others with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n, self.paths = spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}", 0, {}
        atexit.register(_delete, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        found = self.paths.pop(id(df), None)
        if found:
            _delete(self.spark, found[1])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words64(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers from a splitmix sequence: the same on every machine."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(col: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % parts == part, F.lit(False))


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what one task took would stay with the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text of a slice stays near ``most_bytes`` (one row may be longer)."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys over a partition that is sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    release()


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes under the edges (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root
