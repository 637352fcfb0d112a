"""Embedding near-duplicates by a pivot-permutation index.

1. Pivots are unit vectors fitted on a bounded sample. A vector is described by its ``TOP`` nearest pivots in order, and
   by a code of one byte for each component with the length of the rounding error. Equal vectors are one node, named by
   128 bits of hash; nodes have numbers of their own.
2. The inverted lists hold numbers and codes, not vectors. Two nodes become candidates when their descriptions share
   ``SHARED`` pivots or more. Instead of counting along single lists, whose lengths grow with the table, a node is posted
   under every combination of ``SHARED`` of its pivots: nodes meet in a list exactly when they share that many. Within a
   list the codes bound the cosine from above, so only pairs that can't reach the threshold are dropped. Pairs are not
   written: a list yields a spanning forest. Lists beyond ``BLOCK`` nodes are cut into blocks, and each pair of blocks is a task.
3. The components of the forests are families. Only their members fetch their vectors, and each pair of a family is
   verified by the cosine in double precision, again in pairs of blocks, to link counts and a spanning forest.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of
different lengths don't link; equal vectors link with each other; a null id takes no part; rows that repeat an id count
as further vectors, and different vectors under one id are judged apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm import bloom
from tapeflow.llm.common import Scratch, local_components, sorted_groups
from tapeflow.llm.components import components
from tapeflow.llm.ngram_join import in_blocks

COSINE, TOP, SHARED, BLOCK = 0.95, 5, 2, 1000
#: Vectors that pivots are drawn from at most, and pivots at least and at most. Every row is indexed.
SAMPLE, FEWEST, MOST = 8192, 64, 4096


def n_pivots(n: int) -> int:
    return int(min(MOST, max(FEWEST, np.sqrt(n))))


def pivots(x: np.ndarray, m: int) -> np.ndarray:
    """``m`` unit vectors: differences of sampled vectors, so that dense regions don't get all pivots."""
    noise = np.random.default_rng(5).standard_normal((m, x.shape[1]))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    mixed = x[np.arange(m) % len(x)] - x[(np.arange(m) * 7 + 1) % len(x)] + 0.25 * noise
    return mixed / np.linalg.norm(mixed, axis=1, keepdims=True)


def describe(x: np.ndarray, pivot: np.ndarray, top: int = TOP) -> np.ndarray:
    """(vectors, top) of the numbers of the nearest pivots, nearest first; ties by number."""
    near = x @ pivot.T
    top = min(top, pivot.shape[0])
    part = np.argpartition(-near, top - 1, axis=1)[:, :top]
    order = np.lexsort((part, -np.take_along_axis(near, part, 1)), axis=1)
    return np.take_along_axis(part, order, 1)


def encode(x: np.ndarray) -> np.ndarray:
    """(vectors, length + 8) bytes of unit vectors: rounded components, their step, the length of the rounding error."""
    step = np.maximum(np.abs(x).max(axis=1, keepdims=True) / 127, 1e-30)
    code = np.rint(x / step).astype(np.int8)
    error = np.linalg.norm(x - code * step, axis=1, keepdims=True)
    tail = np.concatenate((step, np.nextafter(error.astype(np.float32), np.float32(2))), axis=1).astype(np.float32)
    return np.concatenate((code.view(np.uint8), tail.view(np.uint8)), axis=1)


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors within an error, and that error, of ``encode``'s bytes."""
    tail = np.ascontiguousarray(code[:, -8:]).view(np.float32)
    return code[:, :-8].view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector of ``dim`` components, and those at length 1."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)))
    x = np.asarray(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    rows, x = rows[good], x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _described(batches: Iterator[pa.RecordBatch], pivot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """vec_id, h1, h2, place (of the length among those known), near, code; the last three null for an unusable vector."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            n, column = batch.num_rows, batch.column("vector")
            place, near, code = np.full(n, -1), np.full(n, None, dtype=object), np.full(n, None, dtype=object)
            for k, (dim, p) in enumerate(sorted(pivot.items())):
                rows, x = units(column, dim)
                place[rows] = k
                near[rows] = [r.tobytes() for r in np.sort(describe(x, p), axis=1).astype(np.int16)]
                code[rows] = [r.tobytes() for r in encode(x)]
            usable = pa.array(place >= 0)
            place = pc.if_else(usable, pa.array(place, type=pa.int32()), pa.scalar(None, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("h1"), batch.column("h2"), place, pa.array(near, type=pa.binary()), pa.array(code, type=pa.binary())], names=["vec_id", "h1", "h2", "place", "near", "code"])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """(combinations, nodes): the lists of each node."""
    near = [np.frombuffer(x, dtype=np.int16) for x in batch.column("near").to_pylist()]
    out = np.zeros((len(list(combinations(range(TOP), SHARED))), len(near)), dtype=np.int64)
    if len(near):
        first = np.asarray(batch.column("place")).astype(np.int64) << 32
        for k, some in enumerate(combinations(range(TOP), SHARED)):
            key = np.zeros(len(near), dtype=np.int64)
            for j in some:
                key = key * MOST + np.array([x[j] for x in near], dtype=np.int64)
            out[k] = first + key
    return out


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(_keys(batch), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["key", "n"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key in _keys(batch):
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), batch.column("code")], names=["key", "id", "code"])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def _candidates(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted by (key, p, q): u, v, a spanning forest of the pairs of a task whose codes leave the cosine in reach."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["u", "v"])
        held.clear()
        return out

    for group in sorted_groups(batches, ["key", "p", "q"]):
        if group.num_rows < 2:
            continue
        ids, side = np.asarray(group.column("id")), np.asarray(group.column("side"))
        x, error = decode(_codes(group.column("code")))
        one = np.flatnonzero(side == 0)
        two = one if group.column("p")[0] == group.column("q")[0] else np.flatnonzero(side == 1)
        us, vs = [], []
        for a in range(0, len(one), 512):
            r = one[a : a + 512]
            least = cosine - 1e-4 - error[r][:, None] - error[two][None, :] * (1 + error[r][:, None])
            i, j = np.nonzero(x[r] @ x[two].T >= least)
            other = r[i] != two[j]
            us.append(r[i][other])
            vs.append(two[j][other])
        u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in (us, vs))
        if len(u):
            low = _lowest(ids, local_components(len(ids), u, v))
            moved = np.flatnonzero(low != ids)
            held.append((ids[moved], low[moved]))
            if len(held) > 2000:
                yield flush()
    if held:
        yield flush()


def _lowest(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each row the smallest id of its component."""
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return low[root]


def _verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted by (family, p, q): exact links of a task -> id, links (copies of the linked nodes), root."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)], names=["id", "links", "root"])
        held.clear()
        return out

    for group in sorted_groups(batches, ["family", "p", "q"]):
        ids, copies, side = (np.asarray(group.column(c)) for c in ("id", "copies", "side"))
        column = group.column("vector").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        rows, x = units(column, len(column[0]))  # all of one length, all usable
        one = np.flatnonzero(side == 0)
        same = group.column("p")[0] == group.column("q")[0]
        two = one if same else np.flatnonzero(side == 1)
        if not len(one) or not len(two):
            continue
        links, us, vs = np.zeros(len(ids), dtype=np.int64), [], []
        for a in range(0, len(one), 512):
            r = one[a : a + 512]
            linked = x[r] @ x[two].T >= cosine
            if same:
                linked[np.arange(len(r)), np.arange(a, a + len(r))] = False
            links[r] += linked @ copies[two]
            if not same:
                links[two] += linked.T @ copies[r]
            i, j = np.nonzero(linked)
            us.append(r[i])
            vs.append(two[j])
        low = _lowest(ids, local_components(len(ids), np.concatenate(us), np.concatenate(vs)))
        some = np.flatnonzero(links)
        held.append((ids[some], links[some], low[some]))
        if len(held) > 2000:
            yield flush()
    if held:
        yield flush()


def _fitted(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors that occurs; the number of lengths doesn't grow with the table."""
    out = {}
    for dim, n in sorted((r[0], r[1]) for r in rows.where(F.size("vector") > 0).groupBy(F.size("vector")).count().collect()):
        m = n_pivots(n)
        first = rows.where(F.size("vector") == dim).orderBy("h1", "h2").limit(min(SAMPLE, 2 * m)).select("vector").collect()
        _, x = units(pa.array([r[0] for r in first], type=pa.list_(pa.float64())), dim)
        if len(x):
            out[dim] = pivots(x, m)
        else:  # none of the sampled ones is usable; any directions do
            out[dim] = pivots(np.random.default_rng(6).standard_normal((2 * m, dim)), m)
    return out


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept (vec_id = component_id; true for a null id).

    n_links: other vectors with a cosine of ``cosine`` or more that the index finds. component_id: the smallest id
    reachable by links, the own one included.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    pivot = spark.sparkContext.broadcast(_fitted(rows))
    described = "vec_id long, h1 long, h2 long, place int, near binary, code binary"
    every = scratch.cut(rows.mapInArrow(lambda b: _described(b, pivot.value), described))
    good = every.where("place is not null and vec_id is not null")
    nodes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("place", "near", "code")))
    # Numbers are given once, as the table is written.
    nodes = scratch.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    lists = nodes.select("place", "near").mapInArrow(_key_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    large = scratch.cut(lists.where(F.col("n") > BLOCK))
    posted = nodes.select("node", "place", "near", "code").mapInArrow(_posted, "key long, id long, code binary")
    if large.limit(1).count():
        posted = posted.join(large, "key", "left")
        blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    else:
        blocks = F.lit(1)
    tasks = in_blocks(posted, blocks, ["key"]).select("key", "p", "q", "side", "id", "code")
    edges = scratch.cut(tasks.mapInArrow(lambda b: _candidates(b, cosine), "u long, v long"))
    family = components(scratch, edges)

    members = family.withColumnRenamed("id", "node").join(nodes.select("node", "h1", "h2", "copies"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = scratch.cut(members.join(sizes, "root").select(F.col("root").alias("family"), "node", "h1", "h2", "copies", "blocks"))
    scratch.drop(edges), scratch.drop(large)
    # Vectors outside families stay where they are; equal ones melt into one before the shuffle.
    words = bloom.size(members.count())
    bits = scratch.cut(bloom.build(members.select("h1"), "h1", words)).scalar()
    near = rows.where(bloom.may_contain(bits, words, F.col("h1"))).groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    near = near.join(members, ["h1", "h2"]).select("family", F.col("node").alias("id"), "copies", "blocks", "vector")
    settle = in_blocks(near, F.col("blocks"), ["family"]).select("family", "p", "q", "side", "id", "copies", "vector")
    links = scratch.cut(settle.mapInArrow(lambda b: _verified(b, cosine), "id long, links long, root long"))
    scratch.drop(members)

    roots = components(scratch, links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = links.groupBy("id").agg(F.sum("links").alias("links"))
    own = nodes.select(F.col("node").alias("id"), F.col("id").alias("vec_id"), "h1", "h2", "copies").join(links, "id", "left").join(roots, "id", "left")
    own = scratch.cut(own.select("h1", "h2", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    scratch.drop(nodes)
    first = own.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    found = scratch.cut(own.join(first, "root").select("h1", "h2", "copies", "links", "component_id"))
    linked = good.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    alone = every.where("place is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
