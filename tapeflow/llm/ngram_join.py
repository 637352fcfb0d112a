"""Similarity self-join of texts on word n-grams by chosen paths, with exact links.

1. Every text becomes its set of word-shingle hashes. Equal sets are one node, whatever their ids; nodes have numbers of
   their own, so different texts under one id are different nodes.
2. A chosen-path join over the classes finds families. A set is embedded as T min-hash coordinates. At a node of the
   path tree every coordinate is chosen with probability 1 / (threshold * T), by a hash of the run and the path, and
   the node's sets fall into one child bucket for each value of each chosen coordinate. So two sets of similarity s
   share s / threshold children on average: at the threshold or above they keep a common path with a chance that falls
   only slowly with depth, below it they part at a geometric rate. Buckets of at most ``LEAF`` sets are searched by
   brute force over sketches; larger ones branch again, to ``DEPTH`` levels, and what is large still is cut into blocks
   of which each pair is searched. Only runs whose root chooses a coordinate count, and they repeat until a pair at the
   threshold is found with ``RECALL``. Sketches hold the low byte of each coordinate: below the root different values
   share a child with a chance of 1/256, which adds candidates and loses none. Pairs are never written: a bucket yields
   a spanning forest.
3. The families, connected components of those forests, get their texts back, and each pair of a family is settled
   on the true sets: intersections are products of 0/1 matrices. Families beyond a block's size split into blocks, and
   each pair of blocks is a task of bounded memory. A task yields link counts and a spanning forest per text.

Defined results: null ids take no part (class null, no links, kept); null, empty and white-space texts have no shingles
and link with nothing; a set's copies link with each other, also under one id; rows that repeat an id with other texts
are judged text by text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm import bloom
from tapeflow.llm.common import Scratch, fresh, local_components, mix64, slices, sorted_groups
from tapeflow.llm.components import components
from tapeflow.llm.shingles import minhash, set_id, shingles

K, THRESHOLD = 5, Fraction(4, 5)
T, LEAF, DEPTH, RECALL = 64, 256, 3, 0.995
#: Texts and shingles of a block of a large family.
BLOCK, BLOCK_SHINGLES = 800, 400_000
COLUMNS = 2048


def survival(depth: int, threshold: float = float(THRESHOLD)) -> float:
    """Chance that a pair at the threshold shares a path of this length in a run whose root chooses a coordinate.

    Of T coordinates each is chosen with 1 / (threshold * T) and equal with ``threshold``, so 1 / T gives a shared child.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p / T) ** T
    return p / (1 - (1 - 1 / (threshold * T)) ** T)


def runs(recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def least_matches(threshold: Fraction = THRESHOLD, miss: float = 1e-3) -> int:
    """Fewest equal coordinates of T that a pair at the threshold falls below with at most the chance ``miss``."""
    s, total, k = float(threshold), 0.0, 0
    while True:
        total += math.comb(T, k) * s**k * (1 - s) ** (T - k)
        if total > miss:
            return k
        k += 1


def _set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([set_id(s) for s in sets], dtype=np.int64).reshape(-1, 2)


def _named(batches: Iterator[pa.RecordBatch], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Appends the two halves of the set's name to whole rows."""
    for batch in slices(batches, "text"):
        ids = _set_ids(shingles(batch.column("text"), k))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=[*batch.schema.names, *names])


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingles(batch.column("text"), k)
        ids = _set_ids(sets)
        sig = minhash(sets, T)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), pa.array([x.tobytes() for x in sig], type=pa.binary())],
            names=["doc_id", "h1", "h2", "n_set", "sig"],
        )


def _chosen(path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) for every coordinate that a row's path chooses."""
    salt = np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.nonzero(mix64(path[:, None] ^ salt) < np.uint64(int(2**64 / (threshold * T))))


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix64(path ^ mix64((coordinate.astype(np.uint64) << np.uint64(32)) ^ value.astype(np.uint64) ^ np.uint64(0x27D4EB2F165667C5)))


def _branches(key: np.ndarray, ids: np.ndarray, sketch: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), sketch], names=["key", "id", "sketch"])


def _roots(batches: Iterator[pa.RecordBatch], n_runs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The first level: all classes are in the root of every run. Sketches hold a byte of each coordinate."""
    roots = mix64(np.arange(1, 16 * n_runs + 1, dtype=np.uint64))
    row, pick = _chosen(roots, threshold)
    used = np.unique(row)[:n_runs]
    roots, picks = roots[used], [pick[row == r] for r in used]
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, T)
        ids = np.asarray(batch.column("id"))
        sketch = pa.array([x.tobytes() for x in sig.astype(np.uint8)], type=pa.binary())
        for r in range(n_runs):
            for c in picks[r].tolist():
                key = _child(np.broadcast_to(roots[r], len(ids)), np.full(len(ids), c), sig[:, c])
                yield _branches(key, ids, sketch)


def _sketches(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(table.num_rows, T)


def _deeper(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            path, sketch = np.asarray(part.column("key")).view(np.uint64), _sketches(part)
            row, c = _chosen(path, threshold)
            yield _branches(_child(path[row], c, sketch[row, c]), np.asarray(part.column("id"))[row], part.column("sketch").take(pa.array(row)))


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for the ids that an edge moves."""
    root = local_components(len(ids), i, j)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    top = low[root]
    moved = np.flatnonzero(top != ids)
    return ids[moved], top[moved]


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])


def _leaves(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted by key, buckets of at most LEAF: compares each row with the rows of its bucket 1, 2, ... places on, many buckets at once."""
    held: pa.Table | None = None

    def search(part: pa.Table) -> pa.RecordBatch:
        key, ids, sketch = np.asarray(part.column("key")), np.asarray(part.column("id")), _sketches(part)
        us, vs, lag = [], [], 1
        rows = np.arange(len(key))
        while True:
            rows = rows[rows + lag < len(key)]
            rows = rows[key[rows] == key[rows + lag]]
            if not len(rows):
                break
            for a in range(0, len(rows), 16384):
                r = rows[a : a + 16384]
                r = r[(sketch[r] == sketch[r + lag]).sum(axis=1) >= least]
                us.append(r)
                vs.append(r + lag)
            lag += 1
        if not us:
            return _edges(ids[:0], ids[:0])
        return _edges(*_forest_by_id(ids, np.concatenate(us), np.concatenate(vs)))

    for batch in batches:
        part = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        key = np.asarray(part.column("key"))
        if not len(key):
            continue
        cut = int(np.searchsorted(key == key[-1], True)) if (key == key[-1]).all() else int(np.flatnonzero(key != key[-1])[-1]) + 1
        if cut:
            for at in _cuts(key[:cut], 32768):
                yield search(part.slice(at[0], at[1] - at[0]))
        held = part.slice(cut)
    if held is not None and held.num_rows:
        yield search(held)


def _cuts(key: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of about ``size`` rows that end where a key ends."""
    ends = np.concatenate((np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    out, a = [], 0
    while a < len(key):
        b = int(ends[np.searchsorted(ends, min(a + size, len(key)))])
        out.append((a, b))
        a = b
    return out


def _forest_by_id(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_forest``, where an id may stand in several rows."""
    names, place = np.unique(ids, return_inverse=True)
    return _forest(names, place[i], place[j])


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted by (key, p, q): rows of two blocks of a bucket that stayed large, or of one; ``side`` is 0 for block p."""
    for group in sorted_groups(batches, ["key", "p", "q"]):
        ids, sketch, side = np.asarray(group.column("id")), _sketches(group), np.asarray(group.column("side"))
        one = np.flatnonzero(side == 0)
        two = one if group.column("p")[0] == group.column("q")[0] else np.flatnonzero(side == 1)
        us, vs = [], []
        for a in range(0, len(one), 64):
            r = one[a : a + 64]
            i, j = np.nonzero((sketch[r][:, None, :] == sketch[two][None, :, :]).sum(axis=2) >= least)
            keep = r[i] != two[j]
            us.append(r[i][keep])
            vs.append(two[j][keep])
        if us:
            yield _edges(*_forest_by_id(ids, np.concatenate(us), np.concatenate(vs)))


def in_blocks(rows: DataFrame, n_blocks, keys: list[str]) -> DataFrame:
    """Each row once for each block that its own meets: adds p <= q, the blocks of a task, and side (0: own block is p).

    n_blocks: a column. The block is a hash of ``id``. Of n rows in b blocks n * b come out.
    """
    b = n_blocks.cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("block")), b).cast("int")
    with_own = rows.withColumn("_b", b).withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    out = with_own.withColumns({"p": F.least("_own", "_o"), "q": F.greatest("_own", "_o"), "side": F.when(F.col("_own") <= F.col("_o"), 0).otherwise(1)})
    return out.drop("_b", "_own", "_o").repartition(*keys, "p", "q").sortWithinPartitions(*keys, "p", "q")


def _intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """|a & b| for each pair, by products of 0/1 matrices over the shingles that both sides have."""
    a, b = np.concatenate(one), np.concatenate(two)
    names = np.intersect1d(a, b)
    if one is two:
        found, times = np.unique(a, return_counts=True)
        names = found[times > 1]
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    if not len(names):
        return out

    def placed(sets: list[np.ndarray], every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(names, every)
        col[col == len(names)] = 0
        hit = names[col] == every
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    ra, ca = placed(one, a)
    rb, cb = (ra, ca) if one is two else placed(two, b)
    for at in range(0, len(names), COLUMNS):
        x = np.zeros((len(one), min(COLUMNS, len(names) - at)), dtype=np.float32)
        s = slice(*np.searchsorted(ca, [at, at + COLUMNS]))
        x[ra[s], ca[s] - at] = 1
        if one is two:
            y = x
        else:
            y = np.zeros((len(two), x.shape[1]), dtype=np.float32)
            s = slice(*np.searchsorted(cb, [at, at + COLUMNS]))
            y[rb[s], cb[s] - at] = 1
        out += x @ y.T
    return out


def _settle(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Sorted by (family, p, q): exact links of a task's texts -> id, links (copies of the linked classes), root."""
    ids_out, links_out, roots_out = [], [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids_out)), pa.array(np.concatenate(links_out)), pa.array(np.concatenate(roots_out))], names=["id", "links", "root"])
        ids_out.clear(), links_out.clear(), roots_out.clear()
        return out

    for group in sorted_groups(batches, ["family", "p", "q"]):
        ids, copies, side = (np.asarray(group.column(c)) for c in ("id", "copies", "side"))
        sets: list[np.ndarray] = []
        for part in group.to_batches():
            for x in slices([part], "text"):
                sets += shingles(x.column("text"), k)
        one = np.flatnonzero(side == 0)
        same = group.column("p")[0] == group.column("q")[0]
        two = one if same else np.flatnonzero(side == 1)
        if not len(one) or not len(two):
            continue
        left = [sets[i] for i in one]
        right = left if same else [sets[i] for i in two]
        both = _intersections(left, right).astype(np.int64)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        linked = (den + num) * both >= num * (size[one][:, None] + size[two][None, :])
        if same:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), dtype=np.int64)
        links[one] += linked @ copies[two]
        if not same:
            links[two] += linked.T @ copies[one]
        i, j = np.nonzero(linked)
        root = local_components(len(ids), one[i], two[j])
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)  # of nodes
        some = np.flatnonzero(links)
        ids_out.append(ids[some])
        links_out.append(links[some])
        roots_out.append(low[root][some])
        if len(ids_out) > 2000:
            yield flush()
    if ids_out:
        yield flush()


def families(scratch: Scratch, points: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """points(id, sig) -> (id, root): components of the sketch links that the chosen-path join finds."""
    n_runs, least, share = runs(), least_matches(threshold), float(threshold)
    branch = "key long, id long, sketch binary"
    level = points.select("id", "sig").mapInArrow(lambda b: _roots(b, n_runs, share), branch)
    found = None
    for depth in range(1, DEPTH + 1):
        large = scratch.cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF))
        some = large.limit(1).count() > 0
        small = level.join(large, "key", "left_anti") if some else level
        searched = small.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _leaves(b, least), "u long, v long")
        found = searched if found is None else found.unionByName(searched)
        if not some:
            return components(scratch, found)
        level = level.join(large, "key").select("key", "id", "sketch", "n")
        if depth < DEPTH:
            level = scratch.cut(level.select("key", "id", "sketch").mapInArrow(lambda b: _deeper(b, share), branch))
    rest = in_blocks(level, F.ceil(F.col("n") / BLOCK), ["key"]).select("key", "p", "q", "side", "id", "sketch")
    return components(scratch, found.unionByName(rest.mapInArrow(lambda b: _blocks(b, least), "u long, v long")))


def _judged(docs: DataFrame, k: int, threshold: Fraction, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): a row's id, set name and number of shingles; a set's smallest id, copies, links, class and survivor."""
    docs = docs.select("doc_id", "text")
    signed = scratch.cut(docs.mapInArrow(lambda b: _signed(b, k), "doc_id long, h1 long, h2 long, n_set long, sig binary"))
    some = signed.where("n_set > 0 and doc_id is not null")
    sets = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_set").alias("n_set"), F.first("sig").alias("sig"))
    # Numbers are given once, as the table is written: what follows reads them and never makes them again.
    sets = scratch.cut(sets.withColumn("node", F.monotonically_increasing_id()))
    family = scratch.cut(families(scratch, sets.select(F.col("node").alias("id"), "sig"), threshold))

    members = family.withColumnRenamed("id", "node").join(sets.select("node", "id", "h1", "h2", "copies", "n_set"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_set").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    members = scratch.cut(members.join(sizes, "root").select(F.col("root").alias("family"), "node", "id", "h1", "h2", "copies", blocks))
    # Texts outside families stay where they are: a Bloom filter of the members' ids stands before the shuffle. Rows that
    # repeat an id and a set melt into one before it.
    words = bloom.size(members.count())
    bits = scratch.cut(bloom.build(members.select("id"), "id", words)).scalar()
    near = docs.where(bloom.may_contain(bits, words, F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")
    near = near.mapInArrow(lambda b: _named(b, k, ["h1", "h2"]), "id long, text string, h1 long, h2 long")
    texts = near.groupBy("id", "h1", "h2").agg(F.first("text").alias("text")).join(members, ["id", "h1", "h2"])
    tasks = in_blocks(texts.select("family", F.col("node").alias("id"), "copies", "blocks", "text"), F.col("blocks"), ["family"]).select("family", "p", "q", "side", "id", "copies", "text")
    num, den = threshold.numerator, threshold.denominator
    settled = scratch.cut(tasks.mapInArrow(lambda b: _settle(b, k, num, den), "id long, links long, root long"))
    scratch.drop(family), scratch.drop(members)

    classes = components(scratch, settled.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = settled.groupBy("id").agg(F.sum("links").alias("links"))
    own = sets.select(F.col("node").alias("id"), F.col("id").alias("set_id"), "h1", "h2", "copies").join(links, "id", "left").join(classes, "id", "left")
    own = scratch.cut(own.select("h1", "h2", "set_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    scratch.drop(settled), scratch.drop(sets)
    first = own.groupBy("root").agg(F.min(F.struct("set_id", "h1", "h2")).alias("s"))
    by_set = own.join(first, "root").select("h1", "h2", "set_id", "copies", "links", F.col("s.set_id").alias("class"), (F.struct("set_id", "h1", "h2") == F.col("s")).alias("survivor"))
    by_set = scratch.cut(by_set)
    scratch.drop(own)
    return signed.select("doc_id", "h1", "h2", "n_set"), by_set


def ngram_join(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """docs(doc_id long, text string) -> one row for each row: doc_id, n_links, class_id, kept, set_id.

    n_links: other rows whose shingle sets have a Jaccard similarity of ``threshold`` or more. class_id: the smallest
    doc_id reachable by links, the own one included; classes of different texts under one id may share it. kept: the row
    is of its class's first set, by doc_id, and under that set's smallest id. set_id: the smallest doc_id with an equal set.
    """
    rows, sets = _judged(docs, k, threshold, Scratch(docs.sparkSession, "ngram-join"))
    out = rows.join(sets, ["h1", "h2"], "left")
    own = (F.col("n_set") > 0) & F.col("doc_id").isNotNull()
    out = out.select(
        "doc_id",
        F.when(own, F.col("copies") - 1 + F.col("links")).otherwise(0).alias("n_links"),
        F.when(own, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("survivor") & (F.col("doc_id") == F.col("set_id"))).otherwise(True).alias("kept"),
        F.when(own, F.col("set_id")).otherwise(F.col("doc_id")).alias("set_id"),
    )
    return out


def keep_one(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each class one row, and every row that links with nothing.

    Rows with a null id or without shingles stay. A class keeps its first set, by smallest doc_id, and of the rows with
    that id and set the first by all columns. Where all rows of an id fare alike, ids decide, and texts are not read
    again; only rows of ids with kept and dropped texts, or with repeated ones, are named and joined by their set.
    """
    scratch = Scratch(docs.sparkSession, "ngram-stage")
    rows, sets = _judged(docs, k, threshold, scratch)
    h1, h2, many = fresh(docs, "h1", "h2", "many")
    own = rows.where("doc_id is not null and n_set > 0").join(sets.select("h1", "h2", "set_id", "survivor"), ["h1", "h2"])
    own = own.withColumn("stays", F.col("survivor") & (F.col("doc_id") == F.col("set_id")))
    bare = rows.where("doc_id is not null and n_set = 0").select("doc_id", F.lit(True).alias("stays"), F.lit(True).alias("bare"))
    ids = own.select("doc_id", "stays", F.lit(False).alias("bare")).unionByName(bare).groupBy("doc_id")
    ids = scratch.cut(ids.agg(F.max("stays").alias("some"), F.min("stays").alias("every"), F.count(F.when(~F.col("bare"), 1)).alias("times"), F.max("bare").alias("bare")))
    mixed = F.col("some") & ((F.col("times") > 1) | (F.col("bare") & (F.col("times") > 0)))
    gone, twice = scratch.cut(ids.where(~F.col("some")).select("doc_id")), scratch.cut(ids.where(mixed).select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not twice.limit(1).count():
        return left
    again = docs.join(twice, "doc_id", "left_semi").select(docs.columns)
    named = again.mapInArrow(lambda b: _named(b, k, [h1, h2]), f"{docs.schema.simpleString()[7:-1]},{h1}:bigint,{h2}:bigint")
    stay = scratch.cut(own.where("stays").select("doc_id", "h1", "h2").distinct())
    found = named.join(stay.select("doc_id", F.col("h1").alias(h1), F.col("h2").alias(h2)), ["doc_id", h1, h2])
    found = found.groupBy("doc_id", h1, h2).agg(F.min(F.struct(*docs.columns)).alias(many)).select(f"{many}.*")
    empty1, empty2 = set_id(np.zeros(0, dtype=np.uint64))
    blank = named.where((F.col(h1) == empty1) & (F.col(h2) == empty2)).select(docs.columns)
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(found.select(docs.columns)).unionByName(blank)
