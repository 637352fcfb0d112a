from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeflow.llm import embedding_dedup, ngram_join
from tapeflow.llm.common import Scratch, local_components
from tapeflow.llm.components import components
from tests.llm.helpers import DOCS, awkward, documents, empty, family, rng, words


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (links, class) by all pairs that share a shingle."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    links = {i: {j for j, n in Counter(j for x in s for j in inv[x]).items() if j != i and 5 * n >= 4 * (len(s) + len(sets[j]) - n)} for i, s in sets.items()}

    def smallest(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    return {i: (len(x), smallest(i)) for i, x in links.items()}


def result(df):
    return {r["doc_id"]: (r["n_links"], r["class_id"]) for r in df.collect()}


def test_links_and_classes_match_brute_force(spark):
    g = rng(3)
    texts = [t for n, size, edits in ((40, 60, 1), (30, 120, 4), (12, 40, 2)) for t in family(g, n, size, edits)]
    texts += [" ".join(words(g, g.randint(1, 80))) for _ in range(60)] + texts[:5] * 3
    g.shuffle(texts)
    rows = documents(texts)
    assert result(ngram_join.ngram_join(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_deep_paths_and_blocks_lose_no_link(spark, monkeypatch):
    """Buckets of near copies that never get small: every level, then pairs of blocks."""
    for name, value in (("LEAF", 8), ("BLOCK", 10)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = documents(family(rng(5), 70, 100, 2) + family(rng(6), 25, 50, 0))
    assert result(ngram_join.ngram_join(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    """What the chosen paths find, before any exact check, of pairs just above the threshold."""
    g, texts = rng(8), []
    for _ in range(150):
        base = words(g, 100)
        other = list(base)
        for at in (20, 60):  # ten of 96 windows differ on each side: a similarity of 0.81
            other[at] = "zzzzz"
        texts += [" ".join(base), " ".join(other)]
    got = result(ngram_join.ngram_join(spark.createDataFrame(documents(texts), DOCS)))
    assert np.mean([got[2 * i + 1] == (1, 2 * i) for i in range(150)]) >= 0.98


def test_awkward_rows(spark):
    got = [tuple(r) for r in ngram_join.ngram_join(awkward(spark)).collect()]
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert len(got) == 12 and by[None] == [(0, None, True, None)]
    assert by[1] == [(0, 1, True, 1)] and by[3] == [(0, 3, True, 3)]  # no shingle: alone
    assert by[5] == [(1, 5, True, 5)] and by[6] == [(1, 5, False, 5)]
    assert by[7] == [(2, 7, True, 7)] * 2 and by[8] == [(2, 7, False, 7)]
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    kept = ngram_join.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (1, 0), (200, 199)]
    got = dict(map(tuple, components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {199: 199, 200: 199}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0
    assert local_components(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    r = np.random.default_rng(1)
    base = r.standard_normal((12, 32))
    near = np.repeat(base, 12, axis=0) + 0.12 * r.standard_normal((144, 32))
    x = np.concatenate([near, r.standard_normal((150, 32)), near[:5] * 1.0]).astype(np.float32)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(vectors(spark, x)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_embedding_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_runs_reach_the_recall(depth):
    assert 1 - (1 - ngram_join.survival(depth)) ** ngram_join.runs(0.99, depth) >= 0.99


def test_different_texts_under_one_id_are_judged_apart(spark):
    a, b = (" ".join(words(rng(s), 40)) for s in (21, 22))
    near = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, near, "en", "s", 1), (3, a, "en", "s", 1), (1, a, "en", "s", 1), (4, "", "en", "s", 0), (1, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in ngram_join.ngram_join(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect())
    assert kept == sorted([(1, a), (1, b), (1, ""), (4, "")])


def test_every_run_of_the_join_has_a_branch():
    roots = ngram_join.mix64(np.arange(1, 16 * ngram_join.runs() + 1, dtype=np.uint64))
    row, _ = ngram_join._chosen(roots, 0.8)
    assert len(np.unique(row)) >= ngram_join.runs()


def test_codes_bound_the_cosine():
    r = np.random.default_rng(4)
    x = r.standard_normal((200, 48))
    x[0], x[1] = 0, 0
    x[0, 3], x[1, :2] = 1, (1e-9, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, error = embedding_dedup.decode(embedding_dedup.encode(x))
    assert (np.linalg.norm(x - y, axis=1) <= error + 1e-6).all() and error.max() < 0.05
    assert (x @ x.T <= y @ y.T + error[:, None] + error[None, :] * (1 + error[:, None]) + 1e-4).all()


def test_recall_of_the_index_against_brute_force(spark):
    """Partners at a cosine just above the threshold, among many more vectors than pivots, none of them in the sample's region only."""
    r = np.random.default_rng(9)
    x = r.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.standard_normal((1500, 48))
    u -= (u * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = r.uniform(0.951, 0.957, (1500, 1))
    every = np.concatenate((x, c * x[:1500] + np.sqrt(1 - c * c) * u)).astype(np.float32).astype(np.float64)
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {q["vec_id"]: q["n_links"] for q in embedding_dedup.embedding_dedup(vectors(spark, every)).collect()}
    found = np.array([got[i] for i in range(len(every))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() > 2800


def test_different_vectors_under_one_id_are_judged_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.1]), (3, [1.0, 0.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
