"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled 1; unlabelled web text is drawn from all texts, whatever their labels; labels 0 are never
used. With the class prior p the risk of a scorer g is p R+(g) + max(0, Ru-(g) - p Rp-(g)): the positives' share of the
unlabelled loss is taken out, and where the rest would turn negative (over-fitting) the step goes the other way. The
prior is estimated from the same two samples: a discriminator between them, fitted on one half, orders the other half,
and the least ratio of unlabelled to positive texts among the most positive-like ones bounds the prior. The scorer is a
small network on hashed words and shape statistics of the whole text, trained with mini-batches on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Scratch, slices
from tapeflow.llm.shingles import text_bytes, word_hashes

#: The sample that a classifier is fitted on: rows at most.
POSITIVES, UNLABELLED = 6000, 12000
#: Large batches: where a batch's own noise turns the rest of the risk negative, the step back would be a wrong one.
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 12, 500, 2048, 0.01, 1e-3, 3
THRESHOLD = 0.3
#: The prior where there are too few texts to tell it, and how many of either kind that takes.
DEFAULT_PRIOR, FEWEST = 0.8, 40
#: Buckets of the hashed words, a power of two.
BUCKETS = 256

# Byte classes.
_CLASSES = {
    "symbol": b"#*$%&<>",
    "pipe": b"|",
    "mark": b"!?",
    "stop": b".,;:",
    "digit": b"0123456789",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "quote": b"\"'()[]{}=_/\\~^`+-@",
    "line": b"\n",
}
SHAPES = (*_CLASSES, "log_words", "word_bytes", "word_spread", "same_next", "repeat_3", "distinct", "wide_upper")
FEATURES = (*SHAPES, *(f"word_{i}" for i in range(BUCKETS)))


def features(column: pa.Array) -> np.ndarray:
    """(texts, features) of the whole texts; a null or empty text has zeros."""
    data, at = text_bytes(column)
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((n, len(FEATURES)))
    if not len(full):
        return out
    place = at[:-1][full]

    def share(flags: np.ndarray) -> np.ndarray:
        found = np.zeros(n)
        found[full] = np.add.reduceat(flags, place, dtype=np.int64)
        return found / size

    for k, chars in enumerate(_CLASSES.values()):
        table = np.zeros(256, dtype=bool)
        table[list(chars)] = True
        out[:, k] = np.sqrt(share(table[data]))
    # Two-byte capitals of Latin-1: C3 and 80 to 9E.
    wide = np.zeros(len(data), dtype=bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out[:, FEATURES.index("wide_upper")] = np.sqrt(share(wide))
    words, counts = word_hashes(data, at)
    k, first = FEATURES.index("log_words"), 0
    out[:, k] = np.log1p(counts) / 10
    letters = np.diff(at) - np.diff(np.concatenate(([0], np.cumsum((data <= 32))))[at])
    out[:, k + 1] = np.log1p(letters / np.maximum(counts, 1)) / 3
    for i, m in enumerate(counts.tolist()):
        if m > 1:
            w = words[first : first + m]
            out[i, k + 3] = np.sqrt(np.mean(w[1:] == w[:-1]))
            names = np.unique(w)
            out[i, k + 5] = len(names) / m
            if m > 3:
                v = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)
                out[i, k + 4] = np.sqrt(1 - len(np.unique(v)) / len(v))
        first += m
    out[:, k + 2] = out[:, k + 1] * out[:, k]
    bucket = (words >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    found = np.bincount(np.repeat(np.arange(n), counts) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, len(SHAPES) :] = np.sqrt(found / np.maximum(counts, 1)[:, None])
    return out


class Network:
    """One hidden layer; scores are the sigmoid of its output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        h = np.tanh((x - self.mean) / self.scale @ a + b)
        return 1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS) -> Network:
    """Minimises the non-negative risk with the logistic loss by Adam. Empty samples give the score ``prior`` everywhere.

    Without a prior it fits a plain discriminator of the two samples, both of the same weight.
    """
    width = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        prior = DEFAULT_PRIOR if prior is None else prior
        bias = np.log(prior / (1 - prior))
        return Network(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(bias)])
    rng = np.random.default_rng(SEED)
    mean, scale = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3)
    p, u = (((x - mean) / scale).astype(np.float32) for x in (positive, unlabelled))
    w = [rng.standard_normal((width, HIDDEN)) / np.sqrt(width), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    w = [x.astype(np.float32) for x in w]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    size = min(BATCH, max(len(p), len(u)))

    def turns(n: int) -> Iterator[np.ndarray]:
        """Every row once in random order, again and again, a batch at a time."""
        left = rng.permutation(n)
        while True:
            while len(left) < size:
                left = np.concatenate((left, rng.permutation(n)))
            yield left[:size]
            left = left[size:]

    positives, others = turns(len(p)), turns(len(u))
    for t in range(1, steps + 1):
        bp, bu = p[next(positives)], u[next(others)]
        x = np.concatenate((bp, bu))
        h = np.tanh(x @ w[0] + w[1])
        g = h @ w[2] + w[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of a positive 1 - s, of a negative s; logistic slopes below
        n, k = len(bp), len(bu)
        loss_neg_u, loss_neg_p = -np.log1p(-s[n:].clip(max=1 - 1e-9)).mean(), -np.log1p(-s[:n].clip(max=1 - 1e-9)).mean()
        d = np.zeros_like(g)
        if prior is None:
            d[:n] = (s[:n] - 1) / n
            d[n:] = s[n:] / k
        elif loss_neg_u >= prior * loss_neg_p:
            d[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
            d[n:] = s[n:] / k
        else:
            d[:n] = prior * s[:n] / n
            d[n:] = -s[n:] / k
        dh = (np.outer(d, w[2]) * (1 - h * h)).astype(np.float32)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum()]
        for i, gr in enumerate(grads):
            gr = gr + DECAY * w[i]
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            w[i] = (w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(mean, scale, w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled texts, from samples of both and nothing else.

    Whatever set of texts is looked at, unlabelled ones hold at least prior x the positives' share in it, so the ratio
    of the two shares bounds the prior from above, most closely where negatives are rare: among the texts that a
    discriminator, fitted on the other half, finds most positive-like. Sets with under half of the positives don't count.
    """
    if min(len(positive), len(unlabelled)) < FEWEST:
        return DEFAULT_PRIOR
    # Halves by content: a text that is in both samples, or repeats, is in one half.
    left, right = (np.array([zlib.crc32(r.tobytes()) & 1 for r in x.astype(np.float32)], dtype=bool) for x in (positive, unlabelled))
    shares = []
    for a in (True, False):
        if not ((left == a).any() and (left != a).any() and (right != a).any()):
            return DEFAULT_PRIOR
        net = fit(positive[left == a], unlabelled[right == a], None, STEPS // 3)
        p, u = net.score(positive[left != a]), np.sort(net.score(unlabelled[right != a]))
        at = np.quantile(p, np.linspace(0.02, 0.5, 25))
        kept = np.array([(p >= t).mean() for t in at])
        shares.append((1 - np.searchsorted(u, at, side="left") / len(u)) / kept)
    return float(np.clip(np.mean(shares, axis=0).min(), 0.01, 0.99))


def _features_of(rows: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(column), pa.array([r.tobytes() for r in x.astype(np.float32)], type=pa.binary())], names=[column, "x"])

    return rows.select(column, "text").mapInArrow(run, f"{column} boolean, x binary")


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[Network, float]:
    """docs(doc_id, text), labels(doc_id, quality); ``learn`` selects rows of both that may teach, by doc_id.

    A doc_id with several labels is a positive if one of them is 1. The sample takes the ids with the smallest hashes: at
    most POSITIVES and UNLABELLED, each once whatever its rows (of several texts the first in order), features only.
    Rows with a null id teach nothing.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
    known = labels.where(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    first = known.orderBy(*order).limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    second = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = scratch.cut(first.unionByName(second))
    # At most POSITIVES + UNLABELLED ids and flags: a bounded side, one text for each of them, and a bounded result.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = sorted((r["positive"], bytes(r["x"])) for r in _features_of(texts, "positive").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    flag = np.array([r[0] for r in rows], dtype=bool)
    prior = estimate_prior(x[flag], x[~flag])
    return fit(x[flag], x[~flag], prior), prior


def score(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted for every row, whatever its id; null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text"):
            s = net.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
