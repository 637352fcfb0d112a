import hashlib
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeflow.llm import bpe, packing
from tests.llm.helpers import DOCS, awkward, documents, empty, rng, words

RANKS, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(" \n\tab'st1,.é😀", max_size=40))
def test_encoding_equals_the_library_and_decodes_back(reference, text):
    c = bpe.codec(RANKS)
    ids = c.encode(text)
    assert ids == reference.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))
    assert all(h.slot(f"x{i}".encode()) == -1 for i in range(3000))
    assert bpe.PerfectHash([b"one"]).slot(b"one") == 0


def test_memory_of_pieces_is_bounded_and_changes_nothing(reference):
    c = bpe.Codec(bpe.read_ranks(RANKS))
    c.after_blank.most = 50
    texts = [" ".join(words(rng(i), 60)) for i in range(40)]
    assert [c.encode(t) for t in texts] == reference.encode_ordinary_batch(texts)
    long = " ".join(c * 5000 for c in "abcdefgh") + " x" + " y" * 200
    assert c.encode(long) == reference.encode_ordinary(long)
    assert len(c.after_blank) <= 50 and len(c.after_blank.old) <= 50 and max(map(len, c.after_blank)) <= bpe.LONGEST


def test_long_runs_merge_in_good_time(reference):
    for text in ("a" * 20_000, "=" * 20_000, " " * 5000 + "x", "ab" * 8000):
        assert bpe.codec(RANKS).encode(text) == reference.encode_ordinary(text)


def test_frames(spark, reference):
    docs = awkward(spark)
    rows = [tuple(r) for r in bpe.round_trip(docs, RANKS).collect()]
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert bpe.round_trip(empty(spark), RANKS).count() == 0
    back = bpe.decode(bpe.encode(docs.withColumnRenamed("lang", "ids"), RANKS), RANKS)
    assert all(bytes(r["data"]) == (r["text"] or "").encode() for r in back.collect())


def placed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= capacity
    return len(bins)


def test_pieces_follow_the_tokenizer(spark):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    docs = awkward(spark).unionByName(spark.createDataFrame(documents(["a <|endoftext|> b"]), DOCS))
    want = []
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, n in enumerate([len(ids) % 100] * bool(len(ids) % 100) + [100] * (len(ids) // 100)):
            want.append((r["doc_id"], k, at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n]))))
            at += n
    rows = packing.pack_documents(docs, FILE, 100).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert placed(rows, 100) >= -(-sum(r["length"] for r in rows) // 100)
    assert packing.pack_documents(empty(spark), FILE).count() == 0


def test_few_sequences_on_a_table_and_one_length_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack_documents(docs.unionByName(same), FILE).collect()
    total = sum(r["length"] for r in rows)
    assert -(-total // 2048) <= placed(rows, 2048) <= -(-total // 2048) + 1
    assert sum(r["doc_id"] is None for r in rows) == 300


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plan_places_every_rank_once(counts):
    plan = packing.plan(counts, 60)
    bins, seen = {}, {}
    for size, n in counts.items():
        rows = [r for r in plan.tolist() if r[0] == size]
        for rank in range(n):
            _, first, seq, per, offset = [r for r in rows if r[1] <= rank][-1]
            i = rank - first
            bins.setdefault(seq + i // per, []).append((offset + i % per * size, size))
        seen[size] = n
    total = sum(s * n for s, n in counts.items())
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= 60
    assert sorted(bins) == list(range(len(bins))) and seen == counts
    large = sum(n for s, n in counts.items() if s > 30)
    assert len(bins) <= max(large, 1.5 * total / 60) + 2 * len(counts) / 3 + 1


def test_large_items_pair_at_most_twice_and_match_greedily():
    """315 of 60 each need six: the two longest kinds never share, two of 25 do, and 20s fill the gaps."""
    plan = packing.plan({40: 3, 25: 3, 20: 6}, 60)
    assert plan[:, 2].max() + 1 == 6 and {r[0] for r in plan.tolist()} == {40, 25, 20}
