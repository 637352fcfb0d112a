import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeflow.llm import classifier, language_id, queries
from tapeflow.llm.common import Scratch, held_out, scratch_dir
from tests.llm.helpers import DOCS, awkward, empty, rng, words

SF = "/root/testdata/sf0.01"


def longest(text, corpus, at):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in corpus:
        n += 1
    return n


def counted(text, corpus):
    at = count = 0
    while at < len(text):
        at += max(1, longest(text, corpus, at))
        count += 1
    return count


@pytest.mark.parametrize("stretch", [4096, 7])
def test_phrases_are_longest_matches_across_blanks(monkeypatch, stretch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    monkeypatch.setattr(language_id, "LANES", 40)
    g = rng(1)
    samples = {k: " ".join(words(g, 60, a)) for k, a in (("aa", "abcd"), ("bb", "bcdé"), ("zh", "你好吗我是不了人们来这那他她"))}
    m = language_id.Model(samples)
    some = [*(" ".join(words(g, g.randint(1, 30), "abcdeé你好")) for _ in range(60)), "a", "zz", "a!!b", "A  \n B1c", " ".join(samples["aa"].split()[3:9]), "क्षि x"]
    codes, at, lettered = m.codes(some + ["", None, "12 ... 3"], m.table())
    got = m.phrases(codes, at)
    assert lettered.tolist() == [True] * len(some) + [False] * 3
    for text, row in zip(some, got.tolist()):
        own = f" {language_id.reduced(text)} "
        assert row == [sum(counted(own[i : i + stretch], f" {language_id.reduced(samples[k])} ") for i in range(0, len(own), stretch)) for k in m.languages], text


def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1]
    step = language_id.suffix_automaton(text)
    base, entries = language_id.interleaved(step, 4)

    def accepts(word):
        s = 0
        for c in word:
            e = int(entries[base[s] + c])
            assert (e >> 32 == s) == (c in step[s])
            if e >> 32 != s:
                return False
            s = e & 0xFFFFFFFF
            assert s in step[e >> 32].values()
        return True

    subs = {tuple(text[i:j]) for i in range(7) for j in range(i + 1, 8)}
    every = {(a, b, c) for a in range(4) for b in range(4) for c in range(4)}
    assert all(accepts(s) for s in subs) and not any(accepts(w) for w in every - subs)


ALPHABETS = {"zh": (0x4E00, 1500), "ja": (0x3041, 86), "ko": (0xAC00, 1200), "ru": (0x430, 32), "ar": (0x627, 28), "hi": (0x905, 50), "el": (0x3B1, 25), "en": (0x61, 26), "th": (0xE01, 46)}


def test_nine_scripts_at_once(spark):
    """Large alphabets beside small ones; every letter of a sample counts, and no language is left out."""
    g, rows = rng(12), []
    for lang, (first, n) in ALPHABETS.items():
        stock = ["".join(chr(first + g.randrange(n)) for _ in range(g.randint(2, 6))) for _ in range(150)]
        rows += [(lang, " ".join(g.choice(stock) for _ in range(40))) for _ in range(24)]
    g.shuffle(rows)
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    held = held_out("doc_id", 3, 1)
    got = language_id.predict(docs.where(held), language_id.train(docs, ~held)).collect()
    assert len(got) > 50 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.2 for r in got)


def test_an_id_that_repeats_counts_once_in_the_sample(spark):
    text = "immer derselbe text " * 30
    docs = spark.createDataFrame([(1, text, "de")] * 500 + [(i, f"ein anderer satz nummer {chr(97 + i % 26) * 3} und mehr " * 9, "de") for i in range(2, 40)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, Scratch(spark, "t"), F.lit(True))["de"]
    assert got.count("immer derselbe text") <= 30 and sum(f"nummer {c * 3}" in got for c in "cdefghijklmn") == 12


def test_language_held_out_accuracy(spark):
    out = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id")
    held = out.where("held_out and n_chars > 50").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.collect())


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = language_id.train(docs, F.lit(True))
    got = language_id.predict(docs.withColumn("score", F.lit("clash")), model)
    assert got.count() == 12 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got.where("doc_id <= 3").collect())
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = language_id.train(empty(spark), F.lit(True))
    assert none.languages == [] and {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def test_language_with_a_common_header(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 50")
    header = (docs.where("lang = 'en' and n_chars > 900").orderBy("doc_id").first()["text"] * 2)[:800]
    german = F.col("lang") == "de"
    headed = docs.withColumn("text", F.when(german, F.concat(F.lit(header + " "), "text")).otherwise(F.col("text")))
    held = held_out("doc_id", 3, 1)
    got = language_id.predict(docs.where(held & german), language_id.train(headed, ~held)).collect()
    assert np.mean([r["lang_pred"] == "de" for r in got]) > 0.95


def test_classifier_held_out_accuracy(spark):
    out = queries.op7_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_positive_unlabelled_fit_separates_without_negatives():
    r = np.random.default_rng(0)
    width = len(classifier.FEATURES)
    positive = r.standard_normal((800, width)) * 0.5
    unlabelled = np.concatenate([r.standard_normal((700, width)) * 0.5, r.standard_normal((300, width)) * 0.5 + 2])
    net = classifier.fit(positive, unlabelled, 0.7)
    s = net.score(unlabelled)
    assert (s[:700] >= 0.5).mean() > 0.97 and (s[700:] < 0.5).mean() > 0.97
    assert classifier.fit(positive[:0], unlabelled, 0.7).score(unlabelled[:1])[0] == pytest.approx(0.7)


@pytest.mark.parametrize("prior", [0.4, 0.7, 0.9])
def test_prior_from_positives_and_unlabelled_only(prior):
    r = np.random.default_rng(2)
    width, n = len(classifier.FEATURES), 3000
    shift = np.zeros(width)
    shift[:20] = 2
    positive = r.standard_normal((1500, width))
    unlabelled = r.standard_normal((n, width)) + np.where(np.arange(n) < prior * n, 0, 1)[:, None] * shift
    assert classifier.estimate_prior(positive, r.permutation(unlabelled)) == pytest.approx(prior, abs=0.07)


def test_labels_of_zero_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 300")
    one, other = (classifier.train(docs, x, F.lit(True)) for x in (labels, labels.where("quality = 1")))
    assert one[1] == other[1] and all((a == b).all() for a, b in zip(one[0].weights, other[0].weights))


def test_classifier_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model, prior = classifier.train(docs, labels, ~held_out("doc_id", 5, 0))
    got = classifier.score(docs, model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got) and 0 < prior < 1
    model, prior = classifier.train(empty(spark), labels.where("false"), F.lit(True))
    assert prior == classifier.DEFAULT_PRIOR and classifier.score(empty(spark), model).count() == 0


def test_features_of_a_text_ignore_its_neighbours():
    texts = [None, "", "One two, THREE!!\nfour | five", "é" * 10, "x", " \n"]
    every = classifier.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(every[i], classifier.features(pa.array([t], type=pa.string()))[0])


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, counts = docs.columns, docs, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "ngram_join", "pii", "packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{scratch_dir(spark)}/stage-{name}"
        stage(spark, at, SF).write.mode("overwrite").parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == columns
        counts.append(at.count())
        if name == "quality_rules":
            kept = [labels[r["doc_id"]] for r in at.select("doc_id").collect() if r["doc_id"] in labels]
            assert np.mean(kept) > 0.99
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0
    assert at.where(F.col("text").rlike("[a-z]@mail[0-9]")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert last.select("doc_id").distinct().count() == counts[4]


def test_pipeline_takes_awkward_and_empty_documents(spark):
    for start in (awkward(spark), empty(spark)):
        at = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= 0
