from pyspark.sql import functions as F

from tapeflow.operators import model
from tapeflow.plans import kernel_queries as K

SF = "/root/testdata/sf0.001"


def watched(monkeypatch):
    """The calls of model.fit, each made with small trees so that the test is quick. No row of the tables moves far
    enough for a direction, so rows get one by their number."""
    calls, fit, rows = [], model.fit, K.model_rows
    monkeypatch.setattr(K, "model_rows", lambda spark, sf_dir: rows(spark, sf_dir).withColumn("direction", (F.col("row_seq") % 3).cast("int")))

    def small(train, columns, label, **given):
        calls.append((train, list(columns), given))
        return fit(train, columns, label, **given | {"trees": 1, "depth": 1})

    monkeypatch.setattr(model, "fit", small)
    return calls


def test_held_out_sessions_are_purged(spark):
    rows = spark.range(1000).select((F.col("id") * K.HOUR).alias("ts"), ((F.col("id") + 7) * K.HOUR).alias("label_end_ts"), F.floor(F.col("id") / 24).cast("int").alias("session"))
    train, test = K.held_out_sessions(rows)
    start = test.agg(F.min("ts")).first()[0]
    last = train.agg(F.max("label_end_ts"), F.max("session")).first()
    assert last[0] < start and last[1] <= test.agg(F.min("session")).first()[0] and train.count() + 7 == rows.where(F.col("ts") < start).count()


def test_sign_diagnostic_scores_held_out_rows_of_three_sets(spark, monkeypatch):
    calls = watched(monkeypatch)
    got = K.sign_diagnostic(spark, SF).collect()
    assert [(r["feature_set"], r["features"]) for r in got] == [("v1", 51), ("v1 + signed_v2", 71), ("signed_v2 only", 20)]
    assert all(0 <= r["auc"] <= 1 for r in got)
    assert [(len(c), g) for _, c, g in calls] == [(n, {"classes": 2}) for n in (51, 71, 20)]


def test_gate_has_three_windows_with_and_without_weights(spark, monkeypatch):
    calls = watched(monkeypatch)
    got = K.model_a_gate(spark, SF).collect()
    assert [(r["train_window"], r["weighted"]) for r in got] == [(w, x) for w in ("12m", "3y", "full") for x in (False, True)]
    assert all(len(c) == 71 and g.keys() == {"weight"} for _, c, g in calls)


def test_signed_features_are_one_family_and_every_feature_has_one():
    assert {model.family(f"f_{c}", K.SIGNED) for c in K.SIGNED} == {"signed_v2"} and len(K.SIGNED) == 20
    assert model.family("f_sweep_net_ticks_m_norm", K.SIGNED) == "signed_v2" and model.family("f_sweep_buy_ticks_m", K.SIGNED) == "sweeps"
    assert model.family("book_imbalance_near", K.SIGNED) == "book_imbalance" and model.family("sigma_30s") == "scales_regime"
    assert set(model.families(K.COLUMNS, K.SIGNED)) == {*model.FAMILIES, "signed_v2"} - {"scales_regime"}


def test_ablation_and_permutation_name_the_feature_that_counts(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).alias("day"), (F.col("id") * 7 % 3).cast("int").alias("y"))
    rows = rows.withColumns({"spread_x": F.col("y") + F.lit(0.0), "mlofi_x": (F.xxhash64("id") % 50).cast("double")}).persist()
    got = model.ablation(rows, rows, ["spread_x", "mlofi_x"], "y", trees=2, depth=2).collect()
    assert got[0]["family"] == "spread" and got[0]["auc_drop"] > 0.2 and abs(got[1]["auc_drop"]) < 0.05
    got = model.permutation(rows, model.fit(rows, ["spread_x", "mlofi_x"], "y", trees=2, depth=2), "y", ["day"], ["id"]).collect()
    assert got[0]["feature"] == "spread_x" and got[0]["auc_drop"] > 0.2 and abs(got[1]["auc_drop"]) < 0.05
    moved = model.shuffled(rows, "mlofi_x", ["day"], ["id"])
    assert all(sorted(r[0] for r in a.where(F.col("day") == d).select("mlofi_x").collect()) == sorted(r[0] for r in rows.where(F.col("day") == d).select("mlofi_x").collect()) for a in (moved,) for d in (0, 1))
    assert moved.columns == rows.columns and model.shuffled(rows.limit(0), "mlofi_x", ["day"], ["id"]).count() == 0


def test_classes_without_a_choice_need_no_trees(spark):
    rows = spark.range(6).select(F.col("id").cast("double").alias("x"), F.lit(0).alias("y"))
    fitted = model.fit(rows, ["x"], "y")
    assert fitted.models == [None] * 3 and set(model.predict(rows, fitted).select("p0", "p1", "p2").collect()) == {(1.0, 0.0, 0.0)}
    assert [r["importance"] for r in model.importance(fitted).collect()] == [0.0]
    nothing = model.predict(rows, model.fit(rows.limit(0), ["x"], "y", classes=2)).first()
    assert (nothing["p0"], nothing["p1"]) == (0.5, 0.5)


def test_importance_covers_every_feature(spark, monkeypatch):
    calls = watched(monkeypatch)
    assert {r["feature"] for r in K.feature_importance(spark, SF).collect()} == set(K.COLUMNS) and not calls[0][2]
