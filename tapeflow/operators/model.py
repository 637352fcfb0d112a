"""A directional model on Spark ML: gradient-boosted trees, one class against the rest, with sample weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.operators.evaluation import rank_auc


@dataclass
class Fitted:
    columns: list[str]
    models: list[GBTClassificationModel | None]
    frequencies: list[float]


def _assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN become 0, as neutral values."""
    clean = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(clean)


def fit(train: DataFrame, columns: Sequence[str], label: str, weight: str | None = None, classes: int = 3, trees: int = 20, depth: int = 5, seed: int = 7) -> Fitted:
    """One binary model for each class of ``label`` (0 to classes - 1); for two classes one in all.

    A class that no row has, or every row, needs no trees: its model is None and its probability its frequency.
    """
    rows = _assembled(train.where(F.col(label).isNotNull()), columns)
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = max(1, sum(counts.values()))
    models = []
    for k in range(1 if classes == 2 else 0, classes):
        if counts.get(k, 0) in (0, sum(counts.values())):
            models.append(None)
            continue
        gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {}))
        models.append(gbt.fit(rows.withColumn("_y", (F.col(label) == k).cast("double"))))
    return Fitted(list(columns), models, [counts.get(k, 0) / total for k in range(classes)])


def predict(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """Adds p0, p1, ...: the classes' probabilities, scaled to sum to 1; all alike after a fit on no rows."""
    out = _assembled(rows, fitted.columns)
    first = len(fitted.frequencies) - len(fitted.models)
    for i, m in enumerate(fitted.models):
        if m is None:
            out = out.withColumn(f"_p{first + i}", F.lit(float(fitted.frequencies[first + i]) if any(fitted.frequencies) else 1 / len(fitted.frequencies)))
            continue
        out = m.transform(out).withColumn(f"_p{first + i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    if first:
        out = out.withColumn("_p0", 1 - F.col("_p1"))
    names = [f"_p{i}" for i in range(len(fitted.frequencies))]
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return out.withColumns({n[1:]: F.col(n) / total for n in names}).drop("_x", *names)


def importance(fitted: Fitted) -> DataFrame:
    """feature, importance: the mean over the classes' models, largest first."""
    mean = [float(sum(m.featureImportances[i] for m in fitted.models if m) / len(fitted.models)) for i in range(len(fitted.columns))]
    rows = sorted(zip(fitted.columns, mean), key=lambda x: (-x[1], x[0]))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


#: The families of features, and how the names of their members begin.
FAMILIES: dict[str, tuple[str, ...]] = {
    "spread": ("spread_",),
    "aggr_delta": ("aggr_delta",),
    "price_progress": ("price_progress", "directional_efficiency"),
    "price_impact": ("price_impact",),
    "absorption": ("absorption",),
    "trade_burst": ("trade_burst",),
    "replenishment": ("replenish",),
    "stacking": ("stacking",),
    "queue_depletion": ("queue_depletion",),
    "queue_turnover": ("queue_turnover",),
    "iceberg": ("iceberg_score",),
    "vacuum": ("liquidity_vacuum",),
    "resiliency": ("book_resiliency",),
    "liquidity_age": ("liquidity_age",),
    "mlofi": ("mlofi",),
    "book_imbalance": ("book_imbalance",),
    "microprice": ("microprice",),
    "sweeps": ("sweep_", "failed_sweeps"),
    "order_survival": ("liquidity_survival", "cancel_before_touch"),
    "order_lifetime": ("order_lifetime",),
    "scales_regime": ("sigma_", "v_scale", "d_scale", "norm_ready"),
}
SIGNED_FAMILY = "signed_v2"


def family(column: str, signed: Sequence[str] = ()) -> str:
    """The family of a feature, ``f_`` before its name or not. Signed features and their twins are one family, also where
    their names begin like another's; names that begin like none's are ``other``."""
    name = column.removeprefix("f_")
    if any(name == s or name.startswith(f"{s}_") for s in signed):
        return SIGNED_FAMILY
    return next((f for f, starts in FAMILIES.items() if name.startswith(starts)), "other")


def families(columns: Sequence[str], signed: Sequence[str] = ()) -> dict[str, list[str]]:
    """Columns by family, in their order."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(family(c, signed), []).append(c)
    return out


def _mean_auc(scored: DataFrame, label: str, classes: int) -> float | None:
    """The mean area of the classes from 1 on, one against the rest; None where one of them has none."""
    found = [rank_auc(scored.select(F.col(f"p{k}").alias("s"), (F.col(label) == k).alias("y")), "s", "y").first()["auc"] for k in range(1, classes)]
    return None if None in found else sum(found) / len(found)


def _drops(rows: list[tuple[str, float | None]], name: str) -> DataFrame:
    rows.sort(key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
    return SparkSession.getActiveSession().createDataFrame(rows, f"{name} string, auc_drop double")


def ablation(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str, signed: Sequence[str] = (), classes: int = 3, **given) -> DataFrame:
    """family, auc_drop: how much the mean area on ``test`` falls when the model is fitted again without the family.

    One fit for each family; persist ``train`` and ``test`` before. Null where an area is; largest drop first.
    """
    area = lambda kept: _mean_auc(predict(test, fit(train, kept, label, classes=classes, **given)), label, classes)
    whole, out = area(list(columns)), []
    for name, members in families(columns, signed).items():
        kept = [c for c in columns if c not in members]
        a = area(kept) if kept else 0.5
        out.append((name, None if whole is None or a is None else whole - a))
    return _drops(out, "family")


def shuffled(rows: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], seed: int = 7) -> DataFrame:
    """The values of ``column`` dealt to other rows of the same ``keys``: each row takes the next one's in an order by hash.

    Null keys are a key of their own. ``order`` names the row; a key with one row keeps its value.
    """
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *order), *order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, k = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    return rows.withColumns({"_last": k == n, "_next": F.lead(column).over(w), "_first": F.first(column).over(whole)}).withColumn(column, F.when(F.col("_last"), F.col("_first")).otherwise(F.col("_next"))).drop("_last", "_next", "_first")


def permutation(test: DataFrame, fitted: Fitted, label: str, keys: Sequence[str], order: Sequence[str], seed: int = 7) -> DataFrame:
    """feature, auc_drop: how much the mean area falls when a feature's values are dealt to other rows of the session."""
    classes = len(fitted.frequencies)
    whole, out = _mean_auc(predict(test, fitted), label, classes), []
    for c in fitted.columns:
        a = _mean_auc(predict(shuffled(test, c, keys, order, seed), fitted), label, classes)
        out.append((c, None if whole is None or a is None else whole - a))
    return _drops(out, "feature")
