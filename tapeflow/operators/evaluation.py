"""Splits without leakage, metrics, and the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.schema import NANOS


def segment(day: Column, train_end: str, validate_end: str, test_end: str) -> Column:
    """The frozen outer split; ends belong to their segment."""
    d = lambda x: F.lit(x).cast("date")
    return F.when(day <= d(train_end), "train").when(day <= d(validate_end), "validate").when(day <= d(test_end), "test").otherwise("holdout")


def walk_forward(days: DataFrame, train: int, evaluate: int, embargo: int, step: int | None = None, day: str = "session_date") -> DataFrame:
    """fold (from 0), role, day: chronological folds over distinct days, the next ``step`` days on; partial folds drop out."""
    step = step or evaluate
    n = F.row_number().over(Window.orderBy(day)) - 1  # one row a day
    numbered = days.select(day).distinct().withColumn("_n", n)
    total = numbered.agg(F.max("_n") + 1).scalar()
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / step).cast("int")))
    at = F.col("_n") - F.col("fold") * step
    role = F.when(at < train, "train").when(at < train + embargo, "embargo").when(at < train + embargo + evaluate, "eval")
    out = numbered.withColumn("fold", k).withColumn("role", role)
    return out.where(F.col("role").isNotNull() & (F.col("fold") * step + train + embargo + evaluate <= total)).select("fold", "role", day)


def purge(train: DataFrame, eval_start: int, embargo: int = 600 * NANOS) -> DataFrame:
    """Rows whose label ends before the evaluation and that lie more than the embargo before it."""
    return train.where((F.col("label_end_ts") < eval_start) & (F.col("ts") < eval_start - embargo))


def purge_audit(train: DataFrame, eval_start: int, embargo: int = 600 * NANOS, weight: str = "uniqueness", trainable: str = "trainable") -> DataFrame:
    """One row: input, purged and kept rows, and the kept effective size."""
    kept = (F.col("label_end_ts") < eval_start) & (F.col("ts") < eval_start - embargo)
    return train.agg(F.count(F.lit(1)).alias("input_rows"), F.count(F.when(~kept, 1)).alias("purged"), F.count(F.when(kept, 1)).alias("kept"), F.coalesce(F.sum(F.when(kept & (F.col(trainable) == 1), F.col(weight))), F.lit(0.0)).alias("effective_n"))


def rank_auc(rows: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by average ranks; ties count half; null without both classes.

    Scores are counted first, so the running sum is over distinct scores.
    """
    by = list(keys)
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("neg", F.col("n") - F.col("p"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("_u", F.col("p") * (below + F.col("neg") / 2)).groupBy(*by).agg(F.sum("_u").alias("u"), F.sum("p").alias("p"), F.sum("neg").alias("neg"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("p") * F.col("neg"))).alias("auc"))


def brier(rows: DataFrame, probabilities: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over rows of the squared distance of the class probabilities from the one-hot label (0 to classes - 1)."""
    one = sum(((F.col(p) - F.when(F.col(label) == i, 1.0).otherwise(0.0)) * (F.col(p) - F.when(F.col(label) == i, 1.0).otherwise(0.0)) for i, p in enumerate(probabilities)), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.avg(one).alias("brier"))


def gate(rows: DataFrame, cost: float = 0.2, least_sessions: int = 20, least_auc: float = 0.55, least_gain: float = 0.02) -> DataFrame:
    """rows(session, label 0/1/2, p0, p1, p2, ret, tagged; train_p0..2 as columns of class frequencies) -> one verdict row.

    Directional calls (1 up, 2 down) in the top tenth of confidence trade; a trade earns the signed return less the cost.
    It passes with enough sessions, mean one-against-rest area, a better Brier score than the class frequencies, and a
    positive mean also without the best session and without tagged sessions.
    """
    p = ["p0", "p1", "p2"]
    call = F.when((F.col("p1") >= F.col("p2")) & (F.col("p1") >= F.col("p0")), 1).when(F.col("p2") >= F.col("p0"), 2).otherwise(0)
    rows = rows.withColumns({"_call": call, "_conf": F.greatest(*p)})
    cut = rows.agg(F.percentile("_conf", F.lit(0.9))).scalar()
    trades = rows.where((F.col("_conf") >= cut) & (F.col("_call") > 0)).withColumn("pnl", F.when(F.col("_call") == 1, F.col("ret")).otherwise(-F.col("ret")) - cost)
    by = trades.groupBy("session").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"), F.max(F.col("tagged").cast("int")).alias("tagged"))
    best = F.max_by("n", "pnl")
    money = by.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("trades"), (F.sum("pnl") / F.sum("n")).alias("expectancy"),
        ((F.sum("pnl") - F.max("pnl")) / F.nullif(F.sum("n") - best, F.lit(0))).alias("without_best"),
        (F.sum(F.when(F.col("tagged") == 0, F.col("pnl"))) / F.nullif(F.sum(F.when(F.col("tagged") == 0, F.col("n"))), F.lit(0))).alias("without_tagged"),
    )
    areas = None
    for k in (1, 2):
        a = rank_auc(rows.select(F.col(p[k]).alias("s"), (F.col("label") == k).alias("y")), "s", "y").select(F.col("auc").alias(f"auc_{k}"))
        areas = a if areas is None else areas.join(a)  # one row each
    scores = brier(rows, p, "label").join(brier(rows, ["train_p0", "train_p1", "train_p2"], "label").select(F.col("brier").alias("base_brier")))
    out = money.join(areas).join(scores).withColumn("auc", (F.col("auc_1") + F.col("auc_2")) / 2)
    ok = (F.col("sessions") >= least_sessions) & (F.col("auc") >= least_auc) & (F.col("brier") <= (1 - least_gain) * F.col("base_brier")) & (F.col("without_best") > 0) & (F.col("without_tagged") > 0)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def top_share(rows: DataFrame, scores: Sequence[str], move: str, at: float = 0.9, slack: float = 0.0) -> DataFrame:
    """One row: top_rows, the rows whose largest score reaches the quantile ``at`` of it less ``slack``; move_top and
    move_all, the median absolute move of those and of all rows; calm, whether move_top is at most the larger of move_all and 1.

    Nulls and NaN are left out of the largest score, the quantile and the medians. Quantiles interpolate.
    """
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    best = F.greatest(*map(clean, scores)) if len(scores) > 1 else clean(scores[0])
    rows = rows.select(best.alias("_best"), F.abs(clean(move)).alias("_move"))
    top = F.col("_best") >= rows.agg(F.percentile("_best", F.lit(at)) - slack).scalar()
    out = rows.agg(F.count(F.when(top, 1)).alias("top_rows"), F.percentile(F.when(top, F.col("_move")), F.lit(0.5)).alias("move_top"), F.percentile("_move", F.lit(0.5)).alias("move_all"))
    return out.withColumn("calm", F.col("move_top") <= F.greatest("move_all", F.lit(1.0)))


def thin_clock(rows: DataFrame, most: int, session: str = "session", order: Sequence[str] = ("ts",)) -> DataFrame:
    """All event samples, and clock samples of each session by a stride that leaves at most ``most`` of them."""
    clock = rows.where(F.col("trigger") == "clock")
    n = F.count(F.lit(1)).over(Window.partitionBy(session))
    k = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    kept = clock.withColumns({"_n": n, "_k": k}).where(F.col("_k") % F.ceil(F.col("_n") / most) == 0).drop("_n", "_k")
    return rows.where(F.col("trigger") != "clock").unionByName(kept)


def directional(rows: DataFrame, direction: str, trainable: str) -> DataFrame:
    """Trainable rows with a direction, narrowed to small types."""
    return rows.where((F.col(trainable) == 1) & (F.col(direction) != 0)).withColumn(direction, F.col(direction).cast("tinyint"))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def robust_fit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with med_c and scale_c: the median; the median absolute deviation, else the mean one, else 1. NaN counts as null."""
    clean = rows.select(*(F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in columns))
    med = clean.agg(*(F.percentile(c, F.lit(0.5)).alias(f"med_{c}") for c in columns))
    dev = clean.join(F.broadcast(med)).select(*(F.abs(F.col(c) - F.col(f"med_{c}")).alias(c) for c in columns))  # one row on the right
    spread = dev.agg(*(F.percentile(c, F.lit(0.5)).alias(f"mad_{c}") for c in columns), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    scale = {c: F.when(F.col(f"mad_{c}") > 1e-12, F.col(f"mad_{c}")).when(F.col(f"mean_{c}") > 1e-12, F.col(f"mean_{c}")).otherwise(1.0) for c in columns}
    return med.join(spread).select(*(F.col(f"med_{c}") for c in columns), *(x.alias(f"scale_{c}") for c, x in scale.items()))


def standardize(rows: DataFrame, fitted: DataFrame, columns: Sequence[str], limit: float = 8.0) -> DataFrame:
    """(x - median) / scale, clipped to the limit; adds ``clipped``, how many columns of a row were."""
    joined = rows.join(F.broadcast(fitted))  # one row on the right
    z = {c: (F.col(c) - F.col(f"med_{c}")) / F.col(f"scale_{c}") for c in columns}
    over = sum((F.when(F.abs(x) > limit, 1).otherwise(0) for x in z.values()), F.lit(0))
    out = joined.withColumn("clipped", over).withColumns({c: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)) for c, x in z.items()})
    return out.drop(*(f"{k}_{c}" for c in columns for k in ("med", "scale")))


def frame_to_json(fitted: DataFrame) -> str:
    """A fitted row as text, keys in order; ``frame_from_json`` gives the same row back."""
    import json

    return json.dumps(fitted.first().asDict(), sort_keys=True)


def frame_from_json(spark, text: str) -> DataFrame:
    import json

    found = json.loads(text)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{k}` double" for k in found))


def load_fold(samples: DataFrame, folds: DataFrame, fold: int, h: int, embargo: int = 600 * NANOS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, eval, audit) of a fold: trainable samples of its sessions, training rows purged against the evaluation.

    samples: session_date, ts, label_end_ts, h<h>_trainable, h<h>_uniqueness; folds: fold, role, session_date. Labels of
    training rows end before the evaluation begins. audit is one row; an evaluation without rows purges nothing.
    """
    days = folds.where(F.col("fold") == fold)
    named = lambda role: samples.where(F.col(f"h{h}_trainable") == 1).join(days.where(F.col("role") == role).select("session_date"), "session_date", "left_semi")
    train, held = named("train"), named("eval")
    start = held.agg(F.min("ts")).first()[0]
    kept = train if start is None else purge(train, start, embargo)
    far = start if start is not None else (1 << 62)
    audit = purge_audit(train, far, embargo if start is not None else 0, f"h{h}_uniqueness", f"h{h}_trainable")
    more = held.agg(F.count(F.lit(1)).alias("eval_rows"), F.coalesce(F.sum(f"h{h}_uniqueness"), F.lit(0.0)).alias("eval_effective_n"))
    dropped = days.where(F.col("role") == "embargo").agg(F.count(F.lit(1)).alias("embargo_sessions"))
    return kept, held, audit.join(more).join(dropped)  # one row each
