"""Quality rules: base counts of a text, then robust multivariate outliers by minimum covariance determinant. Native only.

Estimation. Rows that pass the base rule give a vector of six transformed shares. Per language and source (a cell) a
minimum-covariance-determinant estimate is found from three deterministic starts (medians with quartile scales; the
classical mean and covariance; mean and covariance of the rows inside a box around the medians) by concentration steps:
distances under the present estimate, the nearest ``H_SHARE`` of the cell, mean and covariance of those; again until no
determinant changes any more. The start with the smallest determinant wins. The order statistic of a step comes from a
histogram of log distances, so a step is one aggregation with map-side combine whose result has at most cells x 3 x
``BINS`` rows, whatever the size of a cell.

A cell of fewer than ``least_cell`` rows can't carry 6 means and 21 covariances. Its rows are judged by the estimate of
all rows of their language, and where the language has fewer, by that of all rows; so every row that passes the base
rule is judged, in a table of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeflow.llm.common import Scratch, fresh

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50
VECTOR = ("x_word", "x_symbol", "x_mark", "x_upper", "x_lines", "x_repeat")
P = len(VECTOR)
#: Squares of these are added to the variances of the coordinates: a ridge, so that cells whose rows are all alike in a
#: coordinate (no symbols, no repeated lines) don't reject the first row that differs a little.
FLOOR = (0.06, 0.03, 0.05, 0.05, 0.12, 0.13)
#: Grid of the coordinates: sums of products of whole numbers don't depend on the order of rows. Starts use a coarser one.
GRID, COARSE = 1 << 12, 1 << 5
H_SHARE, BINS, PER_OCTAVE = 0.75, 1920, 64
#: Rows of a cell that has an estimate of its own: five for each coordinate.
LEAST_CELL = 5 * P
#: Concentration steps at most, and the change of a log determinant below which one has settled.
STEPS, SETTLED = 10, 1e-2
#: Share of rows beyond the cut-off if a cell's clean rows were normal: one of a thousand million.
REJECTED = 1e-9


def chi2_cdf(x: float, df: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


#: Makes the covariance of the nearest ``H_SHARE`` consistent for normal data.
CONSISTENCY = H_SHARE / chi2_cdf(chi2_quantile(H_SHARE, P), P + 2)
MEDIAN = chi2_quantile(0.5, P)
#: A squared distance beyond it rejects, times the cell's median squared distance over ``MEDIAN`` where that is more than 1:
#: cells whose clean rows spread more than normal ones get a wider cut.
CUTOFF = chi2_quantile(1 - REJECTED, P)


def _length(x: Column) -> Column:
    return F.char_length(x).cast("bigint")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the counts behind the vector.

    A null text counts as an empty one: all counts 0, base_failed. Other columns stay; its columns of the added names
    are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_lines", "base_failed")
    docs = docs.drop(*added)
    t, w, n, h, mask, p, lines = fresh(docs, "t", "w", "n", "h", "mask", "p", "lines")
    docs = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(w, F.array_remove(F.split(t, f"{SPACE}+"), ""))
    docs = docs.withColumn(n, F.size(w))
    # A window is hashed; the low bits of the hash give way to its position, so one primitive sort brings equal ones together.
    bits = f"cast(ceil(log2({n} + 1)) as int)"
    window = f"(xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2)) & shiftleft(-1L, {bits})) | cast(i as bigint)"
    docs = docs.withColumn(h, F.expr(f"case when {n} >= 4 then sort_array(transform(sequence(0, {n} - 3), i -> {window})) else array() end").cast("array<bigint>"))
    docs = docs.withColumn(mask, F.expr(f"shiftleft(1L, {bits}) - 1L"))
    place = lambda x: f"cast({x} & {mask} as int)"
    equal = lambda y: f"(x & ~{mask}) = ({y} & ~{mask}) and " + " and ".join(f"get({w}, {place('x')} + {k}) = get({w}, {place(y)} + {k})" for k in range(3))
    twice = f"filter({h}, (x, i) -> coalesce({equal(f'get({h}, i + 1)')}, false) or (i > 0 and coalesce({equal(f'get({h}, i - 1)')}, false)))"
    docs = docs.withColumn(p, F.expr(f"sort_array(transform({twice}, x -> {place('x')}))"))
    covered = f"aggregate({p}, named_struct('last', -3, 'sum', 0L), (a, q) -> named_struct('last', q, 'sum', a.sum + least(3, q - a.last)), a -> a.sum)"
    docs = docs.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumns(
        {
            "n_words": F.col(n).cast("bigint"),
            "word_chars": _length(F.array_join(w, "")),
            "n_symbols": _length(t) - _length(F.regexp_replace(t, SYMBOLS, "")),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": F.expr(f"case when size({p}) = 0 then 0L else {covered} end"),
            "n_marks": _length(t) - _length(F.regexp_replace(t, r"[!?;:=_~^|{}\[\]()]", "")),
            "n_upper": _length(t) - _length(F.regexp_replace(t, r"\p{Lu}", "")),
            "n_lines": F.size(lines).cast("bigint"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop(t, w, n, h, mask, p, lines)


def _vector() -> list[Column]:
    """The transformed statistics on the grid, as whole numbers in doubles."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_marks", "word_chars"), share("n_upper", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.floor(x * GRID + 0.5).cast("double").alias(n) for x, n in zip(raw, VECTOR)]


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    sums = [f"sum({VECTOR[i]}) as s{i}" for i in range(P)] + [f"sum({VECTOR[i]} * {VECTOR[j]}) as q{i}_{j}" for i, j in PAIRS]
    return [F.expr(x) for x in ("cast(count(1) as double) as n", *sums)]


def _estimate(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """keys, n, det, mean and the inverse of the covariance's Cholesky factor, from sums, with the ridge of ``FLOOR``."""
    ridge = lambda i, j: (FLOOR[i] * GRID) ** 2 if i == j else 0.0
    means = [f"s{i} / n as m{i}" for i in range(P)]
    return _factored(moments.selectExpr(*keys, "n", *means, *(f"(q{i}_{j} / n - m{i} * m{j}) * {scale!r}D + {ridge(i, j)!r}D as c{i}_{j}" for i, j in PAIRS)), keys)


def _factored(out: DataFrame, keys: list[str]) -> DataFrame:
    """From m*, c*: one projection whose later columns use the earlier ones."""
    steps = []
    for j in range(P):
        inner = lambda i, j: "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        steps.append(f"sqrt(greatest(c{j}_{j}{inner(j, j)}, {(FLOOR[j] * GRID) ** 2 / 4!r}D)) as l{j}_{j}")
        steps += [f"(c{i}_{j}{inner(i, j)}) / l{j}_{j} as l{i}_{j}" for i in range(j + 1, P)]
    for j in range(P):
        steps.append(f"1D / l{j}_{j} as w{j}_{j}")
        steps += [f"-({' + '.join(f'l{i}_{k} * w{k}_{j}' for k in range(j, i))}) / l{i}_{i} as w{i}_{j}" for i in range(j + 1, P)]
    det = " + ".join(f"ln(l{i}_{i})" for i in range(P))
    return out.selectExpr("*", *steps).selectExpr(*keys, "n", f"{det} as det", *(f"m{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in PAIRS))


def _distance(vector: str = "", model: str = "") -> Column:
    """The squared distance; vector and model: prefixes of the columns, ``name.`` for fields of a struct."""
    x = [f"({vector}{v} - {model}m{i})" for i, v in enumerate(VECTOR)]
    z = ["(" + " + ".join(f"{model}w{i}_{j} * {x[j]}" for j in range(i + 1)) + ")" for i in range(P)]
    return F.expr(" + ".join(f"{v} * {v}" for v in z))


def _bin() -> Column:
    return F.least(F.greatest(F.floor(F.log2(_distance() + 2.0**-8) * PER_OCTAVE) + 8 * PER_OCTAVE, F.lit(0)), F.lit(BINS - 1)).alias("bin")


def _key(column: str) -> Column:
    """Null languages and sources are values of their own; no name can clash with the pooled cells."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def _cells(rows: DataFrame, least_cell: int) -> DataFrame:
    """(_lang, _source) -> judge, the cell whose estimate judges, and feeds, the cells that its rows belong to."""
    counts = rows.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    language = counts.groupBy("_lang").agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    language = language.withColumns({"pooled": (F.col("least") < least_cell) & (F.col("all") >= least_cell), "rare": F.col("all") < least_cell})
    any_rare = bool(language.agg(F.max("rare")).first()[0])
    own, pool = F.concat_ws("\t", "_lang", "_source"), F.concat_ws("\t", "_lang", F.lit("*"))
    full = F.col("n") >= least_cell
    judge = F.when(full, own).when(F.col("pooled"), pool).otherwise("*")
    feeds = F.array_compact(F.array(F.when(full, own), F.when(F.col("pooled"), pool), F.lit("*") if any_rare else F.lit(None).cast("string")))
    return counts.join(language.select("_lang", "pooled"), "_lang").select("_lang", "_source", judge.alias("judge"), feeds.alias("feeds"))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """cell, start, n, det, m*, w*: three first estimates of each cell."""
    # Quartiles of each coordinate on the coarse grid, from counts: a bounded table, whatever the size of a cell.
    each = rows.select("cell", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(v) / COARSE).alias("v")) for i, v in enumerate(VECTOR)))).alias("x"))
    counts = scratch.cut(each.groupBy("cell", "x.i", "x.v").agg(F.count(F.lit(1)).alias("c")))
    whole = Window.partitionBy("cell", "i")
    upto = counts.withColumns({"upto": F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("c").over(whole)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, (F.col("v") + 0.5) * COARSE))
    box = upto.groupBy("cell", "i").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("range"))
    box = box.groupBy("cell").agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c in ("mid", "range")))
    box = scratch.cut(box)
    scratch.drop(counts)
    spread = [F.pow(F.col(f"range{i}") / 1.349, F.lit(2.0)) + (FLOOR[i] * GRID) ** 2 for i in range(P)]
    inside = F.lit(True)
    for i, v in enumerate(VECTOR):
        inside = inside & (F.pow(F.col(v) - F.col(f"mid{i}"), F.lit(2.0)) <= 9 * spread[i])
    keys = ["cell", "start"]
    medians = box.select("cell", F.lit(0).alias("start"), F.lit(0.0).alias("n"), *(F.col(f"mid{i}").alias(f"m{i}") for i in range(P)), *((spread[i] if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS))
    classical = _estimate(rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit(1)), keys, 1.0)
    boxed = _estimate(rows.join(box, "cell").where(inside).groupBy("cell").agg(*_moments()).withColumn("start", F.lit(2)), keys, 1.0)
    return scratch.cut(_factored(medians, keys).unionByName(classical).unionByName(boxed))


def fit(stats: DataFrame, scratch: Scratch, least_cell: int = LEAST_CELL) -> DataFrame:
    """stats: rows of ``with_stats`` with lang and source -> (_lang, _source, det, m*, w*, cut), for ``judge``.

    Every language and source with a row that passes the base rule has an estimate: its own from ``least_cell`` rows on,
    else its language's, else that of all rows. An empty table gives an empty model.
    """
    rows = stats.where(~F.col("base_failed")).select(_key("lang").alias("_lang"), _key("source").alias("_source"), *_vector())
    cells = scratch.cut(_cells(rows, least_cell))
    rows = scratch.cut(rows.join(cells, ["_lang", "_source"]).select(F.explode("feeds").alias("cell"), *VECTOR))
    keys, sums = ["cell", "start"], ["n", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)]
    sizes = scratch.cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")))
    model = _starts(rows, scratch)
    for _ in range(STEPS):
        # The histogram is written before the windows run over it: a cell's rows meet there as BINS rows at most.
        binned = scratch.cut(rows.join(model, "cell").select(*keys, _bin(), *VECTOR).groupBy(*keys, "bin").agg(*_moments()))
        order = Window.partitionBy(*keys).orderBy("bin")
        run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = binned.select(*keys, "bin", *(F.sum(c).over(run).alias(c) for c in sums)).join(sizes, "cell")
        enough = total.where(F.col("n") >= F.ceil(F.col("size") * H_SHARE)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
        nxt = scratch.cut(_estimate(enough, keys, CONSISTENCY).join(model.select(*keys, F.col("det").alias("was")), keys))
        change = nxt.agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        scratch.drop(model), scratch.drop(binned)
        model = nxt.drop("was")
        if change is None or change < SETTLED:
            break
    best = model.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("det", "start"))).where("_r = 1").drop("_r", "start", "n")
    best = scratch.cut(best)
    counts = scratch.cut(rows.join(best, "cell").select("cell", _bin()).groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("c")))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(sizes, "cell")
    middle = upto.where(F.col("upto") >= F.col("size") / 2).groupBy("cell").agg(F.min("bin").alias("bin"))
    median = F.pow(F.lit(2.0), (F.col("bin") + 0.5 - 8 * PER_OCTAVE) / PER_OCTAVE) - 2.0**-8
    cut = middle.select(F.col("cell").alias("judge"), (CUTOFF * F.greatest(F.lit(1.0), median / MEDIAN)).alias("cut"))
    out = scratch.cut(cells.drop("feeds").join(best.withColumnRenamed("cell", "judge"), "judge").join(cut, "judge").drop("judge"))
    for t in (rows, model, sizes, best, counts, cells):
        scratch.drop(t)
    return out


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Adds distance2 (null where base_failed) and kept to rows of ``with_stats``; all other columns stay.

    kept is false where base_failed, else the squared Mahalanobis distance decides; without an estimate (a model of other
    rows) it is true. Columns named like an added one are replaced.
    """
    own = [c for c in stats.columns if c not in ("distance2", "kept")]
    lang, source, vector, fitted = fresh(stats, "lang_key", "source_key", "vector", "fitted")
    side = model.select(F.col("_lang").alias(lang), F.col("_source").alias(source), F.struct(*(c for c in model.columns if c not in ("_lang", "_source"))).alias(fitted))
    joined = stats.select(*own, _key("lang").alias(lang), _key("source").alias(source), F.struct(*_vector()).alias(vector)).join(side, [lang, source], "left")
    far = F.when(~F.col("base_failed"), _distance(f"{vector}.", f"{fitted}."))
    kept = ~F.col("base_failed") & F.coalesce(far <= F.col(f"{fitted}.cut"), F.lit(True))
    return joined.select(*own, far.alias("distance2"), kept.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, lang, source, the counts, base_failed, distance2, kept. Repeated rows stay.

    The counts of all texts are made once and written to the shared folder; everything after reads that narrow table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.cut(with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(stats, fit(stats, scratch))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; the model is fitted on all of ``docs``.

    Documents and their counts are written to the shared folder once: the counts are too dear to make twice, and a join
    by id would not do, as ids may repeat or be null.
    """
    scratch = Scratch(docs.sparkSession, "quality-stage")
    body = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "lang", "source")
    stats = scratch.cut(with_stats(body).drop("text"))
    return judge(stats, fit(stats, scratch)).where("kept").select("_doc.*")
