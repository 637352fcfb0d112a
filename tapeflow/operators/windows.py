"""Past-only rolling primitives over (keys, ts, seq).

A horizon h at a row covers times in (ts - h, ts] and only rows at or before it in ``seq``. Rows may share a time, and a
range frame that ends at the current row would take in later rows of that time; so a rolling aggregate combines the
strictly earlier times (a range frame that ends one before) with the peers so far (a row frame inside the time).
All primitives over one key plan as two sorts of one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Clock:
    """Keys of a stream, its time (whole numbers) and its order."""

    keys: Sequence[str]
    ts: str = "ts"
    seq: str = "seq"

    def before(self, h: int) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts).rangeBetween(-(h - 1), -1)

    def peers(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, self.ts).orderBy(self.seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts, self.seq)

    def so_far(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(self, n: int) -> WindowSpec:
        return self.rows().rowsBetween(-(n - 1), Window.currentRow)


def rolling_sum(c: Clock, v: Column, h: int) -> Column:
    """0 where nothing is in the window; nulls count nothing."""
    return F.coalesce(F.sum(v).over(c.before(h)), F.lit(0)) + F.coalesce(F.sum(v).over(c.peers()), F.lit(0))


def rolling_count(c: Clock, v: Column, h: int) -> Column:
    return F.count(v).over(c.before(h)) + F.count(v).over(c.peers())


def rolling_mean(c: Clock, v: Column, h: int) -> Column:
    """Row-weighted; null for an empty window."""
    n = rolling_count(c, v, h)
    return F.when(n > 0, rolling_sum(c, v, h) / n)


def rolling_min(c: Clock, v: Column, h: int) -> Column:
    return F.least(F.min(v).over(c.before(h)), F.min(v).over(c.peers()))


def rolling_max(c: Clock, v: Column, h: int) -> Column:
    return F.greatest(F.max(v).over(c.before(h)), F.max(v).over(c.peers()))


def past_value(c: Clock, v: Column, h: int) -> Column:
    """The newest value at least h old; null if there is none. A null value is skipped."""
    w = Window.partitionBy(*c.keys).orderBy(c.ts).rangeBetween(Window.unboundedPreceding, -h)
    return F.max_by(v, F.when(v.isNotNull(), F.col(c.seq))).over(w)


def rolling_median(c: Clock, v: Column, n: int) -> Column:
    """Exact median of the last n samples, the current one included."""
    return F.percentile(v, F.lit(0.5)).over(c.last(n))


def mid_rank(c: Clock, v: Column, n: int) -> Column:
    """Share of the n samples before this one below it, ties half; null without samples."""
    past = F.collect_list(v).over(c.rows().rowsBetween(-n, -1))
    low = F.aggregate(past, F.lit(0), lambda a, x: a + F.when(x < v, 2).when(x == v, 1).otherwise(0))
    return F.when(F.size(past) > 0, low / 2 / F.size(past))


def running_extreme(c: Clock, v: Column, since: Column, largest: bool = True) -> Column:
    """The extreme of ``v`` over rows so far at or after the time ``since``: for segments that open at chosen rows."""
    w = Window.partitionBy(*c.keys, since).orderBy(c.ts, c.seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.max if largest else F.min)(v).over(w)


def ring(c: Clock, v: Column, n: int, pad) -> Column:
    """The last n values, the oldest first, padded on the left."""
    held = F.collect_list(v).over(c.last(n))
    return F.concat(F.array_repeat(pad, F.lit(n) - F.size(held)), held)


def carried(c: Clock, v: Column) -> Column:
    """The newest value that isn't null so far."""
    return F.last(v, ignorenulls=True).over(c.so_far())
