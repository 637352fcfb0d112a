"""Folds over sorted streams whose next state depends on what was kept before: one linear pass, one state at a time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable, step: Callable, added: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` with the columns ``added`` ((name, boolean | int | long | double)), by a pass over each key's rows in order.

    start() -> state; step(state, *values of ``columns``) -> (state, values of ``added``). Keys are dealt out and sorted;
    a partition streams through, so memory holds a batch and one state, whatever the length of a stream.
    """
    kept = rows.drop(*(n for n, _ in added))
    names = [*kept.columns, *(n for n, _ in added)]
    schema = f"{kept.schema.simpleString()[7:-1]}," + ",".join(f"{n}:{'bigint' if t == 'long' else t}" for n, t in added)
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            out: list[tuple] = []
            for values in zip(*(b.column(c).to_pylist() for c in (*keys, *columns))):
                if at != values[:k]:
                    at, state = values[:k], start()
                state, found = step(state, *values[k:])
                out.append(found)
            made = [pa.array([x[i] for x in out], type=_ARROW[t]) for i, (_, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Ranks:
    """Values of the last ``span`` units in order of time and of size: mid-ranks by bisection, no window is sorted twice."""

    def __init__(self, span: int):
        self.span, self.times, self.sizes = span, deque(), []

    def rank(self, u: int, v: float | None) -> float | None:
        """The share of earlier values within the span below ``v``, equal ones half; null without any, or for a null."""
        while self.times and self.times[0][0] < u - self.span:
            del self.sizes[bisect_left(self.sizes, self.times.popleft()[1])]
        if v is None or not self.sizes:
            return None
        return (bisect_left(self.sizes, v) + bisect_right(self.sizes, v)) / 2 / len(self.sizes)

    def push(self, u: int, v: float | None) -> None:
        if v is not None:
            self.times.append((u, v))
            insort(self.sizes, v)
