"""The streaming twin of the batch replay: the same kernel, its state kept for each session of the feed.

A session is the unit of order, so it is the key: groups span instruments and are numbered inside the state. Rows of a
trigger are sorted by seq. State ends with the session: at its end mark, or, where a feed may lose that, after a timeout.
Records that come after the end begin a new state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeflow.operators.kernel import FLOW, LIFECYCLE, Instrument, Settings
from tapeflow.schema import F_LAST


class Feed:
    """Groups and instruments of one session; ``feed`` takes records in order."""

    def __init__(self, settings: Settings = Settings()):
        self.settings, self.group, self.last = settings, 0, None
        self.engines: dict[int, Instrument] = {}

    def feed(self, r: dict) -> None:
        if self.last is None or self.last[0] != r["ts_event"] or self.last[1] & F_LAST:
            self.group += 1
        self.last = (r["ts_event"], r["flags"])
        engine = self.engines.get(r["instrument_id"])
        if engine is None:
            engine = self.engines[r["instrument_id"]] = Instrument(r["instrument_id"], self.settings)
        engine.feed(r | {"group_id": self.group})

    def take(self, what: str) -> list[dict]:
        out = []
        for i in sorted(self.engines):
            engine = self.engines[i]
            out += getattr(engine, what)
            engine.lifecycle.clear()
            engine.flow.clear()
        return out

    def finish(self) -> None:
        for i in sorted(self.engines):
            self.engines[i].finish()


def _streamed(what: str, fields: list[str], settings: Settings, timeout_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed: Feed = pickle.loads(state.get[0]) if state.exists else Feed(settings)
        done = state.hasTimedOut
        parts = [] if done else [f for f in frames if len(f)]
        if parts:
            for r in pd.concat(parts).sort_values("seq").to_dict("records"):
                if r["action"] == "E":  # an end mark closes the session
                    done = True
                    continue
                feed.feed(r)
        if done:
            feed.finish()
        out = feed.take(what)
        if done:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(feed),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        frame = pd.DataFrame(out, columns=fields[1:])
        frame.insert(0, fields[0], key[0])
        yield frame

    return run


def stream(mbo: DataFrame, what: str = "flow", settings: Settings = Settings(), timeout_ms: int | None = None) -> DataFrame:
    """A streaming frame of records -> streaming frame of flow or lifecycle rows, as ``replay`` gives in batch.

    A record with action ``E`` ends a session: the open group and resting orders are flushed and the state goes. With
    ``timeout_ms`` a session without records for so long ends as well.
    """
    schema = f"session_date date, {FLOW if what == 'flow' else LIFECYCLE}"
    fields = [x.split()[0] for x in schema.split(", ")]
    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return mbo.groupBy("session_date").applyInPandasWithState(_streamed(what, fields, settings, timeout_ms), schema, "state binary", "append", kind)
