"""Literal record streams for tests."""

import datetime
import random

from tapeflow.schema import MBO, TICK

DAY = datetime.date(2024, 1, 16)
PX = 1_000_000_000


def record(i, ts, action, side, price, size, oid, flags=0, iid=1, day=DAY):
    return (day, i, ts, action, side, price, size, oid, flags, 0, i, iid)


def frame(spark, records):
    return spark.createDataFrame(records, MBO)


def random_stream(n, seed, instruments=2):
    """Adds, modifies, cancels, fills and clears with duplicates and unknown ids."""
    rng, out, ts = random.Random(seed), [], 1000
    for i in range(n):
        ts += rng.choice((0, 0, 500, 2_000_000))
        action = rng.choices("AMCFTR", (8, 4, 4, 2, 2, 0.1))[0]
        side = rng.choice("BA")
        price = 100 * PX + (-rng.randint(1, 6) if side == "B" else rng.randint(1, 6)) * TICK
        out.append(record(i, ts, action, side, price, rng.randint(1, 9), 0 if action in "TR" else rng.randint(1, 25), rng.choice((0, 0, 128)), 1 + rng.randrange(instruments)))
    return out
