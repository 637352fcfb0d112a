"""The stateful pass over one instrument's records: order book, order lifecycles, queue positions and flow rows.

One pure class serves batch (grouped map over sessions and instruments) and stream (state per key). It is fed records in
order, with the feed-wide group they belong to; a group ends when the next one begins or at ``finish``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, OrderedDict
from dataclasses import dataclass, field

from tapeflow.schema import F_SNAPSHOT, TICK

LEVELS = 10
SIDES = ("B", "A")


@dataclass
class Order:
    oid: int
    side: str
    price: int
    size: int
    ts: int
    first_price: int
    first_size: int
    snapshot: bool
    unknown: bool
    queue_pos: int
    ahead: int
    dist_add: int | None
    segment: int
    touch: int | None = None
    prevailing: int | None = None
    top_size: int = 0
    filled: int = 0
    cancelled: int = 0
    unapplied: int = 0
    fill_ts: int = -1
    ups: int = 0
    downs: int = 0
    moves: int = 0
    mid2_add: int | None = None
    chain: int = 0  # the order id of the chain's root
    chain_index: int = 0
    confidence: float = 0.0
    link_dt: int = 0


@dataclass
class Side:
    """Levels by price; each a queue of order ids in priority order with a running size."""

    name: str
    levels: dict[int, OrderedDict] = field(default_factory=dict)
    sizes: Counter = field(default_factory=Counter)
    keys: list[int] = field(default_factory=list)  # best last

    def key(self, price: int) -> int:
        return price if self.name == "B" else -price

    def best(self) -> int | None:
        return None if not self.keys else (self.keys[-1] if self.name == "B" else -self.keys[-1])

    def join(self, o: Order) -> tuple[int, int]:
        """Puts an order behind its level's queue: orders and volume ahead."""
        level = self.levels.get(o.price)
        if level is None:
            level = self.levels[o.price] = OrderedDict()
            insort(self.keys, self.key(o.price))
        ahead = (len(level), self.sizes[o.price])
        level[o.oid] = o
        self.sizes[o.price] += o.size
        return ahead

    def leave(self, o: Order) -> None:
        level = self.levels[o.price]
        del level[o.oid]
        self.sizes[o.price] -= o.size
        if not level:
            del self.levels[o.price], self.sizes[o.price]
            del self.keys[bisect_left(self.keys, self.key(o.price))]

    def top(self, n: int = LEVELS) -> list[tuple[int, int, int]]:
        return [(p, self.sizes[p], len(self.levels[p])) for p in (k if self.name == "B" else -k for k in reversed(self.keys[-n:]))]


@dataclass(frozen=True)
class Settings:
    near: int = 3 * TICK
    refill_ns: int = 2_000_000
    refill_tolerance: float = 1.0
    incidents: int = 1000


class Instrument:
    """State of one instrument; ``lifecycle`` and ``flow`` collect output rows until they are taken."""

    def __init__(self, instrument_id: int, settings: Settings = Settings()):
        self.iid, self.set = instrument_id, settings
        self.orders: dict[int, Order] = {}
        self.side = {s: Side(s) for s in SIDES}
        self.counts: Counter = Counter()
        self.incidents: list[tuple[str, int, int]] = []
        self.lifecycle: list[dict] = []
        self.flow: list[dict] = []
        self.slots: dict[tuple[str, int], tuple[int, int, int, int]] = {}  # time, root, index and clip of the last filled order
        self.last_top: dict[str, list] = {s: [] for s in SIDES}
        self.group: int | None = None
        self.acc: Counter | None = None
        self.touched = False
        self.ts = self.seq = 0
        self.extremes: dict[str, list[tuple[int, int]]] = {s: [] for s in SIDES}
        self.last_best: dict[str, int | None] = {s: None for s in SIDES}

    # -- groups ---------------------------------------------------------------------------------------------------

    def feed(self, r: dict) -> None:
        self.step(r["group_id"], r["ts_event"], r["action"], r["side"], r["price"], r["size"], r["order_id"], r["flags"], r.get("seq", 0))

    def step(self, group: int, ts: int, action: str, side: str, price: int, size: int, oid: int, flags: int, seq: int = 0) -> None:
        if group != self.group:
            self.end_group()
            self.group, self.acc, self.touched = group, Counter(), False
        self.ts, self.seq = ts, seq
        self.counts[action] += 1
        if action == "A":
            self.add(side, price, size, oid, flags)
        elif action == "C":
            self.cancel(size, oid)
        elif action == "M":
            self.modify(side, price, size, oid, flags)
        elif action == "T":
            self.trade(side, price, size)
        elif action == "F":
            self.fill(size, oid)
        elif action == "R":
            self.clear()
        else:
            self.counts["others"] += 1

    def incident(self, kind: str, oid: int) -> None:
        self.counts[f"incident_{kind}"] += 1
        if len(self.incidents) < self.set.incidents:
            self.incidents.append((kind, oid, self.seq))

    def end_group(self) -> None:
        if self.acc is None:
            return
        bid, ask = self.side["B"].best(), self.side["A"].best()
        if bid is not None and ask is not None and bid >= ask:
            self.incident("crossed", 0)
        if self.touched:
            self.emit_flow()
        self.acc = None

    def finish(self) -> None:
        """Ends the open group and every resting order, by id; once."""
        self.end_group()
        for oid in sorted(self.orders):
            self.remove(self.orders[oid], "end_of_data")

    # -- records --------------------------------------------------------------------------------------------------

    def note_best(self) -> None:
        """Keeps, for each side, the best's suffix extremes by time: for bids ever higher minima, for asks ever lower maxima."""
        for s in SIDES:
            b = self.side[s].best()
            if b is None or b == self.last_best[s]:
                self.last_best[s] = b
                continue
            self.last_best[s] = b
            stack, sign = self.extremes[s], 1 if s == "B" else -1
            while stack and sign * stack[-1][1] >= sign * b:
                stack.pop()
            stack.append((self.ts, b))

    def distance(self, side: str, price: int, best: int | None) -> int | None:
        return None if best is None else (best - price if side == "B" else price - best)

    def mid2(self, side: str, price: int) -> int | None:
        """Twice the distance to the mid, a whole number; None unless both sides rest."""
        bid, ask = self.side["B"].best(), self.side["A"].best()
        if bid is None or ask is None:
            return None
        return bid + ask - 2 * price if side == "B" else 2 * price - bid - ask

    def approach(self, o: Order) -> int | None:
        """Closest distance of the same-side best since the order's segment began, changes at that very time included."""
        stack = self.extremes[o.side]
        at = bisect_left(stack, o.segment, key=lambda x: x[0])
        found = [self.distance(o.side, o.price, o.prevailing), o.touch]
        if at < len(stack):
            found.append(self.distance(o.side, o.price, stack[at][1]))
        return min([d for d in found if d is not None], default=None)

    def add(self, side: str, price: int, size: int, oid: int, flags: int, unknown: bool = False) -> None:
        if side not in SIDES:
            self.incident("bad_side", oid)
            return
        if oid in self.orders:
            self.incident("duplicate_add", oid)
            self.remove(self.orders[oid], "replaced")
        o = Order(oid, side, price, size, self.ts, price, size, bool(flags & F_SNAPSHOT), unknown, 0, 0, None, self.ts, top_size=size)
        if not o.snapshot:
            self.link(o)
        o.queue_pos, o.ahead = self.side[side].join(o)
        self.orders[oid] = o
        best = self.side[side].best()
        o.dist_add, o.mid2_add, o.prevailing = self.distance(side, price, best), self.mid2(side, price), best
        self.note_best()
        self.touched = True
        self.band("add", side, o.dist_add, size)

    def band(self, what: str, side: str, dist: int | None, size: int) -> None:
        if dist is None:
            return
        x = side.lower()
        if dist <= 0:
            self.acc[f"{what}_best_{x}"] += size
        if dist <= self.set.near:
            self.acc[f"{what}_near_{x}"] += size

    def link(self, o: Order) -> None:
        """Joins an add to the chain of an order filled just before at the same place: a likely iceberg refill."""
        slot = self.slots.get((o.side, o.price))
        if slot is None:
            return
        at, root, index, clip = slot
        dt = self.ts - at
        if dt > self.set.refill_ns:
            del self.slots[(o.side, o.price)]
            return
        if o.size > self.set.refill_tolerance * clip:
            return
        del self.slots[(o.side, o.price)]
        o.chain, o.chain_index, o.link_dt = root, index + 1, dt
        like = 1.0 if o.size == clip else 0.75 if o.size < clip else 0.5
        o.confidence = (1 - 0.5 * dt / self.set.refill_ns) * like
        x = o.side.lower()
        self.acc[f"refill_{x}"] += 1
        self.acc["refill_conf_sum"] += o.confidence
        self.counts["refill_links"] += 1

    def cancel(self, size: int, oid: int) -> None:
        o = self.orders.get(oid)
        if o is None:
            self.incident("unknown_cancel", oid)
            return
        if size and size != o.size:
            self.incident("size_mismatch", o.oid)
        filled = o.fill_ts == self.ts
        self.counts["fill_removals" if filled else "pulled"] += 1
        self.touched = True
        if not filled:
            self.band("pull", o.side, self.distance(o.side, o.price, self.side[o.side].best()), o.size)
        life, touch = self.ts - o.ts, self.approach(o)
        kind = "filled" if filled else "pulled"
        near = "filled" if filled else "pulled_touched" if o.filled > 0 or (touch is not None and touch <= 0) else "pulled_untouched"
        self.acc[f"term_{near}"] += 1
        self.acc[f"life_{kind}_sum"] += life
        if not o.chain_index:
            self.acc[f"term_{kind}_unchained"] += 1
            self.acc[f"life_{kind}_unchained_sum"] += life
        elif filled:
            self.acc["term_filled_refill"] += 1
        if filled:
            o.chain = o.chain or o.oid
            self.slots[(o.side, o.price)] = (self.ts, o.chain, o.chain_index, o.first_size)
            self.counts["refill_slots"] += 1
        else:
            o.cancelled += o.size
        self.remove(o, "filled" if filled else "partial_cancelled" if o.filled else "cancelled")

    def remove(self, o: Order, state: str) -> None:
        level = self.side[o.side].levels[o.price]
        pos = next(i for i, k in enumerate(level) if k == o.oid)
        touch, dist, mid2 = self.approach(o), self.distance(o.side, o.price, self.side[o.side].best()), self.mid2(o.side, o.price)
        self.counts["terminations"] += 1
        self.counts["filled_volume"] += o.filled
        self.side[o.side].leave(o)
        del self.orders[o.oid]
        self.note_best()
        self.lifecycle.append(
            {
                "instrument_id": self.iid, "order_id": o.oid, "side": o.side, "price_at_add": o.first_price, "price_final": o.price, "ts_added": o.ts, "ts_terminated": self.ts,
                "from_snapshot": o.snapshot, "entered_unknown_modify": o.unknown, "initial_size": o.first_size, "max_size": o.top_size, "final_size": o.size, "filled_size": o.filled, "cancelled_size": o.cancelled,
                "n_size_increases": o.ups, "n_size_decreases": o.downs, "n_price_changes": o.moves, "final_state": state, "queue_pos_at_add": o.queue_pos, "vol_ahead_at_add": o.ahead, "queue_pos_at_term": pos,
                "dist_same_at_add": o.dist_add, "dist_same_at_term": dist, "dist_mid2_at_add": o.mid2_add, "dist_mid2_at_term": mid2, "min_dist_same": touch, "chain_id": o.chain, "chain_index": o.chain_index, "link_confidence": o.confidence, "link_dt_ns": o.link_dt,
            }
        )

    def modify(self, named: str, price: int, size: int, oid: int, flags: int) -> None:
        o = self.orders.get(oid)
        if o is None:
            self.incident("unknown_modify", oid)
            self.add(named, price, size, oid, flags, unknown=True)
            return
        side = self.side[o.side]  # the stored side counts, whatever the record names
        if size > o.size:
            o.ups += 1
        elif size < o.size:
            o.downs += 1
            if o.fill_ts != self.ts:
                o.cancelled += o.size - size
        if price != o.price:
            o.touch = self.approach(o)
            side.leave(o)
            o.moves += 1
            o.price, o.size, o.segment = price, size, self.ts
            side.join(o)
            o.prevailing = side.best()
        elif size > o.size:
            side.leave(o)
            o.size = size
            side.join(o)
        else:
            side.sizes[price] -= o.size - size
            o.size = size
        o.unapplied, o.top_size = 0, max(o.top_size, size)
        self.note_best()

    def trade(self, side: str, price: int, size: int) -> None:
        self.touched = True
        x, a = "buy" if side == "B" else "sell", self.acc
        self.counts["t_volume"] += size
        a[f"t_{x}"] += size
        a[f"t_{x}_n"] += 1
        first = a["t_buy_n"] + a["t_sell_n"] == 1
        a["t_px_high"] = price if first else max(a["t_px_high"], price)
        a["t_px_low"] = price if first else min(a["t_px_low"], price)

    def fill(self, size: int, oid: int) -> None:
        o = self.orders.get(oid)
        if o is None:
            self.incident("unknown_fill", oid)
            self.counts["f_volume_unattributed"] += size
            return
        self.touched = True
        shown = max(0, o.size - o.unapplied)
        o.filled += size
        o.unapplied += size
        o.fill_ts = self.ts
        if o.unapplied > o.size:
            self.counts["fills_exceeding_displayed"] += 1
        x = o.side.lower()
        self.acc[f"fill_{x}"] += size
        self.acc[f"hidden_{x}"] += max(0, size - shown)

    def clear(self) -> None:
        """Ends all orders and forgets what later rows would compare with; the group goes on from nothing."""
        for oid in sorted(self.orders):
            self.remove(self.orders[oid], "cleared")
        self.slots.clear()
        self.last_top = {s: [] for s in SIDES}
        self.extremes, self.last_best = {s: [] for s in SIDES}, {s: None for s in SIDES}
        self.acc, self.touched = Counter(), False

    # -- flow -----------------------------------------------------------------------------------------------------

    def emit_flow(self) -> None:
        top = {s: self.side[s].top() for s in SIDES}
        bid, ask = (top[s][0] if top[s] else (0, 0, 0) for s in SIDES)
        row = {"instrument_id": self.iid, "group_id": self.group, "ts": self.ts, "valid": int(bool(top["B"] and top["A"]))}
        for x, q in (("bid", bid), ("ask", ask)):
            row |= {f"{x}_px": q[0], f"{x}_sz": q[1], f"{x}_ct": q[2]}
        for s in SIDES:
            x, sizes = s.lower(), [z for _, z, _ in top[s]]
            row |= {f"depth_{x}_near": sum(sizes[:3]), f"depth_{x}_mid": sum(sizes[3:6]), f"depth_{x}_deep": sum(sizes[6:])}
            row |= {f"flow_{x}_{i + 1}": v for i, v in enumerate(self.level_flow(s, top[s]))}
            level = self.side[s].levels.get(top[s][0][0]) if top[s] else None
            age = sum((self.ts - o.ts) * o.size for o in level.values()) // max(1, top[s][0][1]) if level else 0
            row[f"age_best_{x}"] = age
        row |= {k: self.acc[k] for k in ACCUMULATED}
        self.last_top = top
        self.flow.append(row)

    def level_flow(self, s: str, now: list) -> list[int]:
        """Signed depth change of each level against the last emitted row: better price adds, worse one takes away.

        All 0 where the side was empty at that row, at the start and after a clear.
        """
        old, out = self.last_top[s], []
        if not old:
            return [0] * LEVELS
        for i in range(LEVELS):
            a, b = (now[i] if i < len(now) else None), (old[i] if i < len(old) else None)
            if a is None or b is None:
                out.append((a[1] if a else 0) - (b[1] if b else 0))
            elif a[0] == b[0]:
                out.append(a[1] - b[1])
            else:
                better = a[0] > b[0] if s == "B" else a[0] < b[0]
                out.append(a[1] if better else -b[1])
        return out


ACCUMULATED = (
    "t_buy", "t_sell", "t_buy_n", "t_sell_n", "t_px_high", "t_px_low", "add_best_b", "add_near_b", "pull_best_b", "pull_near_b", "add_best_a", "add_near_a", "pull_best_a", "pull_near_a",
    "fill_b", "fill_a", "hidden_b", "hidden_a", "term_filled", "term_pulled_touched", "term_pulled_untouched", "term_filled_refill", "life_filled_sum", "life_pulled_sum", "term_filled_unchained",
    "life_filled_unchained_sum", "term_pulled_unchained", "life_pulled_unchained_sum", "refill_b", "refill_a", "refill_conf_sum",
)

LIFECYCLE = (
    "instrument_id long, order_id long, side string, price_at_add long, price_final long, ts_added long, ts_terminated long, from_snapshot boolean, entered_unknown_modify boolean, initial_size long, max_size long, "
    "final_size long, filled_size long, cancelled_size long, n_size_increases long, n_size_decreases long, n_price_changes long, final_state string, queue_pos_at_add long, vol_ahead_at_add long, queue_pos_at_term long, "
    "dist_same_at_add long, dist_same_at_term long, dist_mid2_at_add long, dist_mid2_at_term long, min_dist_same long, chain_id long, chain_index long, link_confidence double, link_dt_ns long"
)
FLOW = (
    "instrument_id long, group_id long, ts long, valid int, "
    + ", ".join(f"{x}_{n} long" for x in ("bid", "ask") for n in ("px", "sz", "ct"))
    + ", "
    + ", ".join(f"depth_{x}_{n} long" for x in "ba" for n in ("near", "mid", "deep"))
    + ", "
    + ", ".join(f"flow_{x}_{i} long" for x in "ba" for i in range(1, LEVELS + 1))
    + ", "
    + ", ".join(f"{k} {'double' if k == 'refill_conf_sum' else 'long'}" for k in ACCUMULATED)
    + ", age_best_b long, age_best_a long"
)
