"""Schemas and code tables of the domain."""

from __future__ import annotations

MBO = "session_date date, seq long, ts_event long, action string, side string, price long, size long, order_id long, flags int, channel_id int, sequence long, instrument_id long"
CALENDAR = "ts_utc string, name string, tier string, source string"

# Flag bits, price units and code tables.
F_LAST, F_SNAPSHOT = 128, 32
TICK = 100_000_000
UNITS_PER_POINT = 1_000_000_000
NANOS = 1_000_000_000
FINAL_STATES = ("filled", "partial_cancelled", "cancelled", "cleared", "end_of_data", "replaced")
TIERS = ("none", "low", "medium", "high")
PHASES = ("asia", "london", "ny", "post", "maintenance")
