import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeflow.operators import features as X
from tapeflow.operators import windows as W
from tapeflow.plans.feature_queries import FLOW, KEYS, SPEC, flow_rows

C = W.Clock(["k"])


def rows(spark, data):
    return spark.createDataFrame([(1, t, i, v) for i, (t, v) in enumerate(data)], "k int, ts long, seq long, v long")


def test_later_rows_of_the_same_time_are_no_past(spark):
    got = rows(spark, [(10, 1), (10, 5), (10, 2)]).select("seq", W.rolling_sum(C, F.col("v"), 5).alias("s")).orderBy("seq").collect()
    assert [r["s"] for r in got] == [1, 6, 8]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(-3, 9)), min_size=1, max_size=25))
def test_rolling_matches_a_stream(spark, data):
    data = sorted(data, key=lambda x: x[0])
    h = 4
    v = F.col("v")
    got = rows(spark, data).select("seq", W.rolling_sum(C, v, h).alias("s"), W.rolling_min(C, v, h).alias("m"), W.past_value(C, v, h).alias("p"), W.rolling_mean(C, v, h).alias("a"), W.mid_rank(C, v, 3).alias("r")).orderBy("seq").collect()
    for i, (t, x) in enumerate(data):
        live = [b for a, b in data[: i + 1] if a > t - h]
        past = [b for a, b in data if a <= t - h]
        before = [b for _, b in data[max(0, i - 3) : i]]
        assert got[i]["s"] == sum(live) and got[i]["m"] == min(live) and got[i]["a"] == pytest.approx(sum(live) / len(live))
        assert got[i]["p"] == (past[-1] if past else None)
        assert got[i]["r"] == (pytest.approx(sum((b < x) + (b <= x) for b in before) / 2 / len(before)) if before else None)


@pytest.fixture(scope="module")
def flow(spark):
    return flow_rows(spark, "/root/testdata/sf0.001").where("instrument_id = 1").cache()


def table(df, columns):
    return {r["row_seq"]: [r[c] for c in columns] for r in df.collect()}


BOUNDED = [n for n, _ in X.formulas(SPEC) if "imbalance" in n or "tilt" in n or "ratio" in n]


def test_features_number_bounds_and_names(flow):
    names = [n for n, _ in X.formulas(SPEC)]
    assert len(names) == len(set(names)) == 72  # and ts
    for values in table(X.features(flow, KEYS, SPEC), BOUNDED).values():
        assert all(-2 - 1e-9 <= v <= 2 + 1e-9 for v in values)


def test_no_leak_from_the_future(flow):
    names = [n for n, _ in X.formulas(SPEC)]
    whole = table(X.features(flow, KEYS, SPEC), names)
    some = sorted(whole)[: len(whole) // 2]
    assert table(X.features(flow.where(F.col("row_seq") <= some[-1]), KEYS, SPEC), names) == {k: whole[k] for k in some}


def test_ratios_ignore_the_scale_of_volume(flow):
    volumes = [c for c in FLOW if c.split("_")[0] in ("t", "add", "pull", "fill", "hidden", "flow", "depth") and "px" not in c and not c.endswith("_n")] + ["bid_sz", "ask_sz"]
    bigger = flow.withColumns({c: F.col(c) * 3 for c in volumes})
    names = ["aggr_delta_ratio_m", "replenish_bid_m", "book_imbalance_near", "flow_imbalance_near_s", "queue_depletion_bid_s", "absorption_net_s", "liquidity_vacuum_up", "book_resiliency_bid"]
    one, three = table(X.features(flow, KEYS, SPEC), names), table(X.features(bigger, KEYS, SPEC), names)
    assert all(one[k] == pytest.approx(three[k]) for k in one)


def test_sampling_clock_keeps_the_last_row(spark):
    got = X.sampled(spark.createDataFrame([(1, t, t) for t in (0, 3, 5, 6, 11, 12)], "k int, ts long, row_seq long"), ["k"], 5).orderBy("ts").collect()
    assert [r["ts"] for r in got] == [0, 5, 11, 12]
