import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwake.operators import schedule, series


def test_lookup_clamps_and_spreads(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (1, 1000.0, 10.0, 6.0), (1, 2000.0, 20.0, None)], "channel int, time double, value double, sigma double")
    t = spark.createDataFrame([(1, x) for x in (500.0, 1500.0, -100.0, 3000.0)], "channel int, time double")
    out = {r["time"]: (r["value"], r["sigma"]) for r in series.series_lookup(s, t, ["channel"], 300.0).collect()}
    assert out == {500.0: (5.0, 4.0), 1500.0: (15.0, 3.0), -100.0: (0.0, 2.0), 3000.0: (20.0, 0.0)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True), st.floats(0.5, 50))
def test_linear_is_numpy_whatever_the_buckets(spark, xs, width):
    xs = sorted(float(x) for x in xs)
    ys = [x * x for x in xs]
    at = [-5.0, 0.25, 7.0, 33.3, 59.9, 80.0]
    p = spark.createDataFrame([(1, x, y) for x, y in zip(xs, ys, strict=True)], "k int, x double, y double")
    q = spark.createDataFrame([(1, x) for x in at], "k int, x double")
    out = {r["x"]: r["y"] for r in series.interp_linear(p, q, ["k"], width).collect()}
    assert [out[x] for x in at] == pytest.approx(np.interp(at, xs, ys).tolist())


def test_align_takes_the_nearest_within_tolerance(spark):
    p = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0), (1, 2.0, 30.0)], "k int, x double, y double")
    q = spark.createDataFrame([(1, x) for x in (0.4, 0.5, 1.45, 1.6, 9.0)], "k int, x double")
    out = {r["x"]: r["y"] for r in series.align(p, q, ["k"], series.default_tolerance(p, ["k"])).collect()}
    assert out == {0.4: 10.0, 0.5: None, 1.45: 20.0, 1.6: 30.0, 9.0: None}


def test_rebin_keeps_a_constant(spark):
    s = spark.createDataFrame([(float(x), 7.0) for x in range(0, 11)], "x double, y double")
    t = spark.createDataFrame([(x,) for x in (0.0, 2.5, 5.0, 10.0)], "x double")
    assert all(r["y"] == pytest.approx(7.0) for r in series.rebin(s, t, 2.0).collect())


def test_schedules(spark):
    assert schedule.output_times("none", 0, 10) == []
    assert schedule.constant_times(0.0, 10.0, 4.0) == [0.0, 4.0, 8.0, 12.0]
    assert schedule.parse_lines(["# x", "", "1", "2:2:6"]) == [1.0, 2.0, 4.0, 6.0]
    assert schedule.output_times("times", 0.0, 10.0, times=[1.0, 1.0 + 1e-8, 5.0, 20.0]) == [1.0, 5.0, 10.0]
    times = schedule.times_table(spark, [1.0, 5.0])
    rows = spark.createDataFrame([(1.0000001,), (1.1,), (5.0,)], "time double")
    assert sorted(r[0] for r in schedule.at_listed_times(rows, times).collect()) == [1.0000001, 5.0]
    assert [r["time"] for r in schedule.clock(spark, 0.0, 1.0, 0.4).orderBy("n").collect()] == pytest.approx([0.0, 0.4, 0.8, 1.0])
