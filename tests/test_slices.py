import math

import pytest
from pyspark.sql import functions as F

from gridwake.operators import slices


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(i, t, float(t), t + (i - 1) * 100.0) for i in (1, 2, 3) for t in range(1, 11)], "x int, t_idx long, time double, value double")


def got(df):
    return {r["x"]: r["value"] for r in df.collect()}


def test_exact_and_range(field):
    assert got(slices.steps(field.drop("t_idx"), 5.0)) == {1: 5.0, 2: 105.0, 3: 205.0}
    assert slices.steps(field, 3.0, 5.0).count() == 9


def test_off_axis_is_missing(field):
    assert got(slices.steps(field.drop("t_idx"), 5.0, 11.0)) == {1: None, 2: None, 3: None}
    assert got(slices.range_reduce(field, "mean", 5.0, 11.0, ["x"])) == {1: None, 2: None, 3: None}


@pytest.mark.parametrize(("method", "first"), [("mean", 5.5), ("sum", 55.0), ("min", 1.0), ("max", 10.0), ("sd", 2.8722813)])
def test_reductions(field, method, first):
    assert got(slices.range_reduce(field, method, 1.0, 10.0, ["x"]))[1] == pytest.approx(first, rel=1e-6)


def test_sd_of_two_and_of_one(field):
    assert got(slices.range_reduce(field, "sd", 1.0, 2.0, ["x"]))[2] == pytest.approx(math.sqrt(0.5))
    assert got(slices.range_reduce(field, "sd", 1.0, 1.0, ["x"]))[2] is None


def test_interp_extrap(field):
    f = field.drop("t_idx")
    assert got(slices.interpolate(f, 4.5, ["x"])) == {1: 4.5, 2: 104.5, 3: 204.5}
    assert got(slices.interpolate(f, 10.0, ["x"]))[1] == 10.0
    assert got(slices.interpolate(f, 12.0, ["x"]))[1] is None
    assert got(slices.interpolate(f, 12.0, ["x"], extrapolate=True))[1] == 10.0
    assert got(slices.interpolate(f, -3.0, ["x"], extrapolate=True))[3] == 201.0


def test_interp_with_a_missing_bracket(field):
    f = field.drop("t_idx").withColumn("value", F.when(F.col("time") != 4, F.col("value")))
    assert got(slices.interpolate(f, 4.5, ["x"]))[1] == 5.0
    assert got(slices.interpolate(f, 4.0, ["x"]))[1] is None


def test_climatology_needs_whole_years(spark):
    rows = [(1, k + 1, 2000 + (k + 0.5) / 4, float(k)) for k in range(8)]
    f = spark.createDataFrame(rows, "x int, t_idx long, time double, value double")
    out = {r["slot"]: r["value"] for r in slices.range_reduce(f, "mean", 2000.0, 2001.0, ["x"], rep=4).collect()}
    assert out == {0: 2.0, 1: 3.0, 2: 4.0, 3: 5.0}
    with pytest.raises(ValueError):
        slices.range_reduce(f, "mean", 2000.5, 2001.0, ["x"], rep=4)


def test_scaling_and_crazy_values(spark):
    df = spark.createDataFrame([(5.0,), (1e11,), (None,)], "value double")
    assert [r[0] for r in df.select(slices.scaled(F.col("value"), 2.0, 5.0)).collect()] == [15.0, None, None]


def test_time_filter_is_pushed_down(spark, field, tmp_path):
    field.write.parquet(str(tmp_path / "f"))
    plan = slices.steps(spark.read.parquet(str(tmp_path / "f")), 3.0, 5.0, axis=(1.0, 10.0))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan
