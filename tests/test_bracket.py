import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import series


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", [["k"], []])
def test_frames_grow_row_by_row(spark, by):
    """A frame that ends at the last row costs the square of a bucket's probes."""
    p = spark.range(5).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    q = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") / 5000.0).alias("x"), F.col("id").alias("n"))
    at = series.bracket(p, q, by, 100.0)
    assert "unboundedfollowing" not in plan(at).lower()
    out = series.interp_linear(p, q, by, 100.0).toPandas()
    assert len(out) == 20000 and np.allclose(out["y"], 2 * out["x"])


@pytest.mark.parametrize("width", [0.5, 1.0, 7.0])
def test_a_probe_on_a_point_lies_between_it_and_the_next(spark, width):
    p = spark.createDataFrame([(1, float(x), 10.0 * x) for x in (3, 0, 1, 9)], "k int, x double, y double")
    q = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 1.0, 1.0, 2.0, 3.0, 9.0, 11.0)], "k int, x double")
    got = sorted((r["x"], r["lo"] and r["lo"]["x"], r["hi"] and r["hi"]["x"]) for r in series.bracket(p, q, ["k"], width).collect())
    assert got == [(-1.0, None, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 3.0), (1.0, 1.0, 3.0), (2.0, 1.0, 3.0), (3.0, 3.0, 9.0), (9.0, 9.0, None), (11.0, 9.0, None)]


def test_alignment_of_many_probes_in_one_bucket(spark):
    p = spark.range(4).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 10.0).alias("y"))
    q = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") / 4000.0).alias("x"))
    at = series.align(p, q, ["k"], 0.25)
    assert "unboundedfollowing" not in plan(at).lower()
    out = at.toPandas()
    near = np.clip(np.ceil(out["x"] - 0.5), 0, 3)
    want = np.where(np.abs(out["x"] - near) <= 0.25, near * 10.0, np.nan)
    assert len(out) == 20000 and np.array_equal(out["y"].to_numpy(float), want, equal_nan=True)


def records(df, column: str) -> int:
    """Rows of the shuffles that are dealt by a column, once df has run."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and column in node.outputPartitioning().toString():
                n += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


@pytest.mark.parametrize("by", [["k"], []])
def test_probes_of_one_place_are_sorted_once(spark, by):
    """20,000 probes at 40 places: what windows and their buckets get is points and places."""
    p = spark.range(5).select(F.lit(1).alias("k"), (F.col("id") * 10.0).alias("x"), (F.col("id") * 3.0).alias("y"))
    q = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") % 40 * 0.95).alias("x"), F.col("id").alias("n"))
    at = series.align(p, q, by, 2.0)
    out = at.toPandas()
    assert 45 <= records(at, "_cell") < 500
    near = np.clip(np.ceil(out["x"] / 10 - 0.5), 0, 4)
    want = np.where(np.abs(out["x"] - near * 10) <= 2.0, near * 3.0, np.nan)
    assert sorted(out["n"]) == list(range(20000)) and np.array_equal(out["y"].to_numpy(float), want, equal_nan=True)


def test_points_and_probes_are_read_once_for_the_windows(spark, tmp_path):
    """Windows and carry share the shuffles below them: points and places are computed once each, and probes are read for their rows."""
    spark.range(3000).selectExpr("id", "id % 7 as k", "id % 40 * 0.95D as x").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    at = series.align(t.groupBy("k", F.floor("x").cast("double").alias("x")).agg(F.avg("id").alias("y")), t.select("k", "x", "id"), ["k"], 0.3)
    assert len(at.collect()) == 3000
    final = at._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_brackets_of_repeated_odd_places(spark, width):
    """Repeats, gaps over empty buckets, both zeros, NaN, and a key without points; what has no key or place is left out."""
    rng = np.random.default_rng(5)
    points = {k: sorted(float(v) for v in rng.choice(np.arange(-40, 41), 9, replace=False) / 2) for k in ("a", "b")}
    points["a"] = sorted({*points["a"], 0.0})
    probes = [(k, float(v)) for k in ("a", "b", "c") for v in rng.integers(-90, 91, 60) / 4] * 3 + [("a", -0.0), ("a", 0.0)]
    p = spark.createDataFrame([(k, x, 2 * x) for k, xs in points.items() for x in xs] + [(None, 1.0, 9.0), ("a", None, 9.0)], "k string, x double, y double")
    q = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate([*probes, ("a", float("nan")), ("a", float("nan")), (None, 1.0), ("a", None)])], "k string, x double, i int")
    got = {r["i"]: (r["lo"] and r["lo"]["x"], r["hi"] and r["hi"]["x"]) for r in series.bracket(p, q, ["k"], width).collect()}
    assert sorted(got) == list(range(len(probes) + 2))
    for i, (k, x) in enumerate(probes):
        xs = points.get(k, [])
        assert got[i] == (max((v for v in xs if v <= x), default=None), min((v for v in xs if v > x), default=None))
    near = {r["i"]: r["y"] for r in series.align(p, q, ["k"], width, digits=0).collect()}
    line = {r["i"]: r["y"] for r in series.interp_linear(p, q, ["k"], width, digits=0).collect()}
    assert sorted(near) == sorted(line) == sorted(got)
    for i, (k, x) in enumerate(probes):
        xs = points.get(k, [])
        d, v = min(((abs(v - x), v) for v in xs), default=(np.inf, None))
        assert near[i] == (2 * v if d <= width else None)
        assert line[i] is None if not xs else abs(line[i] - np.interp(x, xs, [2 * v for v in xs])) <= 0.5
