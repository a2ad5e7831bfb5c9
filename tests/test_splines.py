"""Splines: chunks against one curve, and one curve against a dense solution."""

import numpy as np
import pytest

from gridwake.operators import splines


def dense(x, y):
    """Second derivatives' sixths of one curve by a dense system."""
    n, h, d = len(x), np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = d[i] - d[i - 1]
    a[0, :2], a[-1, -2:] = (-h[0], h[0]), (h[-1], -h[-1])
    if n > 3:
        r[0], r[-1] = h[0] ** 2 * splines.third(x[:4], y[:4]), -(h[-1] ** 2) * splines.third(x[-4:], y[-4:])
    return np.linalg.solve(a, r)


@pytest.mark.parametrize("n", [3, 4, 5, 17, 300])
def test_one_curve_equals_a_dense_solution(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.1, 3, n)), rng.normal(size=n)
    _, c, _ = splines.coefficients(x, y)
    assert c / 3 == pytest.approx(dense(x, y), abs=1e-9)


def test_cubic_is_exact_and_reflects():
    x = np.arange(7.0)
    y = x**3 - 2 * x
    at = np.array([0.5, 2.25, 5.9])
    assert splines.values(x, y, at) == pytest.approx(at**3 - 2 * at)
    assert splines.values(x, y, np.array([-0.5]))[0] == pytest.approx(2 * y[0] - splines.values(x, y, np.array([0.5]))[0])
    assert splines.values(np.array([0.0, 2.0]), np.array([0.0, 4.0]), np.array([1.0, -1.0, 3.0])) == pytest.approx([2.0, -2.0, 6.0])
    assert splines.values(np.array([1.0]), np.array([4.0]), np.array([0.0, 1.0, 5.0])) == pytest.approx([4.0] * 3)


@pytest.mark.parametrize("chunk", [1, 2, 3, 40, 10_000])
def test_chunks_of_a_key_equal_the_one_curve(spark, chunk):
    rng = np.random.default_rng(1)
    sizes = {"hot": 60 if chunk < 40 else 400, "small": 5, "three": 3, "two": 2, "one": 1}
    curves = {k: (np.cumsum(rng.uniform(0.2, 2, n)), rng.normal(size=n)) for k, n in sizes.items()}
    rows = [(k, float(a), float(b), 1) for k, (x, y) in curves.items() for a, b in zip(x, y, strict=True)]
    rows += [("hot", None, 1.0, 1), ("hot", 3.3, None, 1), ("hot", float(curves["hot"][0][3]), 99.0, 1)]
    at = {k: np.concatenate([np.linspace(x[0] - 2, x[-1] + 2, 37), x]) for k, (x, _) in curves.items()}
    probes = [(k, float(a)) for k, v in at.items() for a in v] + [("none", 1.0), ("hot", None)]
    p = spark.createDataFrame(rows, "k string, x double, y double, n int").repartition(3)
    out = splines.spline(p, spark.createDataFrame(probes, "k string, x double"), ["k"], chunk).collect()
    assert len(out) == len(probes)
    got = {(r["k"], r["x"]): r["y"] for r in out}
    assert got["none", 1.0] is None and got["hot", None] is None
    for k, (x, y) in curves.items():
        assert [got[k, a] for a in at[k]] == pytest.approx(splines.values(x, y, at[k]).tolist(), abs=1e-9), k


def test_a_key_is_spread(spark):
    p = spark.range(1000).selectExpr("'a' as k", "id * 0.5 as x", "sin(id) as y")
    seen = []
    kept = splines.cut
    try:
        splines.cut = lambda df, *b: seen.append(kept(df, *b)) or seen[-1]
        splines.pieces(p, ["k"], 100).count()
    finally:
        splines.cut = kept
    sizes = [r["count"] for r in seen[0].groupBy("_chunk").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 300


def test_no_points(spark):
    none = spark.createDataFrame([], "k string, x double, y double")
    assert splines.spline(none, none.select("k", "x"), ["k"]).count() == 0
