import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.model import Axis, CoordSystem, Grid
from gridwake.operators import grids, links, relax, remap, solvers, spectral

FLAT = CoordSystem("cartesian", "km")


def test_clipped_links_equal_separable_ones(spark):
    a, b = Grid("a", Axis(50.0, 100.0, 4), Axis(50.0, 100.0, 3), FLAT), Grid("b", Axis(35.0, 70.0, 6), Axis(30.0, 60.0, 5), FLAT)
    t = remap.rectangles(grids.cells(spark, b), 70.0, 60.0, "dst")
    s = remap.rectangles(grids.cells(spark, a), 100.0, 100.0, "src")
    got = {(r["dst"], r["src"]): r["w"] for r in remap.clipped_links(t, s, 100.0).collect()}
    want = {(r["dst"], r["src"]): r["w"] for r in grids.conservative_links(spark, a, b).collect()}
    assert got == pytest.approx(want)


def test_clipped_links_on_the_sphere_cover_targets(spark):
    s = remap.rectangles(grids.cells(spark, Grid("a", Axis(5.0, 10.0, 4), Axis(45.0, 10.0, 3))), 10.0, 10.0, "src")
    t = remap.rectangles(grids.cells(spark, Grid("b", Axis(12.5, 5.0, 2), Axis(47.5, 5.0, 2))), 5.0, 5.0, "dst")
    w = remap.clipped_links(t, s, 10.0, sphere=True).groupBy("dst").agg(F.sum("w").alias("w")).collect()
    strip = lambda p: math.radians(5) * (math.sin(math.radians(p + 5)) - math.sin(math.radians(p)))
    assert [r["w"] for r in sorted(w, key=lambda r: r["dst"])] == pytest.approx([strip(45), strip(45), strip(50), strip(50)], rel=3e-2)


def test_strict_and_nearest(spark):
    g = Grid("g", Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 4), FLAT)
    f = grids.cells(spark, g).select(F.col("cell").alias("src"), F.when(F.col("cell") != 6, F.col("x") + 10 * F.col("y")).alias("value"))
    t = spark.createDataFrame([(1, 2.5, 2.5), (2, 1.5, 0.5), (3, 0.0, 2.0), (4, 9.0, 1.0)], "dst int, x double, y double")
    assert {r["dst"]: r["value"] for r in remap.strict_bilinear(f, g, t).collect()} == {1: 27.5, 2: None, 3: None, 4: None}
    assert {r["dst"]: r["value"] for r in remap.nearest_cells(f, g, t).collect()} == {1: 22.0, 2: 1.0, 3: 20.0, 4: None}


def test_remap_fills_and_smooths(spark):
    g = Grid("g", Axis(0.0, 1.0, 12), Axis(0.0, 1.0, 12), FLAT)
    cells = grids.cells(spark, g)
    l = cells.where("cell % 7 <> 0").select(F.col("cell").alias("dst"), F.col("cell").alias("src"), F.lit(1.0).alias("w"))
    f = cells.select(F.col("cell").alias("src"), F.lit(3.0).alias("value"))
    t = cells.select(F.col("cell").alias("dst"), "i", "j")
    out = remap.remap(l, f, t, fill=lambda field, keys, value: relax.fill_weighted(field, 2, keys, value), smooth=0.4, shape=(12, 12)).collect()
    assert len(out) == 144 and all(r["value"] == pytest.approx(3.0) for r in out)
    assert links.on_targets(links.apply(l, f), t).where("value is null").count() == 20


@pytest.fixture(scope="module")
def system(spark):
    n = 12
    a = np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    b = np.arange(1.0, n + 1)
    rows = [(i, j, float(a[i, j])) for i, j in np.argwhere(a)]
    return a, b, spark.createDataFrame([(int(i), int(j), v) for i, j, v in rows], "i long, j long, a double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")


@pytest.mark.parametrize("method", [solvers.jacobi, solvers.conjugate_gradient, solvers.bicgstab])
def test_solvers(system, method):
    a, b, ta, tb = system
    x, steps, residual = method(ta, tb, tol=1e-8)
    got = np.array([r["v"] for r in x.orderBy("i").collect()])
    assert got == pytest.approx(np.linalg.solve(a, b), rel=1e-6)
    assert residual <= 1e-8 and steps > 1


def test_power_iteration(system):
    a, _, ta, tb = system
    value, _ = solvers.power_iteration(ta, tb, tol=1e-7, most=60)
    assert value == pytest.approx(np.linalg.eigvalsh(a).max(), rel=1e-2)


def test_fourier_round_trip(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 17))
    df = spark.createDataFrame([(k, t, float(x[k, t])) for k in range(2) for t in range(17)], "k2 int, t int, value double")
    c = spectral.fourier(df, ["k2"])
    assert c.count() == 18
    back = spectral.inverse_fourier(c, ["k2"], 17).collect()
    assert all(r["value"] == pytest.approx(x[r["k2"], r["t"]]) for r in back)


def test_harmonics_round_trip(spark):
    rng = np.random.default_rng(1)
    lmax = 5
    c = np.tril(rng.normal(size=(lmax + 1, lmax + 1)) + 1j * rng.normal(size=(lmax + 1, lmax + 1)))
    c[:, 0] = c[:, 0].real
    z = spectral.synthesize(c, 8, 16)
    assert spectral.analyse(z, lmax) == pytest.approx(c)
    lat = np.degrees(np.arcsin(np.polynomial.legendre.leggauss(8)[0]))
    assert spectral.evaluate(c, 22.5 * 3, lat[2]) == pytest.approx(z[2, 3])
    df = spark.createDataFrame([(i + 1, j + 1, float(z[j, i])) for j in range(8) for i in range(16)], "i int, j int, value double")
    out = {(r["l"], r["m"]): complex(r["re"], r["im"]) for r in spectral.harmonics(df, [], lmax).collect()}
    assert all(out[l, m] == pytest.approx(c[l, m]) for l in range(lmax + 1) for m in range(l + 1))
