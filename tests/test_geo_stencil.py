import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.functions.roots import newton, secant
from gridwake.model import PLANETS, CoordSystem, planet, same_system
from gridwake.operators import stencil


def test_geodesics():
    d, az, _ = geo.geodesic_inverse(0, 0, 90, 0)
    assert d[0] == pytest.approx(planet().a * math.pi / 2)
    assert az[0] == pytest.approx(90)
    d, az, _ = geo.geodesic_inverse([10, -40], [50, 65], [12, -30], [-3, 72])
    lon, lat, _ = geo.geodesic_direct([10, -40], [50, 65], az, d)
    assert lon == pytest.approx([12, -30])
    assert lat == pytest.approx([-3, 72])
    ball = PLANETS["Spherical Earth"]
    assert geo.geodesic_inverse(0, 0, 0, 90, ball)[0][0] == pytest.approx(ball.a * math.pi / 2)


def test_geodesic_area():
    ball = PLANETS["Spherical Earth"]
    corners = [(10, 10), (60, 5), (40, 50)]
    xyz = np.array([(math.cos(math.radians(p)) * math.cos(math.radians(l)), math.cos(math.radians(p)) * math.sin(math.radians(l)), math.sin(math.radians(p))) for l, p in corners])
    assert geo.geodesic_area(*zip(*corners, strict=True), ball) == pytest.approx(geo.sphere_area(xyz) * ball.a**2, rel=1e-6)
    small = geo.geodesic_area([0, 0.01, 0.01, 0], [0, 0, 0.01, 0.01])
    a, b = planet().a * math.radians(0.01), planet().b**2 / planet().a * math.radians(0.01)
    assert small == pytest.approx(a * b, rel=1e-4)


def test_polygons(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0], 0.5, 0.5), ([0.0, 1.0, 0.0], [0.0, 0.0, 1.0], 2.0, 2.0)], "xs array<double>, ys array<double>, x double, y double")
    rows = df.select(geo.polygon_area("xs", "ys").alias("a"), geo.point_in_polygon("x", "y", "xs", "ys").alias("p")).collect()
    assert [(r["a"], r["p"]) for r in rows] == [(1.0, True), (0.5, False)]
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert geo.plane_area(geo.clip(square, square + 1)) == pytest.approx(1)
    assert geo.plane_area(geo.clip(square / 4 + 0.5, square)) == pytest.approx(0.25)
    assert len(geo.clip(square, square + 5)) == 0
    assert geo.plane_area(geo.clip(square, (square + 1)[::-1])) == pytest.approx(1)


def test_clip_on_the_sphere():
    xyz = lambda lon, lat: np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])
    a = np.array([xyz(0, 0), xyz(90, 0), xyz(0, 90)])
    assert geo.sphere_area(a) == pytest.approx(math.pi / 2)
    b = np.array([xyz(45, 0), xyz(135, 0), xyz(0, 90)])
    assert geo.sphere_area(geo.clip_sphere(a, b)) == pytest.approx(math.pi / 4)
    assert len(geo.clip_sphere(a, np.array([xyz(180, 0), xyz(270, 0), xyz(0, -90)])[::-1])) in (0, 1, 2, 3)


def test_gaussian_latitudes():
    assert geo.gaussian_latitudes(2)[0] == pytest.approx([35.2643897, -35.2643897])
    lat, w = geo.gaussian_latitudes(4)
    assert lat[:2] == pytest.approx([59.4444, 19.8757], abs=1e-3)
    assert w.sum() == pytest.approx(2)


@pytest.mark.parametrize("kind", ["stereographic", "polar_stereographic", "equal_area"])
def test_ellipsoid_projections_round_trip(kind):
    lon, lat = np.array([-40.0, -30.0, 10.0, -60.0]), np.array([72.0, 60.0, 80.0, 65.0])
    lat0 = 90.0 if kind.startswith("polar") else 72.0
    x, y = geo.ellipsoid_project(kind, lon, lat, -40.0, lat0, 15.0)
    lon2, lat2 = geo.ellipsoid_project(kind, x, y, -40.0, lat0, 15.0, inverse=True)
    assert lon2 == pytest.approx(lon)
    assert lat2 == pytest.approx(lat)


def test_snyder_polar_example():
    # Snyder (1987), p. 315: International ellipsoid, standard parallel 71 S, central meridian 100 W, point 75 S 150 E
    from gridwake.model import Planet

    body = Planet("International", 6378388.0, 1 / 297)
    x, y = geo.ellipsoid_project("polar_stereographic", 150.0, -75.0, -100.0, -90.0, 19.0, body)
    assert (float(x), float(y)) == (pytest.approx(-1540033.6, abs=1), pytest.approx(-560526.4, abs=1))


def test_systems():
    assert same_system(CoordSystem(), CoordSystem("rotated_pole"))
    assert not same_system(CoordSystem(), CoordSystem("stereographic", lon=1.0))
    assert geo.polar_alpha(71.0) == 19.0


def test_roots():
    assert newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0)[0] == pytest.approx(math.sqrt(2))
    assert secant(lambda x: math.cos(x) - x, 0.0, 1.0)[0] == pytest.approx(0.7390851)
    assert newton(lambda x: x * x + 1, lambda x: 2 * x, 0.0)[1] is False
    assert secant(lambda x: 1.0, 0.0, 1.0)[1] is False


@pytest.fixture(scope="module")
def plane(spark):
    return spark.range(48).select((F.col("id") % 8 + 1).alias("i"), (F.floor(F.col("id") / 8) + 1).alias("j")).withColumn("value", (F.col("i") * F.col("i") + 3 * F.col("j")).cast("double"))


def test_derivatives_are_exact_for_parabolas(plane):
    rows = stencil.derivative(plane, "i", 1.0).collect()
    assert all(r["slope"] == pytest.approx(2 * r["i"]) for r in rows)
    rows = stencil.derivative(plane, "i", 1.0, edges="reference").where("i = 1").collect()
    assert all(r["slope"] == pytest.approx(-2.0) for r in rows)
    assert {r["slope"] for r in stencil.derivative(plane, "j", 1.0, limit=1.0).collect()} == {1.0}


def test_convolution(spark, plane):
    flat = plane.withColumn("value", F.lit(4.0)).withColumn("m", (F.col("i") > 2).cast("int"))
    k = stencil.gauss_kernel(0.3)
    assert all(r["value"] == pytest.approx(4.0) for r in stencil.convolve(flat, k, 8, 6).collect())
    masked = flat.withColumn("value", F.when(F.col("m") == 1, 4.0).otherwise(-1.0))
    out = stencil.convolve(masked, k, 8, 6, mask="m").collect()
    assert all(r["value"] == pytest.approx(4.0 if r["i"] > 2 else -1.0) for r in out)
    a = {(r["i"], r["j"]): r["value"] for r in stencil.convolve(plane, stencil.gauss_kernel(0.4, 2), 8, 6).collect()}
    line = [(d, math.exp(-0.5 * d * d / 0.16)) for d in range(-2, 3)]
    total = sum(w for _, w in line)
    b = {(r["i"], r["j"]): r["value"] for r in stencil.smooth(plane, [(d, w / total) for d, w in line], 8, 6).collect()}
    assert all(a[c] == pytest.approx(b[c]) for c in a)


def test_distance_and_fields(spark, plane):
    m = np.ones((9, 9))
    m[4, 4] = 0
    m[0, :] = -1
    d = stencil.distance_to_mask(m)
    assert d[4, 4] == 0
    assert d[6, 5] == pytest.approx(1 + math.sqrt(2))
    assert d[0, 4] < 0
    wrapped = stencil.distance_to_mask(np.where(np.add.outer(range(6), range(6)) == 0, 0, 1), True, True)
    assert wrapped[5, 5] == pytest.approx(math.sqrt(2))
    slices = plane.withColumn("k", F.lit(1)).unionByName(plane.withColumn("k", F.lit(2)))
    out = stencil.on_fields(slices, ["k"], lambda z: z * 2).collect()
    assert len(out) == 96
    assert all(r["value"] == 2 * (r["i"] ** 2 + 3 * r["j"]) for r in out)


@pytest.mark.parametrize(("px", "py"), [(False, False), (True, False), (False, True), (True, True)])
def test_distances_equal_brute_force(spark, px, py):
    rng = np.random.default_rng(9)
    masks = {"a": rng.choice([-1, 0, 1, 1, 1, 1, 1, 1], (13, 11)), "b": np.ones((13, 11)), "c": np.where(np.add.outer(range(13), range(11)) == 3, 0, -1)}
    masks["c"][6:] = 1
    rows = [(k, i + 1, j + 1, int(m[i, j]), 1.0, 2.0) for k, m in masks.items() for i, j in np.ndindex(m.shape)]
    df = spark.createDataFrame(rows, "k string, i int, j int, mask int, distance double, _n double").repartition(5)
    got = {(r["k"], r["i"] - 1, r["j"] - 1): r["distance"] for r in stencil.distances(df, "mask", ["k"], px, py, (13, 11)).collect()}
    assert len(got) == len(rows)
    for k, m in masks.items():
        zeros = np.argwhere(m == 0)
        for i, j in np.ndindex(m.shape):
            di, dj = abs(zeros[:, 0] - i), abs(zeros[:, 1] - j)
            di, dj = np.minimum(di, 13 - di) if px else di, np.minimum(dj, 11 - dj) if py else dj
            d = np.min(np.maximum(di, dj) + (math.sqrt(2) - 1) * np.minimum(di, dj), initial=1e9)
            assert got[k, i, j] == pytest.approx(-d if m[i, j] < 0 else d)
    assert stencil.distances(df.where("false"), "mask", ["k"]).count() == 0


def test_quadrature_keeps_linear_fields(spark):
    df = spark.createDataFrame([(0.0, 2.0, 4.0, 6.0)], "a double, b double, c double, d double")
    g = 1 / math.sqrt(3)
    out = [r["at_node"] for r in stencil.quadrature_nodes(df, ["a", "b", "c", "d"]).orderBy("node").collect()]
    assert out == pytest.approx([3 + x + 2 * y for y in (-g, g) for x in (-g, g)])
