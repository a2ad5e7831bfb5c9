"""Grids in different systems, any axes, stored maps, and geodesics near the antipode."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.model import Axis, CoordSystem, Grid, Planet, planet
from gridwake.operators import grids, links, remap
from gridwake.sources import config

SPHERE = planet("Spherical Earth")
PLANE = CoordSystem("stereographic", "km", planet(), -40.0, 72.0, 7.5)


# --- geodesics ------------------------------------------------------------------------------------


def meridian(body, steps=20001):
    p = np.linspace(0, math.pi / 2, steps)
    rate = body.a * (1 - body.e2) / (1 - body.e2 * np.sin(p) ** 2) ** 1.5
    return 2 * np.trapezoid(rate, p)


def test_antipodes():
    s, _, _ = geo.geodesic_inverse([0.0, 0.0, 10.0, 0.0], [0.0, -30.0, 45.0, 90.0], [180.0, 180.0, -170.0, 50.0], [0.0, 30.0, -45.0, -90.0])
    assert s == pytest.approx([meridian(planet())] * 4, abs=2e-3)
    assert geo.geodesic_inverse(0, 0, 90, 0)[0] == pytest.approx(planet().a * math.pi / 2, abs=1e-3)
    # on the equator until the lift-off longitude, then over a side of it
    lift = 180 * (1 - planet().f)
    assert geo.geodesic_inverse(0, 0, lift - 1e-6, 0)[0] == pytest.approx(planet().a * math.radians(lift - 1e-6), abs=1e-2)


def test_direct_undoes_inverse_everywhere():
    rng = np.random.default_rng(1)
    lon1, lat1 = rng.uniform(-180, 180, 400), rng.uniform(-90, 90, 400)
    lon2, lat2 = rng.uniform(-180, 180, 400), rng.uniform(-90, 90, 400)
    near = rng.uniform(-1, 1, (2, 200))
    lon2[:200], lat2[:200] = lon1[:200] + 180 + near[0], np.clip(-lat1[:200] + near[1], -90, 90)
    s, az1, az2 = geo.geodesic_inverse(lon1, lat1, lon2, lat2)
    lon, lat, az = geo.geodesic_direct(lon1, lat1, az1, s)
    to = lambda a, b: np.stack([np.cos(np.radians(b)) * np.cos(np.radians(a)), np.cos(np.radians(b)) * np.sin(np.radians(a)), np.sin(np.radians(b))])
    assert np.abs(to(lon, lat) - to(lon2, lat2)).max() < 1e-9
    assert np.abs((az - az2 + 180) % 360 - 180)[np.abs(lat2) < 89].max() < 1e-5
    # no way is longer than half a meridian
    assert s.max() <= meridian(planet()) + 1e-2
    swapped = geo.geodesic_inverse(lon2, lat2, lon1, lat1)[0]
    assert swapped == pytest.approx(s, abs=1e-3)


# --- systems --------------------------------------------------------------------------------------


@pytest.mark.parametrize("system", [PLANE, CoordSystem("stereographic", "km", SPHERE, -40.0, 72.0, 7.5), CoordSystem("lambert_azimuthal_equal_area", "m", SPHERE, 10.0, 52.0), CoordSystem("lambert_azimuthal_equal_area", "km", planet(), 10.0, 52.0), CoordSystem("polar_stereographic", "km", planet(), 0.0, -90.0, 19.0), CoordSystem("rotated_pole", "degrees", planet(), -162.0, 39.25)])
def test_round_trip_of_systems(system):
    lon, lat = np.array([-50.0, -30.0, 12.0]), np.array([65.0, 70.0, 60.0]) * (-1 if system.lat == -90 else 1)
    u, v = geo.to_system(system, lon, lat)
    back = geo.to_system(system, u, v, inverse=True)
    assert back[0] == pytest.approx(lon, abs=1e-6) and back[1] == pytest.approx(lat, abs=1e-6)


def test_rotation_equals_the_column_form(spark):
    df = spark.createDataFrame([(-50.0, 65.0), (20.0, -30.0)], "lon double, lat double")
    x, y = geo.rotate_pole(F.col("lon"), F.col("lat"), -162.0, 39.25)
    got = [tuple(r) for r in df.select(x, y).collect()]
    want = geo.to_system(CoordSystem("rotated_pole", "degrees", planet(), -162.0, 39.25), [-50.0, 20.0], [65.0, -30.0])
    assert got == [pytest.approx((a, b)) for a, b in zip(*want, strict=True)]


def test_from_longitudes_to_a_plane(spark):
    """A constant stays, all targets are met, and overlaps make up each cell's area."""
    source = Grid("ll", Axis(-120.0, 2.5, 73), Axis(50.0, 1.0, 40))
    target = Grid("grl", Axis(-380.0, 40.0, 20), Axis(-580.0, 40.0, 30), PLANE)
    l = remap.conservative_links(spark, source, target).cache()
    area = l.groupBy("dst").agg(F.sum("w").alias("w")).toPandas()
    assert len(area) == 600 and np.abs(area["w"] - 1600).max() < 1e-3 * 1600
    field = grids.cells(spark, source).select(F.col("cell").alias("src"), F.lit(7.0).alias("value"))
    out = links.apply(l, field).toPandas()
    assert len(out) == 600 and np.abs(out["value"] - 7).max() < 1e-9
    # a field that is linear in the plane comes back at the centres, as far as cells allow
    lat = grids.cells(spark, source).select(F.col("cell").alias("src"), F.col("y").alias("value"))
    seen = grids.located(grids.cells(spark, target).withColumnRenamed("cell", "dst"), PLANE).join(links.apply(l, lat), "dst").toPandas()
    assert np.abs(seen["value"] - seen["lat"]).max() < 1.0
    with pytest.raises(ValueError):
        grids.conservative_links(spark, source, target)


def test_from_a_plane_to_longitudes(spark):
    source = Grid("grl", Axis(-380.0, 40.0, 20), Axis(-580.0, 40.0, 30), CoordSystem("stereographic", "km", SPHERE, -40.0, 72.0, 7.5))
    target = Grid("ll", Axis(300.0, 2.0, 36), Axis(66.0, 1.0, 14))
    l = remap.conservative_links(spark, source, target).cache()
    # cells of the plane that lie inside the target are spread over it wholly
    seen = grids.located(grids.cells(spark, source), source.system).where("lat between 68 and 76").select(F.col("cell").alias("src"), "x", "y")
    got = seen.join(l.groupBy("src").agg(F.sum("w").alias("w")), "src").toPandas()
    k = 1 / (6370.997**2)
    lon, lat = geo.to_system(source.system, got["x"], got["y"], inverse=True)
    c = np.arccos(np.sin(np.radians(lat)) * np.sin(np.radians(72)) + np.cos(np.radians(lat)) * np.cos(np.radians(72)) * np.cos(np.radians(lon + 40)))
    scale = (1 + math.cos(math.radians(7.5))) / (1 + np.cos(c))
    assert (got["w"] / (1600 * k / scale**2)).between(0.999, 1.001).all()


def test_a_cell_over_the_pole(spark):
    polar = CoordSystem("polar_stereographic", "km", SPHERE, 0.0, 90.0, 19.0)
    source = Grid("pole", Axis(0.0, 600.0, 1), Axis(0.0, 600.0, 1), polar)
    target = Grid("ll", Axis(0.0, 30.0, 12), Axis(75.0, 30.0, 1))
    l = remap.cross_links(spark, source, target).toPandas()
    assert len(l) == 12 and l["w"].sum() == pytest.approx((600 / 6370.997) ** 2, rel=0.08)
    # a square's sectors of 30 degrees
    assert l["w"].max() / l["w"].min() == pytest.approx((1 - math.tan(math.radians(15))) / (2 * math.tan(math.radians(15))), rel=2e-2)


def test_box_areas_equal_clipping():
    rng = np.random.default_rng(2)
    for _ in range(20):
        t = np.sort(rng.uniform(0, 2 * np.pi, 9))
        p = np.stack([3 + 2 * np.cos(t), 3 + 1.5 * np.sin(t)], 1)
        xe, ye = np.array([0.0, 1.5, 2.7, 4.0, 7.0]), np.array([0.0, 2.2, 3.0, 9.0])
        got = remap.box_areas(p[:, 0], p[:, 1], xe, ye)
        for j in range(3):
            for i in range(4):
                box = np.array([(xe[i], ye[j]), (xe[i + 1], ye[j]), (xe[i + 1], ye[j + 1]), (xe[i], ye[j + 1])])
                assert got[j, i] == pytest.approx(geo.plane_area(geo.clip(p, box)), abs=1e-9)


# --- axes -----------------------------------------------------------------------------------------


def test_any_axis():
    a = Axis.of([0.0, 1.0, 3.0, 7.0])
    assert a.edges() == [-0.5, 0.5, 2.0, 5.0, 9.0] and a.widest == 4.0 and a.centre(3) == 3.0
    assert Axis.of([5.0, 4.0, 3.0]).at is None and Axis.of([5.0, 4.0, 3.0]).dx == -1.0
    with pytest.raises(ValueError):
        Axis.of([0.0, 2.0, 1.0])


def test_gaussian_grid_is_located_and_overlapped(spark):
    lat = geo.gaussian_latitudes(12)[0]
    for order in (lat, lat[::-1]):
        g = Grid("gauss", Axis(0.0, 30.0, 12), Axis.of(order))
        rows = [(1, 15.0, 10.0), (2, 100.0, -40.0), (3, 350.0, 60.0)]
        t = spark.createDataFrame(rows, "dst long, x double, y double")
        field = grids.cells(spark, g).select(F.col("cell").alias("src"), F.col("y").alias("value"))
        got = {r["dst"]: r["value"] for r in links.apply(grids.bilinear_links(t, g), field).collect()}
        assert got == {k: pytest.approx(y) for k, _, y in rows}
        l = grids.conservative_links(spark, g, Grid("4", Axis(45.0, 90.0, 4), Axis(-60.0, 60.0, 3)))
        assert l.agg(F.sum("w")).first()[0] == pytest.approx(360 * 2 * math.sin(math.radians(max(g.y.edges()))), rel=1e-9)


def test_cell_areas_make_up_the_planet(spark):
    g = Grid("10", Axis(5.0, 10.0, 36), Axis(-85.0, 10.0, 18))
    total = grids.cells(spark, g).agg(F.sum(grids.cell_area(g))).first()[0]
    assert total == pytest.approx(5.100656e14, rel=4e-3)
    flat = Grid("f", Axis.of([0.0, 1.0, 3.0]), Axis(0.0, 2.0, 2), CoordSystem("cartesian", "km"))
    assert sorted(r[0] for r in grids.cells(spark, flat).select(grids.cell_area(flat)).collect()) == [2.0, 2.0, 3.0, 3.0, 4.0, 4.0]


def test_unique_and_places(spark):
    v = [1.0, 5.0, 1.0 + 4e-6, 1.0 + 1.2e-5, 1.0 + 8e-6, 5.0, 9.0, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "o int, v double")
    held = []
    for x in v:
        if x is not None and all(abs(x - u) > 1e-5 for u in held):
            held.append(x)
    assert sorted(r[0] for r in grids.unique(df, "v", "o").collect()) == sorted(held)
    assert [r[0] for r in grids.places(df, F.col("v") == 5.0, "o").collect()] == [1, 5]


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "dense", "zigzag"])
def test_unique_of_chains_across_blocks(spark, shape):
    rng = np.random.default_rng(3)
    n = 600
    v = {"random": rng.uniform(0, 60, n), "rising": np.arange(n) * 0.6, "falling": np.arange(n)[::-1] * 0.6, "dense": rng.uniform(0, 2.5, n), "zigzag": np.arange(n) * 0.6}[shape]
    order = np.argsort(np.abs(np.sin(np.arange(n)))) if shape == "zigzag" else np.arange(n)
    rows = [(int(o), float(x), 0, "x") for o, x in zip(order, v, strict=True)] + [(n, None, 0, "x"), (n + 1, float("nan"), 0, "x"), (n + 2, float(v[0]), 0, "x")]
    held = []
    for _, x in sorted((o, x) for o, x, *_ in rows[:n]):
        if all(abs(x - u) > 1.0 for u in held):
            held.append(x)
    df = spark.createDataFrame(rows, "o int, v double, state int, block string").repartition(3)
    assert sorted(r[0] for r in grids.unique(df, "v", "o", 1.0, chunk=70).collect()) == sorted(held)
    assert grids.unique(df.where("false"), "v", "o").count() == 0


# --- stored maps ----------------------------------------------------------------------------------


def test_registry_reads_what_it_stored(spark, tmp_path):
    a, b = Grid("a", Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 1)), Grid("b", Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 2))
    built = []

    def build(s, t, method):
        built.append((s.name, t.name, method))
        return spark.createDataFrame([(1, 1, 1.0)], "dst int, src int, w double")

    first = links.Registry(spark, str(tmp_path))
    first.add("a", a)
    first.add("b", b)
    first.prime([("a", "b", "nn"), ("b", "a", "con")], build)
    again = links.Registry(spark, str(tmp_path))
    again.add("a", a)
    again.add("b", b)
    assert again.links("a", "b", "nn", build).collect() == first.links("a", "b", "nn", build).collect()
    assert len(built) == 2
    other = links.Registry(spark, str(tmp_path))
    other.add("a", a)
    other.add("b", Grid("b", Axis(0.0, 1.0, 3), Axis(0.0, 1.0, 4)))
    other.links("a", "b", "nn", build)
    assert len(built) == 3
    again.maps.clear()
    again.links("a", "b", "nn", build, load=False)
    assert len(built) == 4


def test_scrip_files(spark, tmp_path):
    w = spark.createDataFrame([(1, 1, 0.25), (1, 2, 0.75), (2, 3, 1.0)], "dst int, src int, w double")
    links.write_scrip(w, str(tmp_path / "w.nc"), 3, 2)
    assert [tuple(r) for r in links.read_scrip(spark, str(tmp_path / "w.nc")).orderBy("dst", "src").collect()] == [(1, 1, 0.25), (1, 2, 0.75), (2, 3, 1.0)]
    d = spark.createDataFrame([(1, 1, 1.0, 1, 0.1, 0.4), (1, 2, 2.0, 2, 0.2, 0.5), (2, 3, 3.0, 3, 0.3, 0.6)], "dst int, src int, dist double, quadrant int, xn double, yn double")
    links.write_scrip(d, str(tmp_path / "d.nc"), 3, 2)
    back = links.read_scrip(spark, str(tmp_path / "d.nc")).orderBy("dst", "src").collect()
    assert [tuple(r) for r in back] == [(1, 1, 1.0, 1, 0.1, 0.4), (1, 2, 2.0, 2, 0.2, 0.5), (2, 3, 3.0, 3, 0.3, 0.6)]
    links.write_scrip(d, str(tmp_path / "s.nc"), 3, 2, scrip_only=True)
    frozen = links.read_scrip(spark, str(tmp_path / "s.nc")).orderBy("dst", "src").collect()
    assert [r["w"] for r in frozen] == pytest.approx([0.8, 0.2, 1.0])


def test_baked_bilinear_weights_give_what_the_kernel_gives(spark):
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (30, 2)))], "dst long, x double, y double")
    s = spark.createDataFrame([(i, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (80, 2)))], "src long, x double, y double, value double")
    n = links.nearest(t, s.select("src", "x", "y"), 8).join(t, "dst").join(s.select("src", F.col("x").alias("xn"), F.col("y").alias("yn")), "src")
    n = n.withColumn("quadrant", links.quadrant(F.col("x"), F.col("y"), F.col("xn"), F.col("yn"))).cache()
    want = {r["dst"]: r["value"] for r in links.apply(n, s.select("src", "value"), "bilinear").collect()}
    baked = links.bake_bilinear(n)
    got = {r["dst"]: r["value"] for r in links.apply(baked, s.select("src", "value")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert all(r[0] == pytest.approx(1.0) for r in baked.groupBy("dst").agg(F.sum("w")).select("sum(w)").collect())


# --- descriptions ---------------------------------------------------------------------------------


def test_descriptions_carry_planet_projection_and_any_axis():
    g = Grid("g", Axis(0.0, 20.0, 4), Axis(10.0, 20.0, 3), CoordSystem("stereographic", "km", SPHERE, -40.0, 72.0, 7.5))
    assert config.grid_of(config.describe(g)) == g
    own = Grid("m", Axis(0.0, 30.0, 12), Axis.of(geo.gaussian_latitudes(4)[0]), CoordSystem(planet=Planet("Moonlike", 1.7374e6, 0.0)))
    back = config.grid_of(config.describe(own))
    assert back.y == own.y and (back.system.planet.a, back.system.planet.f) == (1.7374e6, 0.0)
    text = "gridtype = projection\nxsize = 2\nysize = 2\nxunits = \"km\"\nxfirst = 0\nxinc = 1\nyfirst = 0\nyinc = 1\ngrid_mapping_name = polar_stereographic\nstraight_vertical_longitude_from_pole = -45\nlatitude_of_projection_origin = 90\nstandard_parallel = 70\nsemi_major_axis = 6378137\ninverse_flattening = 298.257223563\n"
    s = config.grid_of(text).system
    assert (s.mtype, s.units, s.lon, s.lat, s.alpha, s.planet.name) == ("polar_stereographic", "km", -45.0, 90.0, 20.0, "WGS84")


def test_explicit_descriptions(spark):
    text = config.describe_cells(remap.outlines(spark, Grid("g", Axis(0.0, 2.0, 2), Axis(0.0, 2.0, 1)), 1))
    lines = text.splitlines()
    assert lines[1:4] == ["gridsize = 2", "gridname = grid", "nvertex = 4"]
    assert "xvals = 0 2" in lines and "-1 1 1 -1" in lines and "1 3 3 1" in lines
