import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.model import Axis, CoordSystem, Grid
from gridwake.operators import grids, links

FLAT = CoordSystem("cartesian", "km")


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "src int, value double")


def got(df):
    return {r["dst"]: r["value"] for r in df.collect()}


def test_weights(spark, field):
    l = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0), (3, 1, 0.0)], "dst int, src int, w double")
    assert got(links.apply(l, field)) == {1: 17.5, 2: 30.0}
    assert got(links.apply(l, field, "count")) == {1: 20.0, 2: 30.0}
    assert got(links.apply(l, field, "stdev"))[1] == pytest.approx(np.sqrt((7.5**2 + 3 * 2.5**2) / 4))
    targets = spark.createDataFrame([(1, 1.0), (3, 3.0)], "dst int, old double")
    assert got(links.on_targets(links.apply(l, field), targets)) == {1: 17.5, 3: None}
    assert got(links.on_targets(links.apply(l, field), targets, old="old")) == {1: 17.5, 3: 3.0}


def test_mode_takes_the_first_of_equal_totals(spark, field):
    l = spark.createDataFrame([(1, 2, 1.0, 1), (1, 1, 1.0, 2)], "dst int, src int, w double, pos int")
    assert got(links.apply(l, field, "count")) == {1: 20.0}


def test_distances(spark, field):
    l = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 2.0, 2)], "dst int, src int, dist double, quadrant int")
    assert got(links.apply(l, field, "nn")) == {1: 10.0}
    assert got(links.apply(l, field, "shepard")) == {1: pytest.approx(12.0)}
    assert got(links.apply(l, field, "quadrant")) == {1: pytest.approx(12.0)}
    hidden = field.withColumn("value", F.when(F.col("src") != 1, F.col("value")))
    assert got(links.apply(l, hidden, "nn")) == {1: 20.0}
    assert got(links.apply(l, hidden, "nn", radius=1.5)) == {}


def test_bake_and_prune_round_trip(spark, tmp_path):
    l = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)], "dst int, src int, dist double")
    baked = links.bake(l)
    links.write(baked, str(tmp_path / "l"), scrip_only=True)
    back = {(r["dst"], r["src"]): r["w"] for r in links.read(spark, str(tmp_path / "l")).collect()}
    assert back == {(1, 1): pytest.approx(0.8), (1, 2): pytest.approx(0.2), (2, 3): 1.0}
    assert links.prune(baked, 0.5).count() == 2


def points(n, seed):
    s, out = seed, []
    for _ in range(n):
        p = []
        for _ in range(3):
            s = (1103515245 * s + 12345) % 2**31
            p.append(s / 2**31)
        out.append(p)
    return np.array(out)


def test_neighbours_equal_brute_force(spark):
    a, b = points(40, 123456789), points(300, 987654321)
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "dst int, x double, y double, z double")
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "src int, x double, y double, z double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    near = links.nearest(t, s, 5, dims=("x", "y", "z")).collect()
    want = np.argsort(d, axis=1)[:, :5]
    assert {(r["dst"], r["rank"]): r["src"] for r in near} == {(i, k + 1): int(want[i, k]) for i in range(40) for k in range(5)}
    pairs = {(r["dst"], r["src"]) for r in links.radius_pairs(t, s, 0.2, ("x", "y", "z")).collect()}
    assert pairs == {(int(i), int(j)) for i, j in np.argwhere(d <= 0.2)}


def test_nearest_with_a_limit(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "dst int, x double, y double")
    s = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 3.0)], "src int, x double, y double")
    out = {(r["dst"], r["src"]) for r in links.nearest(t, s, 2, dist_max=2.0).collect()}
    assert out == {(1, 1)}
    assert links.nearest(t, s, 5).count() == 4  # fewer sources than asked for


def test_conservative_planar_keeps_values_and_integral(spark):
    source, target = Grid("a", Axis(50.0, 100.0, 4), Axis(50.0, 100.0, 4), FLAT), Grid("b", Axis(25.0, 50.0, 8), Axis(25.0, 50.0, 8), FLAT)
    l = grids.conservative_links(spark, source, target)
    f = grids.cells(spark, source).select(F.col("cell").alias("src"), (F.col("i") + 10 * F.col("j")).cast("double").alias("value"))
    out = links.apply(l, f).join(grids.cells(spark, target).withColumnRenamed("cell", "dst"), "dst").collect()
    assert len(out) == 64
    assert all(r["value"] == pytest.approx((r["i"] + 1) // 2 + 10 * ((r["j"] + 1) // 2)) for r in out)
    assert sum(r["value"] for r in out) * 2500 == pytest.approx(sum(r["value"] for r in f.collect()) * 10000)


def test_conservative_sphere_with_descending_latitudes(spark):
    a = Grid("a", Axis(5.0, 10.0, 4), Axis(35.0, 10.0, 3))
    up = Grid("b", Axis(2.5, 5.0, 8), Axis(32.5, 5.0, 6))
    down = Grid("c", Axis(2.5, 5.0, 8), Axis(57.5, -5.0, 6))
    w = lambda g: {(r["dst"], r["src"]): r["w"] for r in grids.conservative_links(spark, a, g).collect()}
    p, q = w(up), w(down)
    assert len(p) == 48
    assert sum(p.values()) == pytest.approx(40 * (np.sin(np.radians(60)) - np.sin(np.radians(30))))
    flip = lambda d: (5 - (d - 1) // 8) * 8 + (d - 1) % 8 + 1
    assert all(q[flip(d), s] == pytest.approx(v) for (d, s), v in p.items())


def test_seam_is_the_same_on_either_numbering(spark):
    s = Grid("s", Axis(0.0, 30.0, 12), Axis(-75.0, 30.0, 6))
    t = spark.createDataFrame([(1, 350.0, 10.0), (2, -10.0, 10.0), (3, 180.0, -20.0), (4, -180.0, -20.0)], "dst int, x double, y double")
    rows = {}
    for r in grids.bilinear_links(t, s).collect():
        rows.setdefault(r["dst"], {})[r["src"]] = round(r["w"], 12)
    assert rows[1] == rows[2]
    assert rows[3] == rows[4]


def test_bilinear_is_exact_and_clamps(spark):
    g = Grid("s", Axis(0.0, 100.0, 10), Axis(0.0, 100.0, 10), FLAT)
    t = spark.createDataFrame([(1, 150.0, 250.0), (2, 950.0, 0.0), (3, 1100.0, 0.0), (4, 0.0, 899.0)], "dst int, x double, y double")
    f = grids.cells(spark, g).select(F.col("cell").alias("src"), (2 * F.col("x") + 3 * F.col("y")).alias("value"))
    out = got(links.apply(grids.bilinear_links(t, g), f))
    assert out == {1: pytest.approx(1050.0), 2: pytest.approx(1800.0), 4: pytest.approx(2697.0)}


def test_axes_and_lists(spark):
    assert Axis.spanning(0.0, 10.0, dx=2.5).n == 5
    with pytest.raises(ValueError):
        Axis.spanning(0.0, 10.0, dx=3.0)
    e = grids.edges(grids.axis(spark, Axis(0.0, 2.0, 3))).orderBy("idx").collect()
    assert [(r["lo"], r["hi"]) for r in e] == [(-1.0, 1.0), (1.0, 3.0), (3.0, 5.0)]
    df = spark.createDataFrame([(1, 1.0), (2, 1.000001), (3, 2.0), (4, 1.0)], "idx long, v double")
    assert sorted(r[0] for r in grids.unique(df, "v", "idx").collect()) == [1.0, 2.0]
    assert grids.which(df, F.col("v") > 5).first()[0] == [-1]
    assert grids.which(df, F.col("v") < 1.5).first()[0] == [1, 2, 4]


def test_registry_builds_once(spark, tmp_path):
    reg, calls = links.Registry(spark, str(tmp_path)), []

    def build(a, b, method):
        calls.append(method)
        return grids.conservative_links(spark, a, b)

    a, b = Grid("a", Axis(50.0, 100.0, 4), Axis(50.0, 100.0, 4), FLAT), Grid("b", Axis(25.0, 50.0, 8), Axis(25.0, 50.0, 8), FLAT)
    reg.add("a", a)
    reg.add("b", b)
    f = grids.cells(spark, a).select(F.col("cell").alias("src"), F.lit(7.0).alias("value"))
    for _ in range(2):
        assert {r["value"] for r in reg.remap("a", "b", "con", build, f).collect()} == {7.0}
    assert calls == ["con"]
