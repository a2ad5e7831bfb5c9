"""Staggered nodes and quadrature, masked filters, files of the array sources, generators and variables from namelists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.model import Axis, CoordSystem, Grid, planet
from gridwake.operators import grids, nodes, remap, slices, stencil
from gridwake.sources import arrays
from gridwake.sources.config import Namelist
from gridwake.streaming import forcing
from gridwake.streaming.forcing import Forcing

NX, NY = 5, 4
Z = np.arange(NX * NY, dtype=float).reshape(NX, NY) ** 1.5


def table(spark, **fields):
    rows = [(i + 1, j + 1, *(float(z[i, j]) for z in fields.values())) for i in range(NX) for j in range(NY)]
    return spark.createDataFrame(rows, ", ".join(["i int", "j int", *(f"{k} double" for k in fields)]))


def array(df, name):
    out = np.full((NX, NY), np.nan)
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1] = r[name]
    return out


def turned(z, a, b):
    """The neighbour at (a, b), wrapping."""
    return np.roll(z, (-a, -b), (0, 1))


def test_staggerings(spark):
    df = table(spark, value=Z)
    s = lambda kind: array(nodes.stagger(df, kind), "staggered")
    assert s("aa_ab") == pytest.approx((Z + turned(Z, 1, 0) + turned(Z, 0, 1) + turned(Z, 1, 1)) / 4)
    assert s("ab_aa") == pytest.approx((Z + turned(Z, -1, 0) + turned(Z, 0, -1) + turned(Z, -1, -1)) / 4)
    end = np.zeros((NX, NY))
    for kind, a, b in (("aa_acx", 1, 0), ("aa_acy", 0, 1), ("acx_aa", -1, 0), ("acy_aa", 0, -1), ("ab_acx", 0, -1), ("ab_acy", -1, 0)):
        want = (Z + turned(Z, a, b)) / 2
        want[{1: -1, -1: 0}[a] if a else slice(None), {1: -1, -1: 0}[b] if b else slice(None)] = 0
        assert s(kind) == pytest.approx(want), kind
    assert (end == 0).all()
    with pytest.raises(ValueError):
        nodes.stagger(df, "aa_xy")


def test_vectors_and_cover(spark):
    u, v = Z, Z[::-1] * 0.5
    cover = (np.add.outer(np.arange(NX), np.arange(NY)) % 3 > 0).astype(float)
    thick = cover * 7
    df = table(spark, value=Z, u=u, v=v, cover=cover, thickness=thick)
    assert array(nodes.sides_to_centres(df), "staggered") == pytest.approx((u + turned(u, -1, 0) + v + turned(v, 0, -1)) / 4)
    want = np.where(cover == 1, np.hypot((u + turned(u, -1, 0)) / 2, (v + turned(v, 0, -1)) / 2), 0)
    assert array(nodes.magnitude(df), "magnitude") == pytest.approx(want)
    four = [(0, 0), (1, 0), (0, 1), (1, 1)]

    def chosen(z, flag, sign):
        s = np.stack([turned(z, sign * a, sign * b) for a, b in four])
        f = np.stack([turned(flag, sign * a, sign * b) for a, b in four])
        return np.where(f.any(0), (s * f).sum(0) / np.maximum(f.sum(0), 1), s.mean(0))

    assert array(nodes.centres_to_corners_bare(df), "staggered") == pytest.approx(chosen(Z, cover == 0, 1))
    corner = chosen(thick, cover == 0, 1)
    assert array(nodes.corners_to_centres_thick(df), "staggered") == pytest.approx(chosen(Z, corner > 0, -1))


@pytest.mark.parametrize("kind", ["aa", "ab", "acx", "acy"])
def test_quadrature_in_the_plane(spark, kind):
    corners = {
        "aa": lambda a, b: (turned(Z, a, b) + turned(Z, a + 1, b) + turned(Z, a, b + 1) + turned(Z, a + 1, b + 1)) / 4,
        "ab": lambda a, b: turned(Z, a, b),
        "acx": lambda a, b: (turned(Z, a, b) + turned(Z, a, b + 1)) / 2,
        "acy": lambda a, b: (turned(Z, a, b) + turned(Z, a + 1, b)) / 2,
    }[kind]
    got = nodes.to_quadrature(table(spark, value=Z), kind).toPandas()
    g = 1 / math.sqrt(3)
    for q, (x, y) in enumerate([(-g, -g), (g, -g), (-g, g), (g, g)], 1):
        want = sum((1 + x * (1 if a == 0 else -1)) * (1 + y * (1 if b == 0 else -1)) / 4 * corners(a, b) for a in (-1, 0) for b in (-1, 0))
        rows = got[got["node"] == q]
        assert [rows[(rows["i"] == i + 1) & (rows["j"] == j + 1)]["at_node"].item() for i in range(NX) for j in range(NY)] == pytest.approx(want.ravel().tolist())


@pytest.mark.parametrize("kind", ["aa", "ab", "acx", "acy", "acz"])
def test_quadrature_in_space_is_exact_for_linear_fields(spark, kind):
    """Nodes of each kind carry a linear field's values at their own places; at Gauss points it comes back."""
    half = {"aa": (0, 0, 0), "ab": (0.5, 0.5, 0.5), "acx": (0.5, 0, 0), "acy": (0, 0.5, 0), "acz": (0, 0, 0.5)}[kind]
    f = lambda x, y, z: 2 * x - 3 * y + 5 * z
    rows = [(i, j, k, float(f(i + half[0], j + half[1], k + half[2]))) for i in range(1, 6) for j in range(1, 6) for k in range(1, 6)]
    out = nodes.to_quadrature(spark.createDataFrame(rows, "i int, j int, k int, value double"), kind, 3, wrap=False).where("i between 2 and 4 and j between 2 and 4 and k between 2 and 4").collect()
    g = 0.5 / math.sqrt(3)
    for r in out:
        at = [c + (g if (r["node"] - 1) >> n & 1 else -g) for n, c in enumerate((r["i"], r["j"], r["k"]))]
        assert r["at_node"] == pytest.approx(f(*at))
    assert len(out) == 27 * 8
    with pytest.raises(ValueError):
        nodes.corner_offsets("acz", 2)


def test_basis_derivatives(spark):
    rng = np.random.default_rng(4)
    for dims in (2, 3):
        unit = (nodes.basis(dims)[0] @ np.eye(2**dims)).shape
        corners = np.array([[(n >> a & 1) for a in range(dims)] for n in range(2**dims)], float)
        element = corners * ([2.0, 3.0, 4.0][:dims]) + rng.uniform(-0.1, 0.1, corners.shape)
        d, det = nodes.basis_derivatives(element)
        # derivatives of a linear function of place are exact on any element
        slope = np.array([1.5, -2.0, 0.5][:dims])
        assert np.einsum("pan,n->pa", d, element @ slope) == pytest.approx(np.tile(slope, (2**dims, 1)))
        assert (det > 0).all() and unit == (2**dims, 2**dims)
    with pytest.raises(ValueError):
        nodes.basis_derivatives(np.zeros((4, 2)))
    square = spark.createDataFrame([(1, [0.0, 2.0, 0.0, 2.0], [0.0, 0.0, 4.0, 4.0])], "id int, x array<double>, y array<double>")
    rows = nodes.element_derivatives(square, ["x", "y"]).collect()
    assert [r["determinant"] for r in rows] == pytest.approx([2.0] * 4) and [r["point"] for r in rows] == [1, 2, 3, 4]
    assert all(sum(axis) == pytest.approx(0) for r in rows for axis in r["derivatives"])


def test_masked_gauss(spark):
    nx, ny, sigma, dx = 6, 5, 1.2, 1.0
    rng = np.random.default_rng(5)
    z, m = rng.normal(size=(nx, ny)), rng.random((nx, ny)) > 0.4
    df = spark.createDataFrame([(i + 1, j + 1, float(z[i, j]), bool(m[i, j])) for i in range(nx) for j in range(ny)], "i int, j int, value double, use boolean")
    got = {(r["i"] - 1, r["j"] - 1): r["value"] for r in stencil.gauss_masked(df, sigma, dx, nx, ny, "use").collect()}
    r = math.ceil(1.5 * sigma / dx)
    back = lambda k, n: -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k
    for i in range(nx):
        for j in range(ny):
            total = weight = 0.0
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    p, q = i + a, j + b
                    if not (0 <= p < nx or 0 <= q < ny):
                        continue
                    p, q = back(p, nx), back(q, ny)
                    if m[p, q]:
                        w = math.exp(-(a * a + b * b) / (2 * sigma**2))
                        total, weight = total + w * z[p, q], weight + w
            assert got[i, j] == pytest.approx(total / weight if weight else z[i, j])
    with pytest.raises(ValueError):
        stencil.gauss_masked(df, 9.0, dx, nx, ny, "use")


def test_nearest_valid(spark):
    g = Grid("g", Axis(0.0, 1.0, 6), Axis(0.0, 1.0, 6), CoordSystem("cartesian", "km"))
    f = grids.cells(spark, g).select(F.col("cell").alias("src"), F.when(F.col("i") > 3, F.col("cell").cast("double")).alias("value"))
    t = spark.createDataFrame([(1, 4.1, 2.2), (2, 1.0, 3.0), (3, -20.0, 0.0)], "dst int, x double, y double")
    assert {r["dst"]: r["value"] for r in remap.nearest_valid(f, g, t).collect()} == {1: 17.0, 2: 22.0, 3: 4.0}
    assert {r["dst"]: r["value"] for r in remap.nearest_valid(f, g, t, 1).collect()} == {1: 17.0, 2: None, 3: None}


# --- files ----------------------------------------------------------------------------------------


def test_characters_attributes_and_predicates(tmp_path):
    path = str(tmp_path / "a.nc")
    names = arrays.characters(["alpha", "be"])
    line = arrays.characters(["one; two;three"])[0]
    arrays.write_classic(path, {"n": 2, "len": names.shape[1], "l2": len(line)}, {"names": (["n", "len"], names, {}), "line": (["l2"], line, {}), "lon": (["n"], np.array([1.0, 2.0]), {"units": "own"})}, {"title": "x"})
    assert arrays.read_characters(path, "names") == ["alpha", "be"]
    assert arrays.read_characters(path, "line", ";") == ["one", "two", "three"] and arrays.read_characters(path, "line") == ["one; two;three"]
    assert arrays.has_variable(path, "lon") and not arrays.has_variable(path, "nope")
    assert arrays.has_attribute(path, "title") and arrays.has_attribute(path, "units", "lon") and not arrays.has_attribute(path, "units", "nope")
    assert (arrays.attribute_size(path, "title"), arrays.attribute_size(path, "nope")) == (1, 0)
    arrays.update_classic(path, attributes={"level": [1.0, 2.0]}, of={"lon": {"valid_min": 0.0}})
    assert arrays.read_attribute(path, "level") == [1.0, 2.0] and arrays.attribute_size(path, "level") == 2
    arrays.standard_attributes(path)
    assert arrays.read_attribute(path, "units", "lon") == "own" and arrays.read_attribute(path, "standard_name", "lon") == "longitude"
    assert arrays.read_characters(path, "names") == ["alpha", "be"] and arrays.read_attribute(path, "title") == "x"
    with pytest.raises(ValueError):
        arrays.read_characters(path, "lon")


def test_grid_and_point_files(spark, tmp_path):
    g = Grid("g", Axis(0.0, 10.0, 3), Axis(5.0, 10.0, 2), CoordSystem("stereographic", "km", planet(), -40.0, 72.0, 7.5))
    cells = grids.located(grids.cells(spark, g), g.system).select("cell", "lon", "lat", "border", grids.cell_area(g).alias("area"))
    path = str(tmp_path / "g.nc")
    arrays.write_grid(g, path, cells)
    f = arrays.ClassicFile(path)
    assert f.steps("x", 0, 3).tolist() == [0.0, 10.0, 20.0] and f.steps("area", 0, 2).tolist() == [[100.0] * 3] * 2
    assert f.vars["crs"]["attributes"]["angle_of_oblique_tangent"] == 7.5 and f.vars["lon"]["attributes"]["grid_mapping"] == "crs"
    assert f.steps("lon", 0, 2)[0, 0] == pytest.approx(-40.0)
    arrays.write_points(spark.createDataFrame([(2, 5.0), (1, None)], "pt int, lon double"), str(tmp_path / "p.nc"))
    assert arrays.ClassicFile(str(tmp_path / "p.nc")).steps("lon", 0, 2).tolist() == [-9999.0, 5.0]
    assert arrays.grid_mapping(CoordSystem("polar_stereographic", "km", planet(), 0.0, -90.0, 19.0))["standard_parallel"] == -71.0


def test_read_and_remap(spark, tmp_path):
    spark.dataSource.register(arrays.ClassicSource)
    path = str(tmp_path / "f.nc")
    arrays.write_classic(path, {"j": 2, "i": 2}, {"v": (["j", "i"], np.array([[1.0, 2.0], [3.0, 4.4]]), {})})
    l = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 4, 1.0)], "dst long, src long, w double")
    read = lambda size, kind, links=l: {r["dst"]: r["value"] for r in arrays.read_remapped(spark, path, links, size, "v", kind, dims=("i_idx", "j_idx")).collect()}
    assert read((2, 1), "double") == {1: 1.5, 2: 4.4}
    assert read((2, 1), "integer") == {1: 2, 2: 4} and read((2, 1), "logical") == {1: True, 2: True}
    assert read((2, 2), "double") == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.4} and read((9, 9), "double", None) == read((2, 2), "double")


def test_series_files(spark, tmp_path):
    text = tmp_path / "s.txt"
    text.write_text("# t a b\n0 0 100\n1000 10 200\n")
    nc = str(tmp_path / "s.nc")
    arrays.write_classic(nc, {"month": 3, "time": 2}, {"time": (["time"], np.array([0.0, 1000.0]), {}), "v": (["month", "time"], np.array([[1.0, 11.0], [2.0, 12.0], [3.0, 13.0]]), {}), "v_sd": (["month", "time"], np.full((3, 2), 2.0), {})})
    nl = Namelist(f"&a\n filename = '{text}'\n/\n&b\n filename = '{nc}'\n varname = 'v'\n time_name = 'time'\n sigma_name = 'v_sd'\n/\n")
    a = arrays.series_from_namelist(spark, nl, "a")
    assert sorted(tuple(r) for r in a.collect()) == [(0.0, 1, 0.0, None), (0.0, 2, 100.0, None), (1000.0, 1, 10.0, None), (1000.0, 2, 200.0, None)]
    b = arrays.series_from_namelist(spark, nl, "b")
    assert sorted(tuple(r) for r in b.where("time = 1000").collect()) == [(1000.0, 1, 11.0, 2.0), (1000.0, 2, 12.0, 2.0), (1000.0, 3, 13.0, 2.0)]
    assert {r["time"]: r["value"] for r in forcing.channel_mean(b).collect()} == {0.0: 2.0, 1000.0: 12.0}


# --- generators and variables ---------------------------------------------------------------------


def test_forcing_from_a_series(spark):
    s = spark.createDataFrame([(0.0, 1, 0.0), (1000.0, 1, 10.0), (2000.0, 1, 30.0)], "time double, channel int, value double")
    t = spark.createDataFrame([(500.0,), (1500.0,), (3000.0,)], "time double")
    out = {r["time"]: (r["f_mean"], r["f"]) for r in forcing.from_series(s, t, width=500.0).collect()}
    assert out == {500.0: (5.0, 5.0), 1500.0: (20.0, 20.0), 3000.0: (30.0, 30.0)}
    two = s.unionByName(s.select("time", F.lit(2).alias("channel"), (F.col("value") + 4).alias("value")))
    assert {r["time"]: r["f_mean"] for r in forcing.from_series(two, t, width=500.0).collect()} == {500.0: 7.0, 1500.0: 22.0, 3000.0: 32.0}
    noisy = forcing.from_series(two, t, sigma=1.0, width=500.0, channels=True).collect()
    assert len(noisy) == 6 and all((r["f"] == r["f_mean"]) == (r["time"] == 500.0) for r in noisy)


def test_restart_goes_on_where_it_stopped(spark):
    p = Forcing("PI42", dt_ave=200.0, tol=0.1, df_dt_max=0.01, f_min=0.0, f_max=10.0)
    rows = spark.createDataFrame([(k, 50.0 * i, 0.0, -0.5 * math.exp(-i / 20)) for k in "ab" for i in range(60)], "key string, time double, var double, dv_dt double")
    whole = {(r["key"], r["time"]): r["f"] for r in forcing.run_batch(rows, p).collect()}
    first, second = rows.where("time < 1500"), rows.where("time >= 1500")
    states = forcing.final_states(first, p)
    got = {(r["key"], r["time"]): r["f"] for r in forcing.run_batch(second, p, restart=states).collect()}
    assert got == {k: v for k, v in whole.items() if k[1] >= 1500}


def test_steps_are_appended_by_time(spark, tmp_path):
    path = str(tmp_path / "series")
    step = lambda t, f: spark.createDataFrame([(t, f, 0.5, 0.1)], "time double, f double, df_dt double, dv_dt_ave double")
    forcing.write_steps(step(0.0, 1.0), path, "co2")
    forcing.write_steps(step(1.0, 2.0), path, "co2")
    out = forcing.write_steps(step(1.0, 3.0), path, "co2")
    assert sorted(tuple(r) for r in out.collect()) == [(0.0, 1.0, 0.5, 0.1), (1.0, 3.0, 0.5, 0.1)]
    assert out.columns == ["time", "co2_f", "co2_df_dt", "co2_dv_dt"]


def test_generator_from_a_namelist():
    text = "&tsgen\n method='ramp-time'\n sigma=0.0\n with_kill=F\n dt_ave=1.0\n dt_init=0.0\n dt_ramp=1000.0\n dt_conv=1.0\n df_sign=-3\n tol=1.0\n df_dt_max=0.0\n f_min=0.0\n f_max=10.0\n f_conv=0.0\n/\n&s\n method='series'\n sigma=2.0\n/\n&x\n method='odd'\n sigma=0.0\n/\n"
    p = Forcing.from_namelist(Namelist(text))
    assert (p.method, p.df_sign, p.dt_ramp, p.f_max) == ("ramp-time", -1.0, 1000.0, 10.0)
    assert Forcing.from_namelist(Namelist(text), "s").sigma == 2.0
    with pytest.raises(ValueError):
        Forcing.from_namelist(Namelist(text), "x")


def test_variable_from_a_namelist(spark, tmp_path):
    path = str(tmp_path / "grl" / "temp")
    rows = [(i, t, float(t + 100 * (i - 1))) for i in (1, 2, 3) for t in range(1, 11)]
    spark.createDataFrame(rows, "x int, t_idx long, value double").write.parquet(path)
    nl = Namelist(f"&temp\n filename = '{tmp_path}/{{domain}}/temp'\n name = 'temp'\n units = \"K\" \"K\"\n scaling = 2.0 5.0\n time = 1.0, 1.0, 10.0, 1.0\n/\n")
    v = slices.Variable.from_namelist(nl, "temp", domain="grl")
    got = lambda *a, **k: {r["x"]: r["value"] for r in v.update(spark, *a, **k).collect()}
    assert got(5.0) == {1: 15.0, 2: 215.0, 3: 415.0} and v.parts_of_a_year == 1
    assert got(4.5, method="interp") == {1: 14.0, 2: 214.0, 3: 414.0}
    assert got(1.0, 10.0, "range_mean") == {1: 16.0, 2: 216.0, 3: 416.0}
    assert v.update(spark, 3.0, 5.0, "range").count() == 9
    assert set(got(5.0, 11.0, "range").values()) == {None}
    short = slices.Variable(path, "temp", with_time=True, axis=(1.0, 9.0), step=1.0)
    with pytest.raises(ValueError):
        short.load(spark)
    with pytest.raises(ValueError):
        v.update(spark, 1.0, method="odd")


# --- distances ------------------------------------------------------------------------------------


def swept(mask, px, py):
    """The two sweeps cell by cell."""
    n, m = mask.shape
    d, wraps = np.where(mask == 0, 0.0, 1e9), px or py
    for _ in range(100 if wraps else 1):
        old = d.copy()
        for sign in (1, -1):
            order = lambda k: range(0 if wraps else 1, k)
            for b in order(m):
                for a in order(n):
                    i, j = (a, b) if sign > 0 else (n - 1 - a, m - 1 - b)
                    for di, dj, w in ((-1, 0, 1), (0, -1, 1), (-1, -1, math.sqrt(2)), (1, -1, math.sqrt(2))):
                        p, q = i + sign * di, j + sign * dj
                        p, q = p % n if px else p, q % m if py else q
                        if 0 <= p < n and 0 <= q < m:
                            d[i, j] = min(d[i, j], d[p, q] + w)
        if not wraps or (d == old).all():
            break
    return np.where(mask < 0, -d, d)


@pytest.mark.parametrize(("px", "py"), [(False, False), (True, False), (False, True), (True, True)])
def test_distance_to_mask(px, py):
    rng = np.random.default_rng(6)
    for shape in ((7, 9), (9, 4), (2, 3)):
        mask = rng.choice([-1, 0, 1, 1, 1], shape)
        mask[0, 0] = 0
        assert stencil.distance_to_mask(mask, px, py) == pytest.approx(swept(mask, px, py), abs=1e-6)
