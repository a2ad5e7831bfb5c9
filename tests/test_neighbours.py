"""Nearest neighbours against brute force, on points that a lattice does not suit."""

import numpy as np
import pytest

from gridwake.functions import geo
from gridwake.operators import neighbours


def tables(spark, t, s, extra=()):
    names = ["x", "y", "z"][: t.shape[1]]
    kind = ", ".join(f"{c} double" for c in names)
    a = spark.createDataFrame([(i, *map(float, p), 1) for i, p in enumerate(t)] + [(10_000 + n, *p, 1) for n, p in enumerate(extra)], f"dst long, {kind}, leaf int")
    b = spark.createDataFrame([(i, *map(float, p), 1) for i, p in enumerate(s)] + [(20_000 + n, *p, 1) for n, p in enumerate(extra)], f"src long, {kind}, part int")
    return a.repartition(3), b.repartition(4), tuple(names)


def brute(t, s, k, dist_max=np.inf):
    out = {}
    for i, p in enumerate(t):
        d = np.sqrt(((s - p) ** 2).sum(1))
        best = np.lexsort((np.arange(len(s)), d))[:k]
        out |= {(i, r): (int(j), d[j]) for r, j in enumerate(best, 1) if d[j] <= dist_max}
    return out


def result(df):
    return {(r["dst"], r["rank"]): (r["src"], pytest.approx(r["dist"], abs=1e-12)) for r in df.collect()}


def clustered(rng, n, dims=2):
    """Dense clusters, a thin line, copies of one place, and a few points far away."""
    near = rng.normal(size=(n, dims)) * 1e-3 + rng.integers(0, 3, (n, 1)) * 50
    near[: n // 8] = 7.0
    near[n // 8 : n // 4, 1:] = 3.0
    near[-3:] = 1e6 + rng.normal(size=(3, dims))
    return near


@pytest.mark.parametrize(("dims", "k", "dist_max"), [(2, 4, None), (3, 6, None), (2, 3, 0.5)])
def test_uneven_points(spark, dims, k, dist_max):
    rng = np.random.default_rng(dims)
    s = clustered(rng, 700, dims)
    t = np.concatenate([clustered(rng, 60, dims), rng.uniform(-100, 200, (30, dims)), np.full((20, dims), 7.0), np.full((1, dims), -1e7)])
    a, b, names = tables(spark, t, s, [(None, *[1.0] * (dims - 1)), (float("nan"), *[1.0] * (dims - 1))])
    assert result(neighbours.nearest(a, b, k, names, dist_max, leaf=40)) == brute(t, s, k, np.inf if dist_max is None else dist_max)


def test_few_and_no_points(spark):
    a, b, names = tables(spark, np.zeros((3, 2)), np.array([[1.0, 0.0], [0.0, 1.0]]))
    got = [tuple(r) for r in neighbours.nearest(a, b, 5, names).orderBy("dst", "rank").collect()]
    assert got == [(i, j, 1.0, j + 1) for i in range(3) for j in range(2)]
    assert neighbours.nearest(a.where("false"), b, 5, names).count() == 0
    assert neighbours.nearest(a, b.where("false"), 5, names).count() == 0


def test_pairs_stay_within_a_factor_of_k():
    rng = np.random.default_rng(4)
    s = clustered(rng, 4000)[500:]
    t = clustered(rng, 400)[50:]
    d, who, pairs = neighbours.Boxes(s).nearest(t, np.full(len(t), np.inf), 6)
    want = brute(t, s, 6)
    assert all(d[i, r - 1] == pytest.approx(x**2, rel=1e-9, abs=1e-9) for (i, r), (_, x) in want.items())
    assert pairs < 20 * 6 * len(t)  # all pairs would be 583 times k


def test_a_far_target_meets_few_blocks(spark, monkeypatch):
    """Blocks that targets are sent to in the second round: those whose boxes the bound reaches, not the whole cluster."""
    rng = np.random.default_rng(6)
    s, t = rng.normal(size=(2000, 2)), np.array([[1e4, 0.0], [-1e4, 5.0]])
    made = []
    kept = neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df, *b: made.append(kept(df, *b)) or made[-1])
    a, b, names = tables(spark, t, s)
    assert result(neighbours.nearest(a, b, 3, names, leaf=50)) == brute(t, s, 3)
    sent = [df for df in made if "bound" in df.columns]
    assert sent[1].count() <= 2 * 6


def test_on_the_sphere(spark):
    rng = np.random.default_rng(8)
    lon, lat = rng.uniform(-180, 180, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    lon[:60], lat[:60] = rng.choice([-179.9, 179.9], 60) + rng.normal(size=60) * 0.05, 80 + rng.normal(size=60)
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat, strict=True))], "src long, lon double, lat double")
    t = spark.createDataFrame([(0, 180.0, 80.0), (1, -180.0, 80.0), (2, 0.0, 90.0), (3, 10.0, -89.0)], "dst long, lon double, lat double")
    got = {(r["dst"], r["rank"]): (r["src"], r["dist"]) for r in neighbours.nearest_on_sphere(t, s, 4, leaf=30).collect()}
    unit = lambda lon, lat: np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], -1)
    want = brute(unit(np.array([180.0, -180, 0, 10]), np.array([80.0, 80, 90, -89])), unit(lon, lat), 4)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[0, r] for r in (1, 2, 3, 4)] == [(got[1, r][0], pytest.approx(got[1, r][1])) for r in (1, 2, 3, 4)]
    here = geo.geodesic_inverse(np.array([0.0]), np.array([90.0]), lon[[got[2, 1][0]]], lat[[got[2, 1][0]]], None)[0][0]
    assert got[2, 1][1] == pytest.approx(here)
