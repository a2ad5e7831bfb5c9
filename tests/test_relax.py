"""Iterated operators: tiles against whole arrays, and whole arrays against plain loops."""

import math

import numpy as np
import pytest

from gridwake.operators import relax


def table(spark, fields, holes_absent=False):
    """Rows (k, i, j, value, use) of arrays by slice; every fifth missing cell is no row at all."""
    rows = []
    for k, z in fields.items():
        for i, j in np.ndindex(z.shape):
            if not (holes_absent and np.isnan(z[i, j]) and (i + j) % 5 == 0):
                rows.append((k, i + 3, j - 2, None if np.isnan(z[i, j]) else float(z[i, j]), int((i * j) % 7 != 3), "x"))
    return spark.createDataFrame(rows, "k string, i int, j int, value double, use int, n string").repartition(5)


def arrays(df, shapes):
    out = {k: np.full(s, np.nan) for k, s in shapes.items()}
    for r in df.collect():
        out[r["k"]][r["i"] - 3, r["j"] + 2] = np.nan if r["value"] is None else r["value"]
    return out


def fields(seed=3):
    """Slices that take unlike numbers of sweeps."""
    rng = np.random.default_rng(seed)
    a, b, c = (5 + rng.normal(size=s) for s in ((37, 29), (25, 44), (6, 5)))
    a[rng.random(a.shape) < 0.3] = np.nan
    b[4:21, 6:40] = np.nan
    c[1:4, 1:3] = np.nan
    return {"a": a, "b": b, "c": c, "d": 5 + rng.normal(size=(1, 9))}


def use_of(z):
    return np.fromfunction(lambda i, j: (i * j) % 7 != 3, z.shape).astype(float)


def poisson(z, wrap=False):
    hole = np.isnan(z).astype(float)
    count = (~np.isnan(z)).sum(0)
    first = np.where(count > 0, np.nansum(z, 0) / np.maximum(count, 1), 0.0)
    filled = np.where(np.isnan(z), first, z)
    return relax.whole(relax.Poisson(), filled, hole, first=1e-2 * abs((filled.max() + filled.min()) / 2), closed=wrap)


CASES = {
    "weighted": (lambda df, t: relax.fill_weighted(df, 2, ["k"], tile=t), lambda z: relax.whole(relax.Outwards(2), relax.whole(relax.Weighted(2), z))),
    "nearest": (lambda df, t: relax.fill_nearest(df, 2, ["k"], tile=t), lambda z: relax.whole(relax.Outwards(2), relax.whole(relax.Nearest(2), z))),
    "nearest_masked": (lambda df, t: relax.fill_nearest(df, 1, ["k"], mask="use", tile=t), lambda z: relax.whole(relax.Outwards(1), relax.whole(relax.Nearest(1), z, use_of(z)), use_of(z))),
    "mean": (lambda df, t: relax.fill_mean(df, ["k"], tile=t), lambda z: relax.whole(relax.BoxMean(), z)),
    "poisson": (lambda df, t: relax.fill_poisson(df, "zonal", keys=["k"], tile=t), poisson),
    "poisson_wrapped": (lambda df, t: relax.fill_poisson(df, "zonal", True, keys=["k"], tile=t), lambda z: poisson(z, True)),
    "diffuse": (lambda df, t: relax.diffuse(df, 5, ["k"], tile=t), lambda z: relax.whole(relax.Diffusion(5), z)),
    "gradient": (lambda df, t: relax.limit_gradient(df, 1.0, 2.0, 0.3, 40, ["k"], mask="use", tile=t), lambda z: relax.whole(relax.Gradient(1.0, 2.0, 0.3, 40), z, use_of(z))),
}


@pytest.mark.parametrize("name", CASES)
def test_tiles_equal_the_whole_array(spark, name):
    (tiled, array), tile = CASES[name], 12
    made = fields()
    got = arrays(tiled(table(spark, made), tile), {k: z.shape for k, z in made.items()})
    for k, z in made.items():
        np.testing.assert_allclose(got[k], array(z), rtol=1e-12, atol=1e-12, err_msg=k)


def test_cells_that_are_no_rows(spark):
    z = fields()
    z = {k: z[k] for k in "ac"}
    got = arrays(relax.fill_weighted(table(spark, z, True), 2, ["k"], tile=12), {k: v.shape for k, v in z.items()})
    for k, v in z.items():
        want = CASES["weighted"][1](v)
        absent = np.isnan(v) & np.fromfunction(lambda i, j: (i + j) % 5 == 0, v.shape)
        np.testing.assert_allclose(got[k], np.where(absent, np.nan, want), rtol=1e-12)


def test_one_field_none_and_nothing_to_go_by(spark):
    df = table(spark, {"a": np.full((20, 9), np.nan)})
    for f in (relax.fill_weighted, relax.fill_nearest):
        assert f(df, 2, tile=8).where("value is not null").count() == 0
    assert relax.fill_mean(df, tile=8).count() == 180
    assert {r["value"] for r in relax.fill_poisson(df, "mean", tile=8).collect()} == {0.0}
    assert relax.fill_mean(df.where("false")).count() == 0
    assert relax.diffuse(df.withColumn("value", df["i"] * 2.0), 0, tile=8).where("value = 2 * i").count() == 180


@pytest.mark.parametrize("side", [1, 2, 3, 4, 5, 8, 9])
def test_small_fields(side):
    z = np.arange(side * side, dtype=float).reshape(side, side)
    z[side // 2, side // 2] = np.nan
    for rule in (relax.Weighted(4), relax.Nearest(4)):
        out = relax.whole(relax.Outwards(4), relax.whole(rule, z))
        assert np.isnan(out).sum() == (side == 1)
        assert (out == z)[~np.isnan(z)].all()
    assert relax.whole(relax.BoxMean(), z).shape == z.shape


def test_weighted_fill_equals_a_plain_loop():
    z = fields()["b"]
    got = relax.whole(relax.Weighted(2), z)
    want, r, least = z.copy(), 2, 4
    n, m = z.shape
    for _ in range(400):
        new, most = want.copy(), 0
        for i in range(r, n - r):
            for j in range(r, m - r):
                if np.isnan(want[i, j]):
                    box = want[i - r : i + r + 1, j - r : j + r + 1]
                    w = np.array([[1 / max(0.1, math.hypot(a, b)) for b in range(-r, r + 1)] for a in range(-r, r + 1)]) * ~np.isnan(box)
                    quads = sum(bool((w[s, t] > 0).any()) for s in (slice(r, None), slice(0, r)) for t in (slice(r, None), slice(0, r)))
                    most = max(most, quads)
                    if quads >= least:
                        new[i, j] = np.nansum(w * np.nan_to_num(box)) / w.sum()
        want, least = new, most
        if not np.isnan(want[r + 1 : n - r - 1, r + 1 : m - r - 1]).any():
            break
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_poisson_equals_a_plain_loop():
    z = fields()["a"]
    free = np.isnan(z)
    z = np.where(free, 0.0, z)
    limit = 0.05
    want = z.copy()
    n, m = z.shape
    for _ in range(1000):
        new, worst = want.copy(), 0.0
        for i, j in zip(*np.nonzero(free), strict=True):
            near = [want[i - 1 if i else 1, j], want[i + 1 if i < n - 1 else n - 2, j], want[i, j - 1 if j else 1], want[i, j + 1 if j < m - 1 else m - 2]]
            residual = sum(near) / 4 - want[i, j]
            new[i, j] += residual / 2
            worst = max(worst, abs(residual))
        want = new
        if worst <= limit:
            break
    np.testing.assert_allclose(relax.whole(relax.Poisson(), z, free.astype(float), first=limit), want, rtol=1e-12)


def test_fill_mean_equals_a_plain_sweep():
    rng = np.random.default_rng(5)
    z = np.where(rng.random((7, 6)) < 0.6, np.nan, rng.random((7, 6)))
    filled = np.full(z.shape, np.nan)
    for i in range(1, 6):
        for j in range(1, 5):
            box = z[i - 1 : i + 2, j - 1 : j + 2]
            filled[i - 1 : i + 2, j - 1 : j + 2] = np.where(np.isnan(box), np.nan if np.isnan(box).all() else np.nanmean(box), box)
    got, _ = relax.BoxMean().sweep(relax.Block(z, np.arange(7), np.arange(6), (7, 6)), 0.0)
    assert got == pytest.approx(np.where(np.isnan(z), filled, z), nan_ok=True)


def test_gradient_is_limited():
    z = np.zeros((6, 6))
    z[2, 2] = 10
    assert np.abs(np.diff(relax.whole(relax.Gradient(1.0, 1.0, 2.0), z)[1:-1, 1:-1], axis=0)).max() <= 2.0 + 1e-9


def test_no_group_is_larger_than_a_tile_and_its_halo(spark, monkeypatch):
    """Widths of blocks that sweeps see, on a field of many tiles."""
    z = np.fromfunction(lambda i, j: np.sin(i / 3) + j, (70, 50))
    seen = spark.sparkContext.accumulator(0)

    class Watched(relax.Diffusion):
        def sweep(self, block, control):
            if max(block.z.shape) > 2 * 16 + 2 * 8:
                seen.add(1)
            return super().sweep(block, control)

    rule = Watched(6)
    out = arrays(relax.relax(table(spark, {"a": z}), [rule], ["k"], tile=16), {"a": z.shape})["a"]
    np.testing.assert_allclose(out, relax.whole(relax.Diffusion(6), z), rtol=1e-12)
    assert seen.value == 0
