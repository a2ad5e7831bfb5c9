"""Shared areas on the sphere against pair-by-pair clipping, and against the whole sphere."""

import math

import numpy as np
import pytest

from gridwake.functions import geo
from gridwake.operators import spherical


def quad(lon, lat, a, b):
    low, high = max(float(lat - b), -90.0), min(float(lat + b), 90.0)
    return [float(lon - a), float(lon + a), float(lon + a), float(lon - a)], [low, low, high, high]


def frame(spark, cells, name):
    return spark.createDataFrame([(k, *c, 1) for k, c in enumerate(cells)], f"{name} long, lons array<double>, lats array<double>, level int").repartition(3)


def test_pairs_equal_clipping_one_by_one(spark):
    rng = np.random.default_rng(2)
    a = [quad(*rng.uniform((-180, -88), (180, 88)), *rng.uniform(0.5, 12, 2)) for _ in range(60)]
    b = [quad(*rng.uniform((-180, -88), (180, 88)), *10 ** rng.uniform(-1, 1.4, 2)) for _ in range(150)]  # from a tenth to 25 degrees
    for k in range(40):  # near the seam and the poles, small beside large
        b.append(quad(180 + rng.normal(), rng.normal() * 3, *rng.uniform(0.05, 0.5, 2)))
        b.append(quad(rng.uniform(-180, 180), 89.5 * (-1) ** k, 20, 0.5))
    a += [quad(179, 0, 6, 6), quad(-180, 0.5, 4, 4), quad(30, 85, 40, 5), ([0.0, 120.0, 240.0], [80.0, 80.0, 80.0])]
    a += [(None, [1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, None, 1.0], [0.0, 1.0, 1.0])]
    a.append((a[0][0][::-1], a[0][1][::-1]))  # turning right
    got = {(r["dst"], r["src"]): r["w"] for r in spherical.overlaps(frame(spark, a, "dst"), frame(spark, b, "src")).collect()}
    want = {}
    pa, pb = ([spherical.corners(*c) for c in cells] for cells in (a, b))
    for i, p in enumerate(pa):
        for j, q in enumerate(pb):
            if p is not None and q is not None and (w := geo.sphere_area(geo.clip_sphere(q, p))) > 1e-9:
                want[i, j] = w
    assert {k for k, w in got.items() if w > 1e-9} == set(want) and len(want) > 100
    assert all(got[k] == pytest.approx(w, rel=1e-6, abs=1e-10) for k, w in want.items())


def tiling(n, m, turn=0.0):
    """Cells between meridians and n great-circle steps of latitude: they cover the sphere without gaps."""
    lat = np.degrees(np.arcsin(np.linspace(-1, 1, m + 1)))
    return [quad(turn + 360 / n * (i + 0.5), (lat[j] + lat[j + 1]) / 2, 180 / n, (lat[j + 1] - lat[j]) / 2) for j in range(m) for i in range(n)]


def test_tilings_share_the_whole_sphere(spark):
    a, b = tiling(7, 5, 13.0), tiling(24, 16)
    links = spherical.overlaps(frame(spark, a, "dst"), frame(spark, b, "src")).collect()
    assert sum(r["w"] for r in links) == pytest.approx(4 * math.pi, rel=1e-9)
    own = {k: geo.sphere_area(spherical.corners(*c)) for k, c in enumerate(b)}
    for k, area in own.items():
        assert sum(r["w"] for r in links if r["src"] == k) == pytest.approx(area, rel=1e-7)


def test_keys_are_few_and_cover():
    rng = np.random.default_rng(5)
    most = 0
    for _ in range(300):
        lon, lat, r = rng.uniform(-180, 180), np.degrees(np.arcsin(rng.uniform(-1, 1))), 10 ** rng.uniform(-4, 1.5)
        p = spherical.corners(*quad(lon, lat, r, min(r, 80)))
        if p is None:
            continue
        level, keys = spherical.covering(p)
        most = max(most, len(keys))
        inside = rng.dirichlet(np.ones(len(p)), 20) @ p
        for x in inside / np.linalg.norm(inside, axis=1, keepdims=True):
            face = int(np.argmax(np.abs(x)))
            k, a, b = (int(v) for v in spherical._FACES[face])
            sign = 1 if x[k] > 0 else -1
            n = 1 << level
            u, v = (min(int((math.atan2(x[c], abs(x[k])) + math.pi / 4) / (math.pi / 2) * n), n - 1) for c in (a, b))
            assert ((face if sign > 0 else face + 3) * n + u) * n + v in keys
        if level > 2:
            assert all(0 <= spherical.ancestor(q, level, level - 2) < 6 * 4 ** (level - 2) for q in keys)
    assert most <= 27


def test_no_cells(spark):
    none = frame(spark, [([0.0, 1.0, 1.0], [0.0, 0.0, 1.0])], "dst").where("false")
    assert spherical.overlaps(none, frame(spark, tiling(4, 2), "src")).count() == 0
