import math
import tracemalloc
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import spectral


def exact(n: int, x: float) -> tuple[float, float]:
    """The node next to x and its weight, with 50 digits (numpy's weights at the ends are off by 4e-9 for n = 1001)."""
    with localcontext() as c:
        c.prec = 50
        x = Decimal(float(x))
        for _ in range(4):
            before, p = Decimal(1), x
            for j in range(1, n):
                before, p = p, ((2 * j + 1) * x * p - j * before) / (j + 1)
            slope = n * (before - x * p) / (1 - x * x)
            x, moved = x - p / slope, p / slope
        assert abs(moved) < Decimal("1e-40")
        return float(x), float(2 / ((1 - x * x) * slope * slope))


@pytest.mark.parametrize("n", [257, 400, 1001])
def test_nodes_and_weights_are_exact(n):
    x, w = spectral.gauss_nodes(n)
    assert np.abs(x - np.polynomial.legendre.leggauss(n)[0]).max() < 1e-15
    for k in (0, 1, 28, 29, 30, 31, n // 2, n - 30, n - 1):
        node, weight = exact(n, x[k])
        assert abs(x[k] - node) < 1e-15 and w[k] == pytest.approx(weight, rel=1e-11)
    part = spectral.gauss_nodes(n, 20, 240)
    assert np.array_equal(part[0], x[20:240]) and np.array_equal(part[1], w[20:240])


def test_nodes_of_many_latitudes_need_no_matrix():
    """A matrix of them would take 7 GB."""
    tracemalloc.start()
    x, w = spectral.gauss_nodes(30000)
    assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()
    assert np.all(np.diff(x) > 0)
    for power in (0, 2, 4, 40):
        assert math.fsum(w * x**power) == pytest.approx(2 / (power + 1), rel=1e-12)


def test_blocks_of_latitudes_add_up(spark, monkeypatch):
    """Fields of unlike sizes in blocks of a few latitudes, one of them with a missing cell."""
    monkeypatch.setattr(spectral, "HELD", 100)
    rng = np.random.default_rng(2)
    fields = {"a": rng.normal(size=(9, 8)), "b": rng.normal(size=(6, 10)), "c": rng.normal(size=(6, 10)), None: rng.normal(size=(5, 8))}
    rows = [(k, i + 1, j + 1, None if (k, j, i) == ("c", 4, 3) else float(z[j, i])) for k, z in fields.items() for j in range(z.shape[0]) for i in range(z.shape[1])]
    df = spark.createDataFrame(rows, "k string, i int, j int, value double")
    monkeypatch.setattr(spectral, "BLOCK", 20)
    out = {(r["k"], r["l"], r["m"]): (r["re"], r["im"]) for r in spectral.harmonics(df, ["k"], 3).collect()}
    assert len(out) == 4 * 10
    for k, z in fields.items():
        c = spectral.analyse(z, 3)
        for l in range(4):
            for m in range(l + 1):
                re, im = out[k, l, m]
                assert (re is None or math.isnan(re)) if k == "c" else complex(re, im) == pytest.approx(c[l, m], abs=1e-12)


def test_a_field_is_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 16)
    df = spark.range(8 * 12).select((F.col("id") % 8 + 1).alias("i"), (F.floor(F.col("id") / 8) + 1).alias("j"), F.lit(1.0).alias("value"))
    out = spectral.harmonics(df, [], 2)
    assert "_block" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["l"], r["m"]): r["re"] for r in out.collect()}
    assert got[0, 0] == pytest.approx(math.sqrt(4 * math.pi)) and all(abs(v) < 1e-12 for k, v in got.items() if k != (0, 0))
