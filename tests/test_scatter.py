import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import stencil

NX, NY = 5, 4


def field(spark, z, use):
    rows = [(g, i + 1, j + 1, None if np.isnan(z[g, i, j]) else float(z[g, i, j]), bool(use[g, i, j])) for g in range(len(z)) for i in range(NX) for j in range(NY)]
    return spark.createDataFrame(rows, "g int, i int, j int, value double, use boolean")


def reflected(k, n):
    return -1 - k if k < 0 else 2 * n - 1 - k if k >= n else k


@pytest.mark.parametrize("mask", [None, "use"])
def test_convolution_is_the_sum_over_neighbours(spark, mask):
    """A lopsided kernel wider than half of the field, several slices, missing and masked cells."""
    rng = np.random.default_rng(3)
    z, use = rng.normal(size=(2, NX, NY)), rng.random((2, NX, NY)) > 0.3
    z[1, 2, 2] = np.nan
    kernel = [(-3, 0, 0.5), (-1, 1, 0.25), (0, 0, 1.0), (2, -2, -0.75), (3, 3, 0.125)]
    got = {(r["g"], r["i"] - 1, r["j"] - 1): r["value"] for r in stencil.convolve(field(spark, z, use), kernel, NX, NY, ["g"], mask=mask).collect()}
    assert len(got) == z.size
    for (g, i, j), v in got.items():
        seen = [(w, z[g, p, q]) for a, b, w in kernel for p, q in [(reflected(i + a, NX), reflected(j + b, NY))] if mask is None or use[g, p, q]]
        there = [(w, x) for w, x in seen if not np.isnan(x)]
        want = z[g, i, j]
        if there and (mask is None or use[g, i, j]):
            want = sum(w * x for w, x in there) + (sum(w for *_, w in kernel) - sum(w for w, _ in seen)) / len(seen) * sum(x for _, x in there)
        assert v is None if np.isnan(want) else v == pytest.approx(want)


def test_convolution_broadcasts_no_field(spark):
    g = spark.range(NX * NY).select((F.col("id") % NX + 1).alias("i"), (F.floor(F.col("id") / NX) + 1).alias("j"), F.col("id").cast("double").alias("value"))
    plan = stencil.convolve(g, [(0, 0, 0.5), (1, 0, 0.5)], NX, NY)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_masked_gauss_broadcasts_no_field(spark):
    g = spark.range(NX * NY).select((F.col("id") % NX + 1).alias("i"), (F.floor(F.col("id") / NX) + 1).alias("j"), F.col("id").cast("double").alias("value"), (F.col("id") % 3 > 0).alias("use"))
    plan = stencil.gauss_masked(g, 1.2, 1.0, NX, NY, "use")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
