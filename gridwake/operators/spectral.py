"""Fourier transforms, a group per series, and spherical-harmonic ones, a group per block of latitudes, whose sums Spark adds (numpy)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells of a field that one task takes at a time, in whole latitudes; numbers of Legendre functions held at once.
BLOCK, HELD = 65536, 1 << 21


def fourier(df: DataFrame, keys: list[str], order: str = "t", value: str = "value") -> DataFrame:
    """(keys, k, re, im) of each real series in order: the n // 2 + 1 lowest frequencies, unscaled."""
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        z = np.fft.rfft(p.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame({**{c: [p[c].iloc[0]] * len(z) for c in keys}, "k": np.arange(len(z)), "re": z.real, "im": z.imag})

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "k long", "re double", "im double"]))


def inverse_fourier(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, t from 0, value) of series of length n."""
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        x = np.fft.irfft(p["re"].to_numpy() + 1j * p["im"].to_numpy(), n)
        return pd.DataFrame({**{c: [p[c].iloc[0]] * n for c in keys}, "t": np.arange(n), "value": x})

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "t long", "value double"]))


def fourier_2d(z: np.ndarray) -> np.ndarray:
    return np.fft.fft2(z)


def legendre(lmax: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions (l, m, place): with exp(i m lon) they have unit norm on the sphere."""
    out = np.zeros((lmax + 1, lmax + 1, len(x)))
    s = np.sqrt(1 - x * x)
    out[0, 0] = math.sqrt(1 / (4 * math.pi))
    for m in range(1, lmax + 1):
        out[m, m] = -math.sqrt((2 * m + 1) / (2 * m)) * s * out[m - 1, m - 1]
    for m in range(lmax):
        out[m + 1, m] = math.sqrt(2 * m + 3) * x * out[m, m]
    for m in range(lmax + 1):
        for l in range(m + 2, lmax + 1):
            a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            b = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1))
            out[l, m] = a * (x * out[l - 1, m] - b * out[l - 2, m])
    return out


def gauss_nodes(n: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes first to last - 1 of n, rising, with their weights.

    From 257 on without an n x n matrix: Newton's method on the angle, with Stieltjes' expansion of the polynomial in the
    inside and its recurrence at the 30 nodes next to either end.
    """
    last = n if last is None else last
    if n <= 256:
        x, w = np.polynomial.legendre.leggauss(n)
        return x[first:last], w[first:last]
    index = np.arange(first, last)
    k = np.minimum(index + 1, n - index)
    t = math.pi * (k - 0.25) / (n + 0.5)
    t += 1 / (8 * np.tan(t) * (n + 0.5) ** 2)
    slope = np.zeros(len(k))
    for part, f in ((k <= 30, _recurrence), (k > 30, _stieltjes)):
        if part.any():
            a = t[part]
            for _ in range(4):
                p, slope[part] = f(n, a)
                a = a - p / slope[part]
            t[part] = a
    return np.where(index < n / 2, -1.0, 1.0) * np.cos(t), 2 / slope**2


def _recurrence(n: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Legendre polynomial of cos t and its derivative by t; differences keep small angles exact."""
    low = 2 * np.sin(t / 2) ** 2  # 1 - cos t
    step, p = -low, 1 - low
    for j in range(1, n):
        step = (j * step - (2 * j + 1) * low * p) / (j + 1)
        p = p + step
    return p, n * (step - low * p) / np.sin(t)


def _stieltjes(n: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by 12 terms, which leave less than 1e-16 from the 31st node on."""
    scale = 4 / math.pi * math.exp(-np.log1p(0.5 / np.arange(1, n + 1)).sum())
    s, c = 2 * np.sin(t), 2 * np.cos(t)
    p, slope = np.zeros(len(t)), np.zeros(len(t))
    h = scale / np.sqrt(s)
    for m in range(12):
        turn = (n + m + 0.5) * t - (m + 0.5) * math.pi / 2
        p += h * np.cos(turn)
        slope -= h * ((n + m + 0.5) * np.sin(turn) + (m + 0.5) * c / s * np.cos(turn))
        h = h * (m + 0.5) ** 2 / ((m + 1) * (n + m + 1.5)) / s
    return p, slope


def _analyse_lines(z: np.ndarray, lmax: int, nlat: int, first: int) -> np.ndarray:
    """What the latitudes from `first` on add to the coefficients."""
    modes = np.fft.rfft(z, axis=1)[:, : lmax + 1] * (2 * math.pi / z.shape[1])
    x, w = gauss_nodes(nlat, first, first + len(z))
    n = max(1, HELD // (lmax + 1) ** 2)
    return sum(np.einsum("lmj,jm->lm", legendre(lmax, x[k : k + n]), modes[k : k + n] * w[k : k + n, None]) for k in range(0, len(z), n))


def analyse(z: np.ndarray, lmax: int) -> np.ndarray:
    """Coefficients (l, m >= 0) of a real field (Gaussian latitude, longitude) by one FFT a latitude and a Gauss sum."""
    return _analyse_lines(z, lmax, len(z), 0)


def synthesize(c: np.ndarray, nlat: int, nlon: int) -> np.ndarray:
    """The field of the coefficients on Gaussian latitudes from south to north."""
    lmax = len(c) - 1
    x, _ = gauss_nodes(nlat)
    modes = np.einsum("lmj,lm->jm", legendre(lmax, x), c)
    full = np.zeros((nlat, nlon // 2 + 1), complex)
    full[:, : lmax + 1] = modes
    return np.fft.irfft(full * nlon, nlon, axis=1)


def evaluate(c: np.ndarray, lon: float, lat: float) -> float:
    """The field of the coefficients at one place (degrees)."""
    lmax = len(c) - 1
    p = legendre(lmax, np.array([math.sin(math.radians(lat))]))[:, :, 0]
    turn = np.exp(1j * np.arange(lmax + 1) * math.radians(lon))
    weight = np.where(np.arange(lmax + 1) == 0, 1, 2)
    return float((p * c * turn * weight).real.sum())


def harmonics(df: DataFrame, keys: list[str], lmax: int, value: str = "value") -> DataFrame:
    """(keys, l, m, re, im) of fields (keys, i: longitude from 1, j: Gaussian latitude from 1, south to north).

    Each block of latitudes gives its part of every coefficient; a coefficient is NULL if any part has missing cells.
    """
    kinds = dict(df.dtypes)
    sizes = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("i").cast("long").alias("_nlon"), F.max("j").cast("long").alias("_nlat"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = df.join(sizes, same) if keys else df.crossJoin(F.broadcast(sizes))  # one row
    lines = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("_nlon")))
    rows = rows.select(*keys, "i", "j", F.col(value).alias("_v"), "_nlon", "_nlat", F.floor((F.col("j") - 1) / lines).alias("_block"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        first = int(p["j"].min()) - 1
        z = np.zeros((int(p["j"].max()) - first, int(p["_nlon"].iloc[0])))
        z[p["j"].to_numpy() - 1 - first, p["i"].to_numpy() - 1] = p["_v"].to_numpy(float)
        c = _analyse_lines(z, lmax, int(p["_nlat"].iloc[0]), first)
        l, m = np.tril_indices(lmax + 1)
        return pd.DataFrame({**{k: [p[k].iloc[0]] * len(l) for k in keys}, "l": l, "m": m, "re": c[l, m].real, "im": c[l, m].imag})

    parts = rows.groupBy(*keys, "_block").applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "l long", "m long", "re double", "im double"]))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    return parts.groupBy(*keys, "l", "m").agg(whole("re"), whole("im"))
