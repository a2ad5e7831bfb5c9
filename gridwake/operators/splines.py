"""Cubic splines of series of any length.

A spline's second derivatives solve one tridiagonal system a key. Here a key's points lie in chunks of consecutive
places. Each chunk eliminates its inside, which leaves its first and last unknown as a linear function of its
neighbours' (one number each); these few rows a key are solved together, and each chunk puts the results back in.
Probes then meet the piece that they lie on by a bracketing join. No task holds more than a chunk, or a key's list
of chunks.

End pieces have the third derivatives of the cubics through the first and last four points; two points are joined by
a line, one is a constant. Beyond the ends the curve is reflected about the end's point. Points with a null place or value
are left out, of several at one place the least value counts; a probe whose key has no points has no value, one
without a place neither, and keys are not null; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.operators.series import bracket
from gridwake.operators.solvers import cut

CHUNK = 1 << 16


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with a[i] x[i-1] + b[i] x[i] + c[i] x[i+1] = r[i] for each column of r: cyclic reduction, all rows at once."""
    n, step = len(b), 1
    a, c = a.copy(), c.copy()
    a[:1] = c[-1:] = 0
    while step < n:
        up = lambda x, empty=0.0, s=step: np.concatenate([np.full((s, *x.shape[1:]), empty), x[:-s]])
        down = lambda x, empty=0.0, s=step: np.concatenate([x[s:], np.full((s, *x.shape[1:]), empty)])
        f, g = -a / up(b, 1.0), -c / down(b, 1.0)
        a, b, c, r = f * up(a), b + f * up(c) + g * down(a), g * down(c), r + f[:, None] * up(r) + g[:, None] * down(r)
        step *= 2
    return r / b[:, None]


def third(x: np.ndarray, y: np.ndarray) -> float:
    """A sixth of the third derivative of the cubic through four points."""
    d = np.diff(y) / np.diff(x)
    return ((d[2] - d[1]) / (x[3] - x[1]) - (d[1] - d[0]) / (x[2] - x[0])) / (x[3] - x[0])


class Chunk:
    """Consecutive points of a curve with those before and behind (nan at its ends), and the rows of their unknowns.

    opens, closes: right sides of the curve's first and last row; few: the curve has fewer than three points.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, before: tuple, behind: tuple, opens: float, closes: float, few: bool):
        self.y, n = y, len(x)
        x, y = (np.concatenate([[b], v, [e]]) for b, v, e in ((before[0], x, behind[0]), (before[1], y, behind[1])))
        h, d = np.diff(x), np.diff(y) / np.diff(x)  # of the pieces before and behind each point
        self.h, self.d = h[1:], d[1:]
        a, b, c, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), np.diff(d)
        if np.isnan(before[0]):
            a[0], b[0], r[0] = 0, -c[0], opens
        if np.isnan(behind[0]):
            c[-1], b[-1], r[-1] = 0, -a[-1], closes
        if few:
            a, b, c, r = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        sides = np.zeros((n, 3))
        sides[:, 0], sides[0, 1], sides[-1, 2] = r, -a[0], -c[-1]
        self.solved = tridiagonal(a, b, c, sides)  # own part, and what one unit of the unknown before and behind gives

    def ends(self) -> np.ndarray:
        return np.concatenate([self.solved[0], self.solved[-1]])

    def pieces(self, left: float, right: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients of the pieces that begin at the points, given the unknowns before and behind (0 at the curve's ends)."""
        s = self.solved @ np.array([1.0, left, right])
        after = np.append(s[1:], right)
        with np.errstate(invalid="ignore"):
            b, c, d = self.d - self.h * (after + 2 * s), 3 * s, (after - s) / self.h
        return np.nan_to_num(b), c, np.nan_to_num(d)


def joined(ends: np.ndarray) -> np.ndarray:
    """(unknown before, unknown behind) of each chunk of a curve, from the rows of Chunk.ends, by blocks of two unknowns."""
    n = len(ends)
    u = ends.reshape(n, 2, 3)
    # z[k] = own + left * z[k-1][1] + right * z[k+1][0], solved from the first chunk on
    own, right = np.zeros((n, 2)), np.zeros((n, 2))
    for k in range(n):
        p, q, w = u[k].T
        if k:  # z[k-1] = own[k-1] + right[k-1] * z[k][0]
            m = np.eye(2)
            m[:, 0] -= q * right[k - 1, 1]
            p, w = np.linalg.solve(m, np.stack([p + q * own[k - 1, 1], w], 1)).T
        own[k], right[k] = p, w
    z = np.zeros((n, 2))
    for k in range(n - 1, -1, -1):
        z[k] = own[k] + (right[k] * z[k + 1, 0] if k < n - 1 else 0)
    return np.stack([np.append(0.0, z[:-1, 1]), np.append(z[1:, 0], 0.0)], 1)


def coefficients(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b, c, d of the pieces of one curve, points in order."""
    four = len(x) > 3
    none = (np.nan, np.nan)
    opens, closes = ((x[1] - x[0]) ** 2 * third(x[:4], y[:4]), -((x[-1] - x[-2]) ** 2) * third(x[-4:], y[-4:])) if four else (0.0, 0.0)
    return Chunk(x, y, none, none, opens, closes, len(x) < 3).pieces(0.0, 0.0)


def values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One curve at the places."""
    b, c, d = coefficients(x, y)
    low, high = at < x[0], at > x[-1]
    u = np.clip(np.where(low, 2 * x[0] - at, np.where(high, 2 * x[-1] - at, at)), x[0], x[-1])
    i = np.searchsorted(x, u, side="right") - 1
    t = u - x[i]
    out = y[i] + t * (b[i] + t * (c[i] + t * d[i]))
    return np.where(low, 2 * y[0] - out, np.where(high, 2 * y[-1] - out, out))


def pieces(points: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """points (by, x, y) with b, c, d: y + t (b + t (c + t d)) at t behind x, up to the next point."""
    kinds = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in by)
    p = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for c in ("x", "y", *by):
        p = p.where(F.col(c).isNotNull())
    p = p.where(~F.isnan("x") & ~F.isnan("y")).groupBy(*by, "x").agg(F.min("y").alias("y"))
    total = p.count()
    rows = cut(p.repartitionByRange(max(1, -(-total // chunk)), *by, "x").withColumn("_chunk", F.spark_partition_id()))

    def head(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("x")
        out = pd.DataFrame([list(key)], columns=[*by, "_chunk"])
        return out.assign(n=len(f), hx=[f["x"].head(4).tolist()], hy=[f["y"].head(4).tolist()], tx=[f["x"].tail(4).tolist()], ty=[f["y"].tail(4).tolist()])

    heads = rows.groupBy(*by, "_chunk").applyInPandas(head, f"{kinds}, _chunk int, n long, hx array<double>, hy array<double>, tx array<double>, ty array<double>")

    def around(_, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_chunk").reset_index(drop=True)
        n = int(f["n"].sum())
        first, last = ([np.concatenate(list(v)) for v in (f[a], f[b])] for a, b in (("hx", "hy"), ("tx", "ty")))
        (x, y), (u, v) = [w[:4] for w in first], [w[-4:] for w in last]
        out = f[[*by, "_chunk"]].assign(few=n < 3, opens=(x[1] - x[0]) ** 2 * third(x, y) if n > 3 else 0.0, closes=-((u[-1] - u[-2]) ** 2) * third(u, v) if n > 3 else 0.0)
        for c, ends, shift in (("bx", f["tx"].str[-1], 1), ("by_", f["ty"].str[-1], 1), ("ex", f["hx"].str[0], -1), ("ey", f["hy"].str[0], -1)):
            out[c] = ends.shift(shift)
        return out

    side = ("few boolean", "opens double", "closes double", "bx double", "by_ double", "ex double", "ey double")
    known = cut(heads.groupBy(*by).applyInPandas(around, f"{kinds}, _chunk int, {', '.join(side)}"))

    def of(f: pd.DataFrame, k: pd.DataFrame) -> tuple[pd.DataFrame, Chunk]:
        f, k = f.sort_values("x"), k.iloc[0]
        return f, Chunk(f["x"].to_numpy(), f["y"].to_numpy(), (k["bx"], k["by_"]), (k["ex"], k["ey"]), k["opens"], k["closes"], bool(k["few"]))

    def eliminated(key, f: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([list(key)], columns=[*by, "_chunk"]).assign(ends=[of(f, k)[1].ends()])

    def solved(_, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_chunk")
        z = joined(np.stack(list(f["ends"])))
        return f[[*by, "_chunk"]].assign(before=z[:, 0], behind=z[:, 1])

    def back(_, f: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        f, c = of(f, k)
        return f[[*by, "x", "y"]].assign(**dict(zip("bcd", c.pieces(k["before"].iloc[0], k["behind"].iloc[0]), strict=True)))

    keyed = [*by, "_chunk"]
    with_known = lambda other, run, schema: rows.groupBy(*keyed).cogroup(other.groupBy(*keyed)).applyInPandas(run, schema)
    ends = with_known(known, eliminated, f"{kinds}, _chunk int, ends array<double>").groupBy(*by).applyInPandas(solved, f"{kinds}, _chunk int, before double, behind double")
    return with_known(known.join(ends, keyed), back, f"{kinds}, x double, y double, b double, c double, d double")


def spline(points: DataFrame, probes: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """probes (by, x) with y by each key's spline."""
    curve = cut(pieces(points, by, chunk))
    size = curve.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span")).first()
    width = (size["span"] or 0.0) / max(1, size["n"] // 4096) or 1.0
    ends = curve.groupBy(*by).agg(F.min("x").alias("_x0"), F.min_by("y", "x").alias("_y0"), F.max("x").alias("_x1"), F.max_by("y", "x").alias("_y1"))
    x, low, high = F.col("x"), F.col("x") < F.col("_x0"), F.col("x") > F.col("_x1")
    u = F.greatest("_x0", F.least("_x1", F.when(low, 2 * F.col("_x0") - x).when(high, 2 * F.col("_x1") - x).otherwise(x)))
    known = probes.where("x is not null").join(ends, by).select(*by, F.col("x").alias("_at"), u.alias("x"), F.when(low, F.col("_y0")).when(high, F.col("_y1")).alias("_about"))
    at = bracket(curve.select(*by, "x", F.struct("y", "b", "c", "d").alias("y")), known, by, width)
    p, t = F.col("lo")["y"], F.col("x") - F.col("lo")["x"]
    y = p["y"] + t * (p["b"] + t * (p["c"] + t * p["d"]))
    out = at.select(*by, F.col("_at").alias("x"), F.when(F.col("_about").isNull(), y).otherwise(2 * F.col("_about") - y).alias("y"))
    rest = probes.where("x is null").unionByName(probes.where("x is not null").join(ends.select(*by), by, "left_anti"))
    return out.unionByName(rest.select(*by, "x", F.lit(None).cast("double").alias("y")))
