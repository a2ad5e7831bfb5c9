"""Neighbourhood operators on gridded fields (slice keys, i, j, value).

One-step stencils are lag/lead windows along a row or column, or joins on shifted indices for
two-dimensional kernels. Distances to a mask need a pass along i and one along j. Operators that iterate
over a field are in relax.py.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(keys: list[str], along: str) -> Window:
    across = "j" if along == "i" else "i"
    return Window.partitionBy(*keys, across).orderBy(along)


def derivative(df: DataFrame, along: str, step: float, keys: list[str] | None = None, periodic: bool = False, edges: str = "one-sided", limit: float | None = None, value: str = "value", out: str = "slope") -> DataFrame:
    """Centred differences; second-order one-sided ones at the ends, or wrapping ones.

    edges="reference" gives the ends as another implementation computes them: the negative of the forward
    difference on the left, and on the right the forward difference at the third-last point.
    """
    w = _line(keys or [], along)
    v = F.col(value)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    slope = (after - before) / (2 * step)
    if periodic:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(v).over(whole), F.last(v).over(whole)
        at_first, at_last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        slope = (F.when(at_last, first).otherwise(after) - F.when(at_first, last).otherwise(before)) / (2 * step)
    else:
        at_first, at_last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        left = (-3 * v + 4 * after - F.lead(v, 2).over(w)) / (2 * step)
        right = (F.lag(v, 2).over(w) - 4 * before + 3 * v) / (2 * step)
        if edges == "reference":
            left, right = -left, (-3 * F.lag(v, 2).over(w) + 4 * before - v) / (2 * step)
        slope = F.when(at_first, left).when(at_last, right).otherwise(slope)
    if limit is not None:
        slope = F.greatest(F.lit(-limit), F.least(F.lit(limit), slope))
    return df.withColumn(out, slope)


def gradient(df: DataFrame, dx: float, dy: float, keys: list[str] | None = None, normalized: bool = False, value: str = "value") -> DataFrame:
    """Size of the horizontal gradient by centred differences; the outermost rows and columns repeat their neighbours'."""
    keys = keys or []
    out = df
    for along, step in (("i", dx), ("j", dy)):
        w = _line(keys, along)
        out = out.withColumn(f"_{along}", (F.lead(value).over(w) - F.lag(value).over(w)) / (2 * step))
        d = F.col(f"_{along}")
        out = out.withColumn(f"_{along}", F.when(F.lag(F.lit(1)).over(w).isNull(), F.lead(d).over(w)).when(F.lead(F.lit(1)).over(w).isNull(), F.lag(d).over(w)).otherwise(d))
    out = out.withColumn("gradient", F.hypot("_i", "_j")).drop("_i", "_j")
    if normalized:
        most = out.groupBy(*keys).agg(F.max("gradient").alias("_most"))
        out = (out.join(most, keys) if keys else out.join(F.broadcast(most))).withColumn("gradient", F.col("gradient") / F.col("_most")).drop("_most")
    return out


def laplacian_step(df: DataFrame, dx: float, dt: float, kappa: float = 1.0, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """One explicit diffusion step with the five-point Laplacian; the border stays."""
    a, b = _line(keys or [], "i"), _line(keys or [], "j")
    v = F.col(value)
    lap = (F.lag(v).over(a) + F.lead(v).over(a) + F.lag(v).over(b) + F.lead(v).over(b) - 4 * v) / (dx * dx)
    return df.withColumn(value, F.coalesce(v + kappa * dt * lap, v))


def stable_step(dx: float, dy: float, kappa: float, safety: float = 1.0) -> float:
    """The longest stable explicit step."""
    return safety * (dx * dy) ** 2 / (2 * kappa * (dx * dx + dy * dy)) if dx != dy else safety * dx * dx / (4 * kappa)


def gauss_kernel(sigma: float, radius: int | None = None) -> list[tuple[int, int, float]]:
    """(di, dj, weight) of a normalized Gaussian; the radius is ceil(4 * sigma + 0.5)."""
    r = math.ceil(4 * sigma + 0.5) if radius is None else radius
    k = [(i, j, math.exp(-0.5 * (i * i + j * j) / sigma**2)) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    total = sum(w for _, _, w in k)
    return [(i, j, w / total) for i, j, w in k]


def _reflected(index: Column, n: int) -> Column:
    return F.when(index < 1, 1 - index).when(index > n, 2 * n + 1 - index).otherwise(index)


def smooth(df: DataFrame, kernel_1d: list[tuple[int, float]], nx: int, ny: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """A separable kernel along i, then along j, with reflected borders: two window passes, no explosion of cells."""
    out = df
    for along, n in (("i", nx), ("j", ny)):
        w = _line(keys or [], along)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn("_line", F.collect_list(value).over(whole))
        at = F.col(along)
        total = sum(wt * F.get(F.col("_line"), (_reflected(at + d, n) - 1).cast("int")) for d, wt in kernel_1d)
        out = out.withColumn(value, total).drop("_line")
    return out


def gauss_smooth(df: DataFrame, sigma: float, nx: int, ny: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Gaussian filter (sigma in cells): a Gaussian is the product of its two lines. Four passes of half the width if it is too wide."""
    r = math.ceil(4 * sigma + 0.5)
    if 2 * r + 1 >= min(nx, ny) + 1:
        out = df
        for _ in range(4):
            out = gauss_smooth(out, sigma / 2, nx, ny, keys, value)
        return out
    k = [(d, math.exp(-0.5 * d * d / sigma**2)) for d in range(-r, r + 1)]
    total = sum(w for _, w in k)
    return smooth(df, [(d, w / total) for d, w in k], nx, ny, keys, value)


def _scattered(cells: DataFrame, kernel: list[tuple[int, int, float]], nx: int, ny: int, keys: list[str], value: str, corners: bool = True) -> DataFrame:
    """(keys, i, j, w, v): each cell at all places whose kernel reaches it, directly or by reflection at a side (corners: at two).

    Cells near each other go to the same places, so sums over places combine before their shuffle, and nothing is joined.
    """
    weights = {(a, b): w for a, b, w in kernel}
    di, dj = sorted({a for a, _ in weights}), sorted({b for _, b in weights})

    def places(c: str, n: int, steps: list[int]) -> Column:
        images = [(F.col(c), True), (1 - F.col(c), False), (2 * n + 1 - F.col(c), False)]
        out = F.array(*[F.struct((u - d).alias("at"), F.lit(k).alias("k"), F.lit(direct).alias("direct")) for k, d in enumerate(steps) for u, direct in images])
        return F.filter(out, lambda p: p["at"].between(1, n))

    table = F.array(*[F.lit(weights.get((a, b))).cast("double") for a in di for b in dj])
    both = cells.select(*keys, F.col(value).alias("v"), places("i", nx, di).alias("_i"), places("j", ny, dj).alias("_j"))
    both = both.withColumn("_i", F.explode("_i")).withColumn("_j", F.explode("_j"))
    if not corners:
        both = both.where(F.col("_i.direct") | F.col("_j.direct"))
    w = F.get(table, F.col("_i.k") * len(dj) + F.col("_j.k"))
    return both.select(*keys, F.col("_i.at").alias("i"), F.col("_j.at").alias("j"), w.alias("w"), "v").where("w is not null")


def convolve(df: DataFrame, kernel: list[tuple[int, int, float]], nx: int, ny: int, keys: list[str] | None = None, value: str = "value", mask: str | None = None) -> DataFrame:
    """Any kernel, with reflected borders. Masked-out cells stay, and their weight is spread evenly over the others."""
    keys = keys or []
    use = F.col(mask).cast("boolean") if mask else F.lit(True)
    met = _scattered(df.where(use), kernel, nx, ny, keys, value).groupBy(*keys, "i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("v").alias("sv"), F.sum("w").alias("sw"), F.count("*").alias("n"))
    whole = sum(w for _, _, w in kernel)
    new = F.col("wv") + (F.lit(whole) - F.col("sw")) / F.col("n") * F.col("sv")
    # a row a cell: as large as the field, so it is never broadcast
    out = df.join(met.select(*keys, "i", "j", new.alias("_new")).hint("merge"), [*keys, "i", "j"], "left")
    return out.withColumn(value, F.when(use, F.coalesce("_new", value)).otherwise(F.col(value))).drop("_new")


def gauss_masked(df: DataFrame, sigma: float, dx: float, nx: int, ny: int, mask: str, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Gaussian filter (sigma in units of dx, cut at 1.5 sigma) over the cells that a mask holds, its weights renormalized.

    Cells beyond a side are reflected, those beyond a corner are not seen. A cell without any such neighbour stays.
    """
    if sigma > 0.5 * min(nx, ny) * dx:
        raise ValueError("sigma must be less than half of the grid's width")
    keys = keys or []
    r = math.ceil(1.5 * sigma / dx)
    kernel = [(a, b, math.exp(-0.5 * (a * a + b * b) * (dx / sigma) ** 2)) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    src = df.where(F.col(mask).cast("boolean"))
    met = _scattered(src, kernel, nx, ny, keys, value, corners=False).groupBy(*keys, "i", "j").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_new"))
    # as in convolve, never broadcast
    return df.join(met.hint("merge"), [*keys, "i", "j"], "left").withColumn(value, F.coalesce("_new", value)).drop("_new").select(*df.columns)


def subgrid(df: DataFrame, n: int, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """n x n samples (a, b) of each cell, bilinear between its corners, which are means of the cells around; n = 1 gives the cell."""
    keys = keys or []
    a, b = _line(keys, "i"), _line(keys, "j")
    v = F.col(value)
    wide = df.withColumns({"_w": F.coalesce(F.lag(v).over(a), v), "_e": F.coalesce(F.lead(v).over(a), v)})
    s = lambda c: F.coalesce(F.lag(c).over(b), F.col(c))
    t = lambda c: F.coalesce(F.lead(c).over(b), F.col(c))
    corners = wide.select("*", *[((F.col(value) + F.col(c) + f(value) + f(c)) / 4).alias(k) for k, c, f in (("sw", "_w", s), ("se", "_e", s), ("nw", "_w", t), ("ne", "_e", t))])
    if n == 1:
        return df.select("*", F.lit(1).alias("a"), F.lit(1).alias("b"), v.alias("sample"))
    out = corners.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n))))
    x, y = (F.col("a") - 1) / (n - 1), (F.col("b") - 1) / (n - 1)
    sample = (1 - x) * (1 - y) * F.col("sw") + x * (1 - y) * F.col("se") + (1 - x) * y * F.col("nw") + x * y * F.col("ne")
    return out.select(*df.columns, "a", "b", sample.alias("sample"))


def stagger(df: DataFrame, along: str, keys: list[str] | None = None, value: str = "value", out: str = "staggered") -> DataFrame:
    """Mean with the next cell along an axis (cell centres to faces); the last cell keeps its value."""
    w = _line(keys or [], along)
    return df.withColumn(out, F.coalesce((F.col(value) + F.lead(value).over(w)) / 2, F.col(value)))


def to_corners(df: DataFrame, keys: list[str] | None = None, value: str = "value", out: str = "corner") -> DataFrame:
    """Mean of the four cells around each cell's upper right corner, of those there are."""
    a, b = _line(keys or [], "i"), _line(keys or [], "j")
    east = df.withColumn("_e", F.coalesce(F.lead(value).over(a), F.col(value)))
    pair = east.withColumn("_p", F.col(value) + F.col("_e"))
    return pair.withColumn(out, (F.col("_p") + F.coalesce(F.lead("_p").over(b), F.col("_p"))) / 4).drop("_e", "_p")


GAUSS = 1 / math.sqrt(3)


def quadrature_nodes(df: DataFrame, corners: list[str]) -> DataFrame:
    """(node, at_node) for the 2 or 3-dimensional two-point Gauss rule from 4 or 8 corner columns (tensor order, first axis fastest)."""
    d = {4: 2, 8: 3}[len(corners)]
    rows = []
    for q in range(2**d):
        place = [(GAUSS if q >> k & 1 else -GAUSS) for k in range(d)]
        basis = [math.prod((1 + place[k] * (1 if c >> k & 1 else -1)) / 2 for k in range(d)) for c in range(2**d)]
        rows.append(F.struct(F.lit(q + 1).alias("node"), sum(F.lit(w) * F.col(c) for w, c in zip(basis, corners, strict=True)).alias("at_node")))
    return df.select("*", F.inline(F.array(*rows)))


# --- iterative operators on a field as an array -----------------------------------------------


def on_fields(df: DataFrame, keys: list[str], f, value: str = "value", extra: list[str] | None = None) -> DataFrame:
    """f(field, *extra fields) with nan for missing, for each slice; fields are (i, j) arrays."""
    extra = extra or []
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = (p[c].to_numpy() - p[c].min() for c in ("i", "j"))
        made = []
        for c in (value, *extra):
            z = np.full((i.max() + 1, j.max() + 1), np.nan)
            z[i, j] = p[c].to_numpy(float)
            made.append(z)
        return p[[*keys, "i", "j"]].assign(**{value: f(*made)[i, j]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"i {kinds['i']}", f"j {kinds['j']}", f"{value} double"])
    rows = df.select(*keys, "i", "j", value, *extra)
    if keys:
        return rows.groupBy(*keys).applyInPandas(run, schema)
    return rows.withColumn("_field", F.lit(0)).groupBy("_field").applyInPandas(run, schema)


DIAGONAL = math.sqrt(2)


def _along(g: np.ndarray, periodic: bool) -> np.ndarray:
    """For each place of a line the least chamfer distance to a cell that is g away across the line, at any place k."""
    d = g.copy()
    for k in range(1, len(g)):
        if k >= d.max():  # nothing that far along the line is nearer
            break
        for s in (k, -k):
            across = np.roll(g, s)
            if not periodic:
                across[:k] = np.where(s > 0, np.inf, across[:k])
                across[-k:] = np.where(s < 0, np.inf, across[-k:])
            d = np.minimum(d, np.maximum(k, across) + (DIAGONAL - 1) * np.minimum(k, across))
    return d


def distances(df: DataFrame, mask: str, keys: list[str] | None = None, periodic_x: bool = False, periodic_y: bool = False, shape: tuple[int, int] | None = None, far: float = 1e9, out: str = "distance") -> DataFrame:
    """Chamfer distance (1, sqrt 2) in cells to the nearest cell whose mask is 0, negative where it is below 0.

    A step along i and a step along j cost 1, a diagonal one sqrt 2, and nothing is in the way: of the cells of one column
    only the nearest across counts, for any number of steps along the line. So a first pass finds it on each line
    of one i, by running minima, and a second one takes the least over each line of one j. No group is larger than a line; the second
    pass takes as many steps as the largest distance it meets. Without a cell of mask 0 distances are `far`; a null mask
    is not 0. shape: cells along i and j, needed for periodic sides.
    """
    keys = keys or []
    if (periodic_x or periodic_y) and shape is None:
        raise ValueError("periodic sides need the field's shape")
    line = Window.partitionBy(*keys, "i").orderBy("j")
    before, behind, every = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*keys, "i")
    at = F.when(F.col(mask) == 0, F.col("j"))
    near = [F.col("j") - F.last(at, True).over(before), F.first(at, True).over(behind) - F.col("j")]
    if periodic_y:
        near += [F.min(at).over(every) + shape[1] - F.col("j"), F.col("j") + shape[1] - F.max(at).over(every)]
    g = df.withColumn("_across", F.least(*near).cast("double")).withColumn("_sign", F.when(F.col(mask) < 0, -1.0).otherwise(1.0))
    kinds = dict(df.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i = p["i"].to_numpy(np.int64)
        first = 1 if periodic_x else i.min()
        g = np.full(shape[0] if periodic_x else i.max() - first + 1, np.inf)
        g[i - first] = np.where(p["_across"].isna(), np.inf, p["_across"].to_numpy(float))
        d = np.minimum(_along(g, periodic_x), far)
        return p[[*keys, "i", "j"]].assign(**{out: d[i - first] * p["_sign"].to_numpy()})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"i {kinds['i']}, j {kinds['j']}, `{out}` double"])
    return g.select(*keys, "i", "j", "_across", "_sign").groupBy(*keys, "j").applyInPandas(run, schema)


def distance_to_mask(mask: np.ndarray, periodic_x: bool = False, periodic_y: bool = False, far: float = 1e9) -> np.ndarray:
    """The same on one array, as two sweeps leave it; see distances() for fields of any size.

    A sweep goes line by line. What a line takes from the one before is one minimum over shifted copies; along the line
    distances grow by 1 a cell, so they are a running minimum of the distance less the place. The way back is the same
    sweep on the turned field. Without wrapping, sweeps leave their first line and the first cell of each as they are,
    so the borders are relaxed in part only.
    """
    n, m = mask.shape
    wraps = periodic_x or periodic_y
    place = np.arange(n, dtype=float)

    def sweep(d: np.ndarray) -> None:
        for j in range(0 if wraps else 1, m):
            line = d[:, j].copy()
            if j or periodic_y:
                before = d[:, j - 1]
                sides = [np.roll(before, k) for k in (1, -1)]
                if not periodic_x:
                    sides[0][0] = sides[1][-1] = far
                line = np.minimum.reduce([line, before + 1, sides[0] + math.sqrt(2), sides[1] + math.sqrt(2)])
            if not wraps:
                line[0] = d[0, j]
            elif periodic_x:
                line[0] = min(line[0], d[-1, j] + 1)
            d[:, j] = np.minimum.accumulate(line - place) + place

    d = np.where(mask == 0, 0.0, far)
    for _ in range(100 if wraps else 1):
        old = d.copy()
        sweep(d)
        sweep(d[::-1, ::-1])
        if np.allclose(d, old, rtol=0, atol=1e-9):
            break
    return np.where(mask < 0, -d, d)
