"""Remapping of whole fields: links by clipped cells, strict interpolation on grids, and what follows an apply."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.model import CoordSystem, Grid, same_system
from gridwake.operators import grids, links, spherical, stencil

#: Points of each side of a cell that is seen in another coordinate system.
SAMPLES = 8


def box_pairs(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Pairs of polygons (dst | src, xs, ys) whose bounding boxes meet, by lattice cells they both reach."""

    def boxed(df: DataFrame, p: str) -> DataFrame:
        ends = {f"{p}{c}{k}": f(c + "s") for c in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))}
        df = df.withColumns(ends).withColumnsRenamed({"xs": f"{p}xs", "ys": f"{p}ys"})
        for c in "xy":
            reach = F.sequence(F.floor(F.col(f"{p}{c}0") / width).cast("long"), F.floor(F.col(f"{p}{c}1") / width).cast("long"))
            df = df.withColumn(f"c{c}", F.explode(reach))
        return df

    both = boxed(a, "a").join(boxed(b, "b"), ["cx", "cy"])
    for c in "xy":
        both = both.where(F.col(f"c{c}") == F.greatest(F.floor(F.col(f"a{c}0") / width), F.floor(F.col(f"b{c}0") / width)))
        both = both.where((F.col(f"a{c}0") <= F.col(f"b{c}1")) & (F.col(f"b{c}0") <= F.col(f"a{c}1")))
    return both.select("dst", "src", "axs", "ays", "bxs", "bys")


def clipped_links(targets: DataFrame, sources: DataFrame, width: float, sphere: bool = False) -> DataFrame:
    """(dst, src, w): areas that polygons share; targets must be convex. In the plane, or of lon-lat polygons on the unit sphere.

    On the sphere sources must be convex too, and the width of the plane's lattice is not used (see spherical.py).
    """
    if sphere:
        named = [df.withColumnsRenamed({"xs": "lons", "ys": "lats"}) for df in (targets, sources)]
        return spherical.overlaps(*named)

    @F.pandas_udf("double")
    def shared(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        out = [geo.plane_area(geo.clip(np.stack([r, s], 1), np.stack([p, q], 1))) for p, q, r, s in zip(ax, ay, bx, by, strict=True)]
        return pd.Series(out, dtype=float)

    return box_pairs(targets, sources, width).select("dst", "src", shared("axs", "ays", "bxs", "bys").alias("w")).where("w > 0")


def rectangles(cells: DataFrame, dx: float, dy: float, key: str) -> DataFrame:
    """(key, xs, ys): cells (cell, x, y) as polygons that turn left."""
    x, y = F.col("x"), F.col("y")
    return cells.select(F.col("cell").alias(key), F.array(x - dx / 2, x + dx / 2, x + dx / 2, x - dx / 2).alias("xs"), F.array(y - dy / 2, y - dy / 2, y + dy / 2, y + dy / 2).alias("ys"))


def box_areas(x: np.ndarray, y: np.ndarray, xe: np.ndarray, ye: np.ndarray) -> np.ndarray:
    """Areas that a simple polygon has within the boxes between the edges xe and ye: (rows, columns).

    Its boundary is followed once: below each side, clamped to a box, lies a strip whose area is known in closed form,
    since a linear function clamped to an interval has a piecewise quadratic integral.
    """
    u, v = np.roll(x, -1), np.roll(y, -1)
    use = x != u
    x, y, u, v = x[use, None], y[use, None], u[use, None], v[use, None]
    a, b = np.clip(x, xe[:-1], xe[1:]), np.clip(u, xe[:-1], xe[1:])
    side, column = np.nonzero(a != b)
    a, b = a[side, column], b[side, column]
    x, y, u, v = (c[side, 0] for c in (x, y, u, v))
    p, q = (y + (v - y) * (t - x) / (u - x) for t in (a, b))
    p, q, y0, y1 = p[:, None], q[:, None], ye[:-1], ye[1:]
    clamp = lambda t: np.clip(t, y0, y1)
    whole = lambda t: (clamp(t) - y0) ** 2 / 2 + (y1 - y0) * np.maximum(t - y1, 0)
    flat = np.abs(q - p) < 1e-9 * (y1 - y0)
    mean = np.where(flat, clamp((p + q) / 2) - y0, (whole(q) - whole(p)) / np.where(flat, 1, q - p))
    out = np.zeros((len(ye) - 1, len(xe) - 1))
    np.add.at(out.T, column, (b - a)[:, None] * mean)
    return np.abs(out)


def outlines(spark: SparkSession, g: Grid, samples: int = SAMPLES) -> DataFrame:
    """(src, x, y, xs, ys): centres and outlines of a grid's cells, `samples` points a side, turning left."""
    k = f"transform(sequence(0, {4 * samples - 1}), k -> "
    f = f"(k % {samples}) / {float(samples)}"
    side = f"k div {samples}"
    xs = f"{k} x + dx * (case {side} when 0 then {f} when 1 then 1 when 2 then 1 - {f} else 0 end - 0.5))"
    ys = f"{k} y + dy * (case {side} when 0 then 0 when 1 then {f} when 2 then 1 else 1 - {f} end - 0.5))"
    wide = grids.cells(spark, g).withColumns({"dx": grids._sizes(g.x, F.col("i")), "dy": grids._sizes(g.y, F.col("j"))})
    if g.x.at is not None or g.y.at is not None:  # the middle of a cell is not its centre
        middle = lambda a, i: F.element_at(F.array(*[F.lit((u + v) / 2) for u, v in zip(a.edges(), a.edges()[1:], strict=False)]), F.col(i).cast("int"))
        wide = wide.withColumns({"x": middle(g.x, "i"), "y": middle(g.y, "j")})
    return wide.select(F.col("cell").alias("src"), "x", "y", F.expr(xs).alias("xs"), F.expr(ys).alias("ys"))


def reach(system: CoordSystem, g: Grid) -> float:
    """Degrees from a projection's centre to the farthest place on the edge of a grid in it."""
    ends = [(a.edges()[0], a.edges()[-1]) for a in (g.x, g.y)]
    t = np.linspace(0, 1, 33)
    x, y = (e[0] + t * (e[1] - e[0]) for e in ends)
    edge = np.concatenate([[(u, v) for u in x for v in ends[1]], [(u, v) for v in y for u in ends[0]]])
    lon, lat = geo.to_system(system, edge[:, 0], edge[:, 1], inverse=True)
    return float(np.degrees(_apart(lon, lat, system.lon, system.lat)).max())


def _apart(lon, lat, lon0: float, lat0: float) -> np.ndarray:
    l, p, q = np.radians(lon - lon0), np.radians(lat), np.radians(lat0)
    return np.arccos(np.clip(np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * np.cos(l), -1, 1))


def seen_from(source: Grid, target: Grid, xs, ys) -> tuple[np.ndarray, np.ndarray]:
    """An outline in the plane in which the target's cells are boxes: its own, or (longitude, sine of latitude).

    In longitudes, outlines are unrolled, and closed along a pole that they hold.
    """
    lon, lat = geo.to_system(source.system, xs, ys, inverse=True)
    u, v = geo.to_system(target.system, lon, np.clip(lat, -90, 90))
    if target.system.is_cartesian:
        return u, v
    v = np.sin(np.radians(v))
    u = np.degrees(np.unwrap(np.radians(np.append(u, u[0]))))
    around, u = u[-1] - u[0], u[:-1]
    if abs(around) > 180:
        pole = 1.0 if v.mean() > 0 else -1.0
        u, v = np.concatenate([u, [u[0] + around, u[0] + around, u[0]]]), np.concatenate([v, [v[0], pole, pole]])
    return u, v


def cross_links(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """(dst, src, w): areas that cells of grids in different systems share, in the target's plane or on the unit sphere.

    The cells that an outline's bounding box reaches follow by arithmetic, so nothing is joined or searched. Cells beyond
    the target's edge as seen from a projection's centre are left out: they cannot meet it, and near the antipode they
    have no sensible outline.
    """
    flat = target.system.is_cartesian
    far = reach(target.system, target) if flat else 180.0
    wide = 1.5 * max(source.x.widest, source.y.widest) * (1 if not source.system.is_cartesian else source.system.metres / source.system.planet.a * 180 / np.pi)
    xe, ye = np.sort(target.x.edges()), np.sort(target.y.edges())
    ye = ye if flat else np.sin(np.radians(np.clip(ye, -90, 90)))
    least = 1e-12 * (abs(target.x.dx * target.y.dx) if flat else 1.0)

    def run(frames):
        for f in frames:
            if flat and len(f):
                lon, lat = geo.to_system(source.system, f["x"].to_numpy(), f["y"].to_numpy(), inverse=True)
                f = f[np.degrees(_apart(lon, lat, target.system.lon, target.system.lat)) <= far + wide]
            dst, src, w = [], [], []
            for cell, xs, ys in zip(f["src"], f["xs"], f["ys"], strict=True):
                u, v = seen_from(source, target, xs, ys)
                for turn in (0.0,) if flat else (-360.0, 0.0, 360.0):
                    i0, i1 = np.searchsorted(xe, u.min() + turn, "right") - 1, np.searchsorted(xe, u.max() + turn)
                    j0, j1 = np.searchsorted(ye, v.min(), "right") - 1, np.searchsorted(ye, v.max())
                    i0, i1, j0, j1 = max(i0, 0), min(i1, len(xe) - 1), max(j0, 0), min(j1, len(ye) - 1)
                    if i0 < i1 and j0 < j1:
                        area = box_areas(u + turn, v, xe[i0 : i1 + 1], ye[j0 : j1 + 1]) * (1 if flat else np.pi / 180)
                        j, i = np.nonzero(area > least)
                        w.append(area[j, i])
                        i, j = i + i0, j + j0
                        i, j = i if target.x.dx > 0 else target.x.n - 1 - i, j if target.y.dx > 0 else target.y.n - 1 - j
                        dst.append(j * target.x.n + i + 1)
                        src.append(np.full(len(i), cell))
            if dst:
                yield pd.DataFrame({"dst": np.concatenate(dst), "src": np.concatenate(src), "w": np.concatenate(w)})

    cells = outlines(spark, source).repartition(spark.sparkContext.defaultParallelism)
    out = cells.select("src", "x", "y", "xs", "ys").mapInPandas(run, "dst long, src long, w double")
    return out if flat else out.groupBy("dst", "src").agg(F.sum("w").alias("w"))


def conservative_links(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """(dst, src, w) for any two grids: by axes in one system (not a rotated one), else by outlines."""
    turned = [g.system.mtype == "rotated_pole" for g in (source, target)]
    if same_system(source.system, target.system) and (not any(turned) or source.system == target.system):
        return grids.conservative_links(spark, source, target)
    return cross_links(spark, source, target)


def strict_bilinear(field: DataFrame, g, targets: DataFrame, value: str = "value") -> DataFrame:
    """targets (dst, x, y) with the bilinear value: missing on or outside the outer axis values, or if a corner is missing."""
    inside = (F.col("x") > min(g.x.x0, g.x.centre(g.x.n))) & (F.col("x") < max(g.x.x0, g.x.centre(g.x.n))) & (F.col("y") > min(g.y.x0, g.y.centre(g.y.n))) & (F.col("y") < max(g.y.x0, g.y.centre(g.y.n)))
    four = grids.bilinear_links(targets.where(inside), g, periodic=False)
    met = four.join(field, "src", "left").groupBy("dst").agg(F.count(value).alias("n"), F.count("*").alias("all"), F.sum(F.col("w") * F.col(value)).alias("v"))
    return targets.join(met, "dst", "left").select(*targets.columns, F.when(F.col("n") == F.col("all"), F.col("v")).alias(value))


def nearest_cells(field: DataFrame, g, targets: DataFrame, factor: float = 1.0, value: str = "value") -> DataFrame:
    """targets with the value of the cell nearest along each axis, missing if it is more than factor steps away."""

    def near(c: str, axis):
        k = F.greatest(F.lit(1), F.least(F.lit(axis.n), F.ceil((F.col(c) - axis.x0) / axis.dx - 0.5) + 1))
        return k, F.abs(F.col(c) - (axis.x0 + (k - 1) * axis.dx)) <= factor * abs(axis.dx)

    (i, in_x), (j, in_y) = near("x", g.x), near("y", g.y)
    at = targets.withColumn("src", F.when(in_x & in_y, ((j - 1) * g.x.n + i).cast("long")))
    return at.join(field.select("src", value), "src", "left").select(*targets.columns, value)


def nearest_valid(field: DataFrame, g: Grid, targets: DataFrame, around: int = 3, value: str = "value") -> DataFrame:
    """targets (dst, x, y) with the nearest value there is among the (2 around + 1)**2 cells about the nearest cell, else NULL."""
    place = lambda c, a: F.greatest(F.lit(1), F.least(F.lit(a.n), F.round((F.col(c) - a.x0) / a.dx) + 1)).cast("long")
    steps = F.sequence(F.lit(-around), F.lit(around))
    near = targets.select("dst", "x", "y", place("x", g.x).alias("_i"), place("y", g.y).alias("_j"))
    near = near.withColumn("_i", F.explode(F.transform(steps, lambda s: F.col("_i") + s))).withColumn("_j", F.explode(F.transform(steps, lambda s: F.col("_j") + s)))
    near = near.where(F.col("_i").between(1, g.x.n) & F.col("_j").between(1, g.y.n))
    far = F.hypot(grids.centres(g.x, F.col("_i")) - F.col("x"), grids.centres(g.y, F.col("_j")) - F.col("y"))
    near = near.select("dst", ((F.col("_j") - 1) * g.x.n + F.col("_i")).alias("src"), far.alias("_far"))
    there = near.join(field.where(F.col(value).isNotNull()).select("src", value), "src")
    best = there.groupBy("dst").agg(F.min_by(value, F.struct("_far", "src")).alias(value))
    return targets.join(best, "dst", "left").select(*targets.columns, value)


def remap(l: DataFrame, field: DataFrame, targets: DataFrame, method: str = "mean", keys: list[str] | None = None, old: str | None = None, mask: Column | None = None, fill=None, smooth: float | None = None, shape: tuple[int, int] | None = None, value: str = "value") -> DataFrame:
    """Apply, then unmapped targets and mask, then an optional fill, then an optional Gaussian filter.

    targets (dst, keys, i, j); fill(field, keys, value) is an operator such as those of relax.py, smooth a sigma in cells.
    """
    keys = list(keys or [])
    out = links.on_targets(links.apply(l, field, method, keys, value), targets, keys, value, old, mask)
    if fill is not None:
        out = fill(out, keys, value)
    if smooth is not None:
        out = stencil.gauss_smooth(out, smooth, *shape, keys, value)
    return out
