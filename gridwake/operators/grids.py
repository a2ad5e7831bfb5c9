"""Grids, axes and points as tables; locating targets in structured grids; conservative overlaps.

Overlaps on axes are found one axis at a time and multiplied, since a rectangle's overlap is the
product of its sides': the joins are of axis tables (thousands of rows), never of all cells.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.model import Axis, CoordSystem, Grid, same_system
from gridwake.operators.solvers import cut


def axis(spark: SparkSession, a: Axis) -> DataFrame:
    """(idx from 1, centre)."""
    if a.at is not None:
        return spark.createDataFrame([(i, c) for i, c in enumerate(a.at, 1)], "idx long, centre double")
    return spark.range(1, a.n + 1).select(F.col("id").alias("idx"), (F.lit(a.x0) + (F.col("id") - 1) * a.dx).alias("centre"))


def edges(centres: DataFrame) -> DataFrame:
    """(idx, centre, lo, hi): middles between centres, half a cell beyond the ends. An axis is one small table."""
    w = Window.orderBy("idx")
    before, after = F.lag("centre").over(w), F.lead("centre").over(w)
    lo = F.coalesce((before + F.col("centre")) / 2, F.col("centre") - (after - F.col("centre")) / 2)
    hi = F.coalesce((after + F.col("centre")) / 2, F.col("centre") + (F.col("centre") - before) / 2)
    return centres.select("idx", "centre", lo.alias("lo"), hi.alias("hi"))


def regular_edges(spark: SparkSession, a: Axis) -> DataFrame:
    """As edges(), without a window."""
    if a.at is not None:
        e = a.edges()
        return spark.createDataFrame([(i, c, e[i - 1], e[i]) for i, c in enumerate(a.at, 1)], "idx long, centre double, lo double, hi double")
    return axis(spark, a).select("idx", "centre", (F.col("centre") - a.dx / 2).alias("lo"), (F.col("centre") + a.dx / 2).alias("hi"))


def centres(a: Axis, idx: Column) -> Column:
    """The centre of an index (from 1)."""
    if a.at is None:
        return F.lit(a.x0) + (idx - 1) * a.dx
    return F.element_at(F.array(*[F.lit(c) for c in a.at]), idx.cast("int"))


def cells(spark: SparkSession, g: Grid) -> DataFrame:
    """(cell, i, j, x, y, border): cell = (j - 1) * nx + i. Generated by arithmetic, in parallel."""
    k = F.col("id")
    i, j = F.pmod(k, F.lit(g.x.n)) + 1, F.floor(k / g.x.n) + 1
    out = spark.range(g.size).select((k + 1).alias("cell"), i.alias("i"), j.alias("j"))
    out = out.select("*", centres(g.x, F.col("i")).alias("x"), centres(g.y, F.col("j")).alias("y"))
    wraps = not g.system.is_cartesian and abs(g.x.edges()[-1] - g.x.edges()[0] - 360.0) < 1e-6
    side = F.col("j").isin(1, g.y.n) if wraps else F.col("i").isin(1, g.x.n) | F.col("j").isin(1, g.y.n)
    return out.withColumn("border", side.cast("int"))


def lon180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def _sizes(a: Axis, idx: Column) -> Column:
    if a.at is None:
        return F.lit(abs(a.dx))
    e = a.edges()
    return F.element_at(F.array(*[F.lit(abs(v - u)) for u, v in zip(e, e[1:], strict=False)]), idx.cast("int"))


def plane_area(g: Grid) -> Column:
    """Of a cell (i, j), in units of the axes squared."""
    return _sizes(g.x, F.col("i")) * _sizes(g.y, F.col("j"))


def cell_area(g: Grid) -> Column:
    """Area of a cell (i, j): in axis units squared in a plane, else that of the geodesic polygon of its corners, in m2.

    In longitude cells differ by their width only, so one polygon for each width and row is measured, on the driver.
    """
    if g.system.is_cartesian:
        return plane_area(g)
    e = np.clip(g.y.edges(), -90, 90)
    x = g.x.edges()
    widths = sorted({round(abs(b - a), 9) for a, b in zip(x, x[1:], strict=False)})
    rows = {w: [geo.geodesic_area([0, w, w, 0], [a, a, b, b], g.system.planet) for a, b in zip(e, e[1:], strict=False)] for w in widths}
    area = F.lit(None).cast("double")
    for w, values in rows.items():
        own = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("j").cast("int"))
        area = F.when(F.abs(_sizes(g.x, F.col("i")) - w) < 1e-8, own).otherwise(area)
    return area


def located(df: DataFrame, system: CoordSystem, x: str = "x", y: str = "y", to_own: bool = False) -> DataFrame:
    """df with lon and lat of places in a system; with to_own, x and y of places lon, lat."""
    a, b = ("lon", "lat") if to_own else (x, y)
    names = (x, y) if to_own else ("lon", "lat")

    @F.pandas_udf("u double, v double")
    def moved(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        u, v = geo.to_system(system, p, q, inverse=not to_own)
        return pd.DataFrame({"u": u, "v": v})

    return df.withColumn("_at", moved(F.col(a), F.col(b))).withColumns({names[0]: F.col("_at.u"), names[1]: F.col("_at.v")}).drop("_at")


def to_points(grid_cells: DataFrame, mask: Column | None = None) -> DataFrame:
    """Cells as points, packed by a mask; pt is the cell's number."""
    rows = grid_cells if mask is None else grid_cells.where(mask)
    return rows.withColumnRenamed("cell", "pt")


def to_grid(points: DataFrame, grid_cells: DataFrame) -> DataFrame:
    """Points on their cells again; cells without a point hold NULL."""
    return grid_cells.join(points.withColumnRenamed("pt", "cell"), "cell", "left")


def places(df: DataFrame, flag: Column, idx: str = "idx") -> DataFrame:
    """The places where flag holds, in order, a row each: which() for tables of any size."""
    return df.where(flag).select(idx).orderBy(idx)


def which(df: DataFrame, flag: Column, idx: str = "idx") -> DataFrame:
    """One row: the sorted places where flag holds, [-1] if nowhere. For lists that fit one row; see places()."""
    got = df.where(flag).agg(F.array_sort(F.collect_list(idx)).alias("at"))
    return got.select(F.when(F.size("at") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("at").cast("array<long>")).alias("at"))


class _Near:
    """Sorted values, asked whether one lies within a tolerance."""

    def __init__(self, tolerance: float):
        self.values: list[float] = []
        self.tolerance = tolerance

    def has(self, v: float) -> bool:
        k = bisect.bisect_left(self.values, v)
        return any(0 <= j < len(self.values) and abs(self.values[j] - v) <= self.tolerance for j in (k - 1, k))

    def add(self, v: float) -> None:
        bisect.insort(self.values, v)


def settled(v: np.ndarray, order: np.ndarray, state: np.ndarray, own: np.ndarray, tolerance: float) -> np.ndarray:
    """States after a pass in order: 1 kept, -1 left out, 0 open, where a value's earlier neighbours are open themselves.

    Of values that are not own all neighbours need not be here: they are never kept by this pass.
    """
    kept, open_, state = _Near(tolerance), _Near(tolerance), state.copy()
    for k in np.lexsort((v, order)):
        if state[k] == 0:
            if kept.has(v[k]):
                state[k] = -1
            elif own[k] and not open_.has(v[k]):
                state[k] = 1
        if state[k] == 1:
            kept.add(v[k])
        elif state[k] == 0:
            open_.add(v[k])
    return state


def unique(df: DataFrame, value: str, order: str, tolerance: float = 1e-5, chunk: int = 1 << 16) -> DataFrame:
    """Values in first-seen order, those within tolerance of a kept one left out; nulls and nan are none.

    Exact repeats go first by aggregation. Values are then dealt to blocks by size. A block decides in order what depends on its
    own values and on decided ones of other blocks within the tolerance of its ends; what waits for another block's open
    value is left for the next round. So a chain of close values costs a round for each time that it changes from block to block.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.min(order).alias("o"))
    blocks = max(1, -(-rows.count() // chunk))
    rows = cut(rows.repartitionByRange(blocks, "v").select("v", "o", F.spark_partition_id().alias("block"), F.lit(0).alias("state")))
    ends = rows.groupBy("block").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("a").collect()  # a row a block
    number, low, high = ([r[c] for r in ends] for c in ("block", "a", "b"))
    kind = dict(rows.dtypes)["o"]

    def spread(frames):
        for f in frames:
            x = f["v"].to_numpy()
            first, last = np.searchsorted(high, x - tolerance), np.searchsorted(low, x + tolerance, side="right")
            at = np.repeat(np.arange(len(f)), last - first)
            k = np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
            out = f.iloc[at].rename(columns={"block": "home"})
            yield out.assign(block=np.array(number)[k])

    def decide(key, f: pd.DataFrame) -> pd.DataFrame:
        own = (f["home"] == key[0]).to_numpy()
        f = f.assign(state=settled(f["v"].to_numpy(), pd.factorize(f["o"], sort=True)[0], f["state"].to_numpy(), own, tolerance))
        return f.loc[own, ["v", "o", "block", "state"]]

    done = not ends
    while not done:
        sent = rows.mapInPandas(spread, f"v double, o {kind}, home int, state int, block int")
        rows = cut(sent.groupBy("block").applyInPandas(decide, f"v double, o {kind}, block int, state int"), rows)
        done = rows.where("state = 0").isEmpty()
    return rows.where("state = 1").select(F.col("v").alias(value))


# --- locating ---------------------------------------------------------------------------------


def locate(value: Column, a: Axis, periodic: bool = False) -> tuple[Column, Column, Column, Column]:
    """(lower idx, upper idx, fraction, found) of a value on an axis of equal steps, by arithmetic.

    Periodic axes wrap at 360. Others clamp values up to one step beyond their ends to the end cell.
    """
    first, last = (a.x0, a.centre(a.n)) if a.dx > 0 else (a.centre(a.n), a.x0)
    step = abs(a.dx) if a.at is None else a.widest
    if periodic:
        value = F.lit(first) + F.pmod(value - first, F.lit(360.0))
    if a.at is None:
        k = F.floor((value - first) / step)
        t = (value - first) / step - k
    else:
        rising = np.sort(np.array(a.at))

        @F.pandas_udf("double")
        def place(v: pd.Series) -> pd.Series:
            # the number of the step from the first centre, and how far into it
            k = np.clip(np.searchsorted(rising, v, side="right") - 1, 0, max(len(rising) - 2, 0))
            return pd.Series(k + np.clip((v - rising[k]) / (rising[np.minimum(k + 1, len(rising) - 1)] - rising[k]), 0, 1 - 1e-15))

        at = place(value)
        k, t = F.floor(at), at - F.floor(at)
    span = first + 360.0 - last
    if periodic:
        at_end = value > last
        seam = (value - last) / span if span else F.lit(0.0)
        on_last = value == last
        lo = F.when(at_end, a.n).when(on_last, a.n - 1).otherwise(k + 1)
        hi = F.when(at_end, 1).when(on_last, a.n).otherwise(k + 2)
        t = F.when(at_end, seam).when(on_last, 1.0).otherwise(t)
        found = value.isNotNull()
    else:
        below, above = value <= first, value >= last
        lo = F.when(below, 1).when(above, a.n).otherwise(k + 1)
        hi = F.when(below, 1).when(above, a.n).otherwise(k + 2)
        t = F.when(below | above, 0.0).otherwise(t)
        found = (value >= first - step) & (value <= last + step)
    if a.dx < 0:  # numbered from the other end
        lo, hi, t = a.n + 1 - hi, a.n + 1 - lo, F.when(lo == hi, 0.0).otherwise(1 - t)
    return lo.cast("long"), hi.cast("long"), t.cast("double"), found


def bilinear_links(targets: DataFrame, g: Grid, x: str = "x", y: str = "y", periodic: bool | None = None) -> DataFrame:
    """(dst, src, w): the four cells around each target (dst, x, y) in grid g. No join: a target's cells follow by arithmetic."""
    wrap = not g.system.is_cartesian if periodic is None else periodic
    i0, i1, u, in_x = locate(F.col(x), g.x, wrap)
    j0, j1, v, in_y = locate(F.col(y), g.y)
    at = targets.select("dst", i0.alias("i0"), i1.alias("i1"), u.alias("u"), j0.alias("j0"), j1.alias("j1"), v.alias("v"), (in_x & in_y).alias("ok")).where("ok")
    n = g.x.n
    corner = lambda i, j, w: F.struct(((F.col(j) - 1) * n + F.col(i)).alias("src"), w.alias("w"))
    u, v = F.col("u"), F.col("v")
    four = F.array(corner("i0", "j0", (1 - u) * (1 - v)), corner("i1", "j0", u * (1 - v)), corner("i0", "j1", (1 - u) * v), corner("i1", "j1", u * v))
    return at.select("dst", F.inline(four))


# --- conservative overlaps --------------------------------------------------------------------

#: Pairs of an axis up to which they are broadcast, 24 bytes each.
AXIS_PAIRS = 1_000_000


def overlap_pairs(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """(dst, src, w) for intervals a (dst, lo, hi) and b (src, lo, hi), of either orientation: the length they share.

    Intervals meet by cells of `width` that they reach into, so no pair that is far apart is formed.
    """
    lohi = lambda d, k: d.select(k, F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    reach = F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long")))
    p = lohi(a, "dst").withColumn("c", reach)
    q = lohi(b, "src").withColumn("c", reach).withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    both = p.join(q, "c").where(F.col("c") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("lo2") / width)))
    return both.select("dst", "src", (F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("w")).where("w > 0")


def lon_overlap_pairs(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """As overlap_pairs() for longitudes: b is met in the turns before, of and after a; the largest counts."""
    turns = b.select("src", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).alias("k"), "lo", "hi").select("src", (F.col("lo") + F.col("k")).alias("lo"), (F.col("hi") + F.col("k")).alias("hi"))
    return overlap_pairs(a, turns, width).groupBy("dst", "src").agg(F.max("w").alias("w"))


def sine_edges(lat: DataFrame) -> DataFrame:
    """Edges clamped to +-90 degrees, as sines."""
    s = lambda c: F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c)))))
    return lat.select("*").withColumns({"lo": s("lo"), "hi": s("hi")})


def conservative_links(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """(dst, src, w): areas that cells of two grids share, in the plane, or on the sphere for two lat-lon grids.

    Both grids must have one coordinate system; remap.conservative_links() takes any two.
    """
    if not same_system(source.system, target.system):
        raise ValueError("the grids' coordinate systems differ: use remap.conservative_links")
    flat = source.system.is_cartesian

    def side(which: str, sphere: bool):
        s, t = getattr(source, which), getattr(target, which)
        b, a = (regular_edges(spark, k) for k in (s, t))
        if sphere:
            a, b = sine_edges(a), sine_edges(b)
        a, b = a.withColumnRenamed("idx", "dst"), b.withColumnRenamed("idx", "src")
        if which == "x" and not flat:
            return lon_overlap_pairs(a, b, max(s.widest, t.widest))
        wide = max(s.widest, t.widest)
        return overlap_pairs(a, b, math.radians(wide) if sphere else wide)

    x = side("x", False).select(F.col("dst").alias("i"), F.col("src").alias("si"), F.col("w").alias("wx"))
    y = side("y", not flat).select(F.col("dst").alias("j"), F.col("src").alias("sj"), F.col("w").alias("wy"))
    # every pair of columns goes with every pair of rows: the result, not a search; an axis has at most as many
    # pairs as both axes have edges, a few thousand
    if 3 * (source.x.n + target.x.n) > AXIS_PAIRS:
        raise ValueError(f"axes of more than {AXIS_PAIRS // 3} cells are not multiplied in memory")
    return y.join(F.broadcast(x)).select(((F.col("j") - 1) * target.x.n + F.col("i")).alias("dst"), ((F.col("sj") - 1) * source.x.n + F.col("si")).alias("src"), (F.col("wx") * F.col("wy")).alias("w"))
