"""Series lookups: bracketing joins with linear blends, nearest samples, conservative bins.

bracket() finds the points around each probe. Points and probes are cut into buckets of the axis;
windows sort one key's bucket at a time, and a small table of buckets carries the nearest points
over empty ones. So a key that holds most rows is still spread over tasks. at_places() asks for each
place once and joins probes with what was found, so that many probes of one place are spread too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.operators.slices import blend


def _rounded(value: Column, digits: int | None) -> Column:
    """Rounded, and without a negative zero."""
    return value if digits is None else F.round(value, digits) + F.lit(0.0)


def bracket(points: DataFrame, probes: DataFrame, by: list[str], width: float, x: str = "x", y: str = "y") -> DataFrame:
    """probes with lo (the last point at or below) and hi (the first point above) as structs (x, y); probes without key or place are left out."""
    cell = F.floor(F.col(x) / width).alias("_cell")
    p = points.select(*by, cell, F.col(x), F.struct(F.col(x), F.col(y)).alias("_p"))
    row = F.struct(*[F.col(c) for c in probes.columns]).alias("_row")
    q = probes.select(*by, cell, x, F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), row)
    both = p.withColumn("_row", F.lit(None).cast(q.schema["_row"].dataType)).unionByName(q)
    for c in (*by, "_cell"):  # the join below asks for it; here both uses of the union do, and share what is below it
        both = both.where(F.col(c).isNotNull())
    point = F.col("_p").isNotNull()
    # points before probes of the same place; the nearest points of both sides in one order, each found once
    here = Window.partitionBy(*by, "_cell").orderBy(F.col(x), point.desc())
    found = both.select("*", F.expr("lag(_p) ignore nulls").over(here).alias("lo"), F.expr("lead(_p) ignore nulls").over(here).alias("hi")).where(~point)
    at = F.when(point, F.col(x))
    cells = both.groupBy(*by, "_cell").agg(F.max_by("_p", at).alias("end"), F.min_by("_p", at).alias("begin"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_cell")
    carry = cells.select(*by, "_cell", F.expr("lag(end) ignore nulls").over(order).alias("_lo"), F.expr("lead(begin) ignore nulls").over(order).alias("_hi"))
    out = found.join(carry, [*by, "_cell"])
    return out.select("_row.*", F.coalesce("lo", "_lo").alias("lo"), F.coalesce("hi", "_hi").alias("hi"))


def at_places(probes: DataFrame, by: list[str], find: Callable[[DataFrame], DataFrame], x: str = "x") -> DataFrame:
    """probes with the columns that find gives their distinct places (by, x), found once however many probes share one."""
    return probes.join(find(probes.select(*by, x).distinct()), [*by, x])


def interp_linear(points: DataFrame, probes: DataFrame, by: list[str], width: float, x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
    """probes with y: linear between the points around, the end's value beyond them; rounded where digits are given."""

    def find(places):
        at = bracket(points, places, by, width, x, y)
        return at.select(*by, x, _rounded(blend(F.col(x), F.col("lo"), F.col("hi"), True, x, y), digits).alias(y))

    return at_places(probes, by, find, x).select(*probes.columns, y)


def series_lookup(series: DataFrame, times: DataFrame, by: list[str], width: float, spread: bool = True) -> DataFrame:
    """times with value (clamped linear) and sigma (0 where the series has none) of each channel."""
    s = F.coalesce(F.col("sigma"), F.lit(0.0)) if spread and "sigma" in series.columns else F.lit(0.0)
    points = series.select(*by, F.col("time").alias("x"), F.struct(F.col("value").alias("v"), s.alias("s")).alias("y"))
    at = bracket(points, times.withColumnRenamed("time", "x"), by, width)
    part = lambda f: blend(F.col("x"), *(F.struct(F.col(c)["x"].alias("time"), F.col(c)["y"][f].alias("value")) for c in ("lo", "hi")), True)
    return at.select(*by, F.col("x").alias("time"), part("v").alias("value"), part("s").alias("sigma"))


def align(points: DataFrame, probes: DataFrame, by: list[str], tolerance: float, x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
    """probes with y of the nearest point within the tolerance (the lower one of two), else NULL; rounded where digits are given."""
    below, above = F.col(x) - F.col("lo")[x], F.col("hi")[x] - F.col(x)
    near = F.when(F.col("hi").isNull() | (below <= above), F.struct(below.alias("d"), F.col("lo")[y].alias("v"))).otherwise(F.struct(above.alias("d"), F.col("hi")[y].alias("v")))

    def find(places):
        at = bracket(points, places, by, max(tolerance * 4, 1e-12), x, y)
        return at.select(*by, x, _rounded(F.when(near["d"] <= tolerance, near["v"]), digits).alias(y))

    return at_places(probes, by, find, x).select(*probes.columns, y)


def default_tolerance(points: DataFrame, by: list[str], x: str = "x") -> float:
    """0.49 times the least spacing."""
    gap = F.col(x) - F.lag(x).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(x))
    return 0.49 * float(points.select(gap.alias("g")).where("g > 0").agg(F.min("g")).first()[0])


def bin_edges(centres: DataFrame, x: str = "x") -> DataFrame:
    """x with lo and hi: middles between neighbours, the ends' bins ending at their centres."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    return centres.select("*", F.coalesce((F.col(x) + F.lag(x).over(w)) / 2, F.col(x)).alias("lo"), F.coalesce((F.col(x) + F.lead(x).over(w)) / 2, F.col(x)).alias("hi"))


def rebin(source: DataFrame, target: DataFrame, width: float) -> DataFrame:
    """target (x) with y: sums of source values times the part of the target's bin that theirs cover.

    Both axes are small tables (a column's layers); their first and last points must agree, and the ends
    are copied. Sums are not divided by the covered part.
    """
    s = bin_edges(source).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "y")
    t = bin_edges(target)
    cover = F.least("hi", "b") - F.greatest("lo", "a")
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))
    pairs = t.withColumn("c", F.explode(cells("lo", "hi"))).join(s.withColumn("c", F.explode(cells("a", "b"))), "c")
    # a pair is met in every cell both reach: the first one counts
    pairs = pairs.where(F.col("c") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("a") / width))).where(cover > 0)
    sums = pairs.groupBy("x").agg(F.sum(cover / (F.col("hi") - F.col("lo")) * F.col("y")).alias("y"))
    ends = source.agg(F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    out = t.select("x").join(sums, "x", "left").join(F.broadcast(ends))  # one row
    return out.select("x", F.when(F.col("x") <= F.col("x0"), F.col("y0")).when(F.col("x") >= F.col("x1"), F.col("y1")).otherwise(F.coalesce("y", F.lit(0.0))).alias("y"))


def argmin(df: DataFrame, by: list[str], place: Column, measure: Column, name: str = "at") -> DataFrame:
    """The place of the least measure of each key, the first of equal ones."""
    return df.groupBy(*by).agg(F.min(F.struct(measure, place.alias("p"))).getField("p").alias(name))
