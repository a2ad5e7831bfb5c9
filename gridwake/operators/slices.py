"""Time slices of long-form fields: (keys, time, value), or with t_idx where steps are counted.

A request off the axis is missing as a whole; missing values are NULL. `axis` is the time axis'
(first, last); without it the table's own extremes are used. Every method is one grouped
aggregation by key, which Spark combines before its shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.model import CRAZY, TIME_TOLERANCE
from gridwake.sources.config import fill_path

REDUCERS = ("mean", "sum", "sd", "min", "max")


def scaled(value: Column, scale: float = 1.0, offset: float = 0.0, crazy: float = CRAZY) -> Column:
    """value * scale + offset, missing where the size of the value is beyond belief."""
    return F.when(F.abs(value) < crazy, value * scale + offset)


def extent(df: DataFrame, time: str = "time") -> tuple[float, float] | None:
    row = df.agg(F.min(time), F.max(time)).first()
    return None if row[0] is None else (float(row[0]), float(row[1]))


def inside(axis: tuple[float, float] | None, t0: float, t1: float) -> bool:
    return axis is not None and t0 >= axis[0] - TIME_TOLERANCE and t1 <= axis[1] + TIME_TOLERANCE


def steps(df: DataFrame, t0: float, t1: float | None = None, axis=None, time: str = "time", value: str = "value") -> DataFrame:
    """`exact` (t1 None) and `range`: the rows of the steps; if the range leaves the axis, one row a key with NULL.

    The condition on time is a plain comparison, which reaches the scan.
    """
    t1 = t0 if t1 is None else t1
    keys = [c for c in df.columns if c not in (time, value, "t_idx")]
    hit = df.where(F.col(time).between(t0 - TIME_TOLERANCE, t1 + TIME_TOLERANCE))
    if inside(axis or extent(df, time), t0, t1) and (t1 > t0 or not hit.select(time).isEmpty()):
        return hit
    empty = df.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    return empty.select(*keys, F.lit(t0).cast("double").alias(time), F.lit(None).cast("double").alias(value))


def standard_deviation(value: Column, ddof: int | None = None) -> Column:
    """ddof None: population deviation of three values and more, times sqrt(2) for two, missing for fewer."""
    if ddof == 1:
        return F.stddev_samp(value)
    n = F.count(value)
    return F.when(n < 2, None).when(n == 2, F.sqrt(2 * F.var_pop(value))).otherwise(F.stddev_pop(value))


def reducer(method: str, value: Column) -> Column:
    return {"mean": F.avg, "sum": F.sum, "sd": standard_deviation, "min": F.min, "max": F.max}[method](value)


def range_reduce(df: DataFrame, method: str, t0: float, t1: float, keys: list[str], rep: int = 1, axis=None, time: str = "time", value: str = "value", t_idx: str = "t_idx") -> DataFrame:
    """`range_mean` and the like over [t0, t1]: keys, (slot,) and the result.

    rep > 1 keeps every rep-th step together, counted from the first step of the range: slot is 0..rep-1.
    With sub-annual steps (rep > 1) t0 and t1 are whole years, and a year's steps all belong to it.
    """
    if method not in REDUCERS:
        raise ValueError(f"unknown method {method!r}")
    if rep > 1 and (t0 != int(t0) or t1 != int(t1)):
        raise ValueError("whole years are required with sub-annual steps")
    t = F.floor(time) if rep > 1 else F.col(time)
    whole = axis or extent(df, time)
    if rep > 1 and whole is not None:
        whole = (float(int(whole[0] // 1)), float(int(whole[1] // 1)))
    hit = df.where(F.col(time).between(t0 - TIME_TOLERANCE, t1 + 1 if rep > 1 else t1 + TIME_TOLERANCE)).where(t.between(t0 - TIME_TOLERANCE, t1 + TIME_TOLERANCE))
    by = list(keys)
    if rep > 1:
        hit = hit.withColumn("slot", F.pmod(F.col(t_idx) - F.lit(1), F.lit(rep)).cast("int"))
        by.append("slot")
    if not inside(whole, t0, t1):
        hit = hit.withColumn(value, F.lit(None).cast("double"))
    return hit.groupBy(*by).agg(reducer(method, F.col(value)).alias(value))


def weighted(value: Column, weight: Column) -> Column:
    """Sum of weight * value over the sum of the weights of values that are there."""
    there = F.when(value.isNotNull(), weight)
    total = F.sum(there)
    return F.when(total != 0, F.sum(there * value) / total)


def interpolate(df: DataFrame, t: float, keys: list[str], extrapolate: bool = False, time: str = "time", value: str = "value") -> DataFrame:
    """`interp` and `extrap`: linear between the steps around t; beyond the axis missing, or the end's value.

    Steps are chosen by time alone: if one of the two values is missing the other is taken.
    """
    below = F.max_by(F.struct(time, value), F.when(F.col(time) <= t + TIME_TOLERANCE, F.col(time))).alias("lo")
    above = F.min_by(F.struct(time, value), F.when(F.col(time) > t + TIME_TOLERANCE, F.col(time))).alias("hi")
    two = df.groupBy(*keys).agg(below, above)
    return two.select(*keys, F.lit(t).cast("double").alias(time), blend(F.lit(t), F.col("lo"), F.col("hi"), extrapolate, time, value).alias(value))


def blend(t: Column, lo: Column, hi: Column, extrapolate: bool, time: str = "time", value: str = "value") -> Column:
    """Linear between two structs (time, value) that may be NULL."""
    w = (t - lo[time]) / (hi[time] - lo[time])
    at_node = F.abs(t - lo[time]) <= TIME_TOLERANCE
    ends = F.coalesce(lo[value], hi[value]) if extrapolate else F.when(at_node, lo[value])
    both = F.when(at_node, lo[value]).when(lo[value].isNull(), hi[value]).when(hi[value].isNull(), lo[value]).otherwise(lo[value] * (1 - w) + hi[value] * w)
    return F.when(lo[time].isNull() | hi[time].isNull(), ends).otherwise(both)


def time_axis(spark, x0: float, x1: float, dx: float, n_sub: int = 1) -> DataFrame:
    """The declared time axis: t_idx from 1, time; with n_sub > 1 the middles of each year's parts."""
    n = round((x1 - x0) / dx) + 1
    if n_sub <= 1:
        return spark.range(1, n + 1).select(F.col("id").alias("t_idx"), (F.lit(x0) + (F.col("id") - 1) * dx).alias("time"))
    k = F.col("id") - 1
    return spark.range(1, n * n_sub + 1).select(F.col("id").alias("t_idx"), (F.lit(x0) + F.floor(k / n_sub) * dx + (F.pmod(k, F.lit(n_sub)) + 0.5) / n_sub).alias("time"))


def summary(df: DataFrame, value: str = "value") -> DataFrame:
    """Least, largest and mean value."""
    return df.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


@dataclass(frozen=True)
class Variable:
    """A gridded variable with its file, units, scaling and declared time axis."""

    path: str
    name: str
    units_in: str = ""
    units_out: str = ""
    scale: float = 1.0
    offset: float = 0.0
    with_time: bool = False
    axis: tuple[float, float] = (0.0, 0.0)
    step: float = 0.0
    n_sub: int = 1

    @classmethod
    def from_namelist(cls, nl, group: str, **names: str) -> Variable:
        """From the keys filename, name, units (in, out), scaling (scale, offset) and time (active, x0, x1, dx, parts of a year)."""
        units = [*nl.vector(group, "units", str), "", ""]
        scale, offset = ([*nl.vector(group, "scaling"), 1.0, 0.0][k] if len(nl.vector(group, "scaling")) > k else d for k, d in ((0, 1.0), (1, 0.0)))
        time = [*nl.vector(group, "time"), 0.0, 0.0, 0.0, 0.0, 0.0][:5]
        x1 = time[1] if time[3] == 0.0 else time[2]
        return cls(fill_path(nl.get(group, "filename"), **names), nl.get(group, "name"), units[0], units[1], scale, offset, time[0] >= 0.5, (time[1], x1), time[3], max(1, int(time[4])))

    def load(self, spark) -> DataFrame:
        """The long table (indices, t_idx, value) with its time: the file's steps must be as many as the axis declares."""
        df = spark.read.parquet(self.path)
        if not self.with_time:
            return df
        axis = time_axis(spark, *self.axis, self.step or 1.0, self.n_sub)
        steps_there, declared = df.agg(F.max("t_idx")).first()[0], axis.count()
        if steps_there != declared:
            raise ValueError(f"{self.path}: {steps_there} steps, but the time axis has {declared}")
        return df.drop("time").join(F.broadcast(axis), "t_idx")  # an axis has a row a step

    def update(self, spark, t0: float | None = None, t1: float | None = None, method: str = "exact", rep: int = 1) -> DataFrame:
        """One slice, range, interpolation or reduction, guarded against crazy values and scaled."""
        return self.applied(self.load(spark), t0, t1, method, rep)

    def applied(self, df: DataFrame, t0: float | None = None, t1: float | None = None, method: str = "exact", rep: int = 1) -> DataFrame:
        """The same of rows (indices, t_idx, time, value) that hold the steps needed."""
        keys = [c for c in df.columns if c not in ("time", "t_idx", "value")]
        if not self.with_time:
            out = df
        elif method in ("interp", "extrap"):
            out = interpolate(df, t0, keys, method == "extrap")
        elif method in ("exact", "range"):
            out = steps(df, t0, t1 if method == "range" else None, self._extent())
        elif method.startswith("range_"):
            out = range_reduce(df, method[6:], t0, t0 if t1 is None else t1, keys, rep, self._extent())
        else:
            raise ValueError(f"unknown method {method!r}")
        return out.withColumn("value", scaled(F.col("value"), self.scale, self.offset))

    def _extent(self) -> tuple[float, float]:
        x0, x1 = self.axis
        return (x0, x1) if self.n_sub == 1 else (x0, x1 + 1 - 0.5 / self.n_sub)

    @property
    def parts_of_a_year(self) -> int:
        """The declared number of steps a year."""
        return self.n_sub if self.with_time else 1


def to_grid(df: DataFrame, links: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A field (src, keys, value) on the links' targets, all levels and times in one join."""
    from gridwake.operators.links import apply

    return apply(links, df, "mean", keys=keys, value=value)
