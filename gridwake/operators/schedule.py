"""Output times, clocks and timing tables."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def constant_times(t0: float, t1: float, dt: float) -> list[float]:
    """t0 by dt up to the first time that reaches t1."""
    if dt <= 0:
        return [t1]
    return [t0 + k * dt for k in range(math.ceil((t1 - t0) / dt) + 1)]


def parse_range(text: str) -> list[float]:
    """`t0:dt:t1`, or a single time."""
    part = [float(p) for p in text.split(":")]
    if len(part) == 1:
        return part
    if len(part) != 3:
        raise ValueError(f"not a time or t0:dt:t1: {text!r}")
    return constant_times(part[0], part[2], part[1])


def parse_lines(lines: list[str]) -> list[float]:
    """A time or a range a line; blank and # lines are skipped."""
    kept = [s for s in (x.strip() for x in lines) if s and not s.startswith("#")]
    return [t for s in kept for t in parse_range(s)]


def distinct_times(times: list[float], tolerance: float = TOLERANCE) -> list[float]:
    out: list[float] = []
    for t in times:
        if all(abs(t - u) >= tolerance for u in out):
            out.append(t)
    return out


def output_times(method: str, t0: float, t1: float, dt: float = 0.0, times: list[float] | None = None, path: str | None = None) -> list[float]:
    """Times of method none, const, times or file, within [t0, t1], with the end added."""
    if method == "none":
        return []
    if method == "const":
        got = constant_times(t0, t1, dt)
    elif method in ("file", "times"):
        got = parse_lines(Path(path).read_text().splitlines()) if method == "file" else list(times or [])
        got = [t for t in got if t0 <= t <= t1]
        if not got or got[-1] < t1:
            got.append(t1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return distinct_times(got)


def times_table(spark: SparkSession, times: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in times], "time double")


def at_listed_times(df: DataFrame, times: DataFrame, column: str = "time", tolerance: float = TOLERANCE, by: list[str] | None = None) -> DataFrame:
    """Rows whose time is within tolerance of a listed one (of their own key, if `by` names one): an equi-join on cells of that width, no nested loop."""
    by = by or []
    cell = lambda c: F.floor(c / tolerance).cast("long")
    near = times.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("time").alias("_t"), F.explode(F.sequence(cell(F.col("time")) - 1, cell(F.col("time")) + 1)).alias("_c"))
    rows = df.withColumn("_c", cell(F.col(column)))
    on = (rows["_c"] == near["_c"]) & (F.abs(rows[column] - near["_t"]) < tolerance)
    for k in by:
        on &= rows[k] == near[f"_{k}"]
    return rows.join(near, on, "left_semi").drop("_c")


def match_time(df: DataFrame, new: DataFrame, column: str = "time", tolerance: float = 1e-7, by: list[str] | None = None) -> DataFrame:
    """Upsert by time: rows of new replace those at the same time (of the same series, if `by` names its keys), others are added."""
    by = by or []
    same = at_listed_times(df, new.select(*by, F.col(column).alias("time")).distinct(), column, tolerance, by)
    return df.join(same.select(*by, column).distinct(), [*by, column], "left_anti").unionByName(new)


def clock(spark: SparkSession, t0: float, t1: float, dt: float, reference: float = 0.0) -> DataFrame:
    """(n, time, elapsed, calendar): n from 0. Times are multiples of dt, so no sum has to be compensated."""
    n = math.ceil((t1 - t0) / dt - 1e-9)
    elapsed = F.col("id") * F.lit(dt)
    time = F.least(F.lit(t0) + elapsed, F.lit(float(t1)))
    return spark.range(n + 1).select(F.col("id").alias("n"), time.alias("time"), (time - t0).alias("elapsed"), (time - reference).alias("calendar"))


def year_part(time: Column, n_sub: int) -> Column:
    """0-based part of the year of a real-valued time."""
    return F.floor((time - F.floor(time)) * n_sub).cast("int")


def timing_totals(df: DataFrame) -> DataFrame:
    """(label, seconds, model_time, rate) from (label, seconds, model_time) samples."""
    out = df.groupBy("label").agg(F.sum("seconds").alias("seconds"), F.sum("model_time").alias("model_time"))
    return out.withColumn("rate", F.when(F.col("model_time") != 0, F.col("seconds") / F.col("model_time")))
