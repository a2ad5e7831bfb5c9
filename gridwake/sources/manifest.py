"""Variables spread over files along time: a manifest, scans of only the files that a slice needs, and a memo of slices.

A manifest lists the files, which steps each holds, and how many steps lie before; one job that reads the step column alone
makes it, and it can be stored. It is as long as the list of files, which Spark's own planning holds too. A slice then
opens only files that overlap it, and what is left of a condition on steps reaches their scan. Memo keeps the steps that
a request needed as a table of their own: requests that lie within them (the same slice again, the next time between
the same two steps) do not read the files any more.

Defined results: files are taken in order of the paths they were given by, steps within a path count from 1; a path without
rows has no steps; requests beyond the axis give what slices.py defines, and open one step of one file for their keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.model import TIME_TOLERANCE
from gridwake.operators.slices import Variable, time_axis
from gridwake.operators.solvers import cut


@dataclass(frozen=True)
class Part:
    """One file with its least and largest step, and the steps of the paths before its own."""

    file: str
    first: int
    last: int
    before: int


def _plain(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri).rstrip("/")


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _plain(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


class Manifest:
    def __init__(self, parts: list[Part], step: str = "t_idx"):
        self.parts, self.step = parts, step
        self.total = max((p.before + p.last for p in parts), default=0)

    @classmethod
    def of(cls, spark: SparkSession, paths: list[str], step: str = "t_idx") -> Manifest:
        """Of Parquet paths (files or folders), in order of their names."""
        roots = [_qualified(spark, p) for p in sorted(paths)]
        found = spark.read.parquet(*sorted(paths)).select(F.col("_metadata.file_path").alias("file"), step).groupBy("file").agg(F.min(step).alias("a"), F.max(step).alias("b")).where("b is not null").collect()
        by_root: dict[str, list] = {r: [] for r in roots}
        for row in found:
            at = _plain(row["file"])
            by_root[next(r for r in roots if at == r or at.startswith(r + "/"))].append(row)
        parts, before = [], 0
        for rows in by_root.values():
            parts += [Part(r["file"], int(r["a"]), int(r["b"]), before) for r in sorted(rows, key=lambda r: (r["a"], r["file"]))]
            before += max((int(r["b"]) for r in rows), default=0)
        return cls(parts, step)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(p.file, p.first, p.last, p.before, self.step) for p in self.parts], "file string, first long, last long, before long, step string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        rows = spark.read.parquet(path).orderBy("before", "first", "file").collect()
        return cls([Part(*r[:4]) for r in rows], rows[0]["step"] if rows else "t_idx")

    def needed(self, first: int, last: int) -> list[Part]:
        """The files that hold some of the steps first..last, counted over all paths."""
        return [p for p in self.parts if p.before + p.last >= first and p.before + p.first <= last]

    def read(self, spark: SparkSession, first: int = 1, last: int | None = None) -> DataFrame:
        """The rows of those steps, numbered over all paths."""
        last = self.total if last is None else last
        parts = self.needed(first, last) or self.parts[:1]
        none = not self.needed(first, last)
        # whole files together; those that reach beyond the slice by how many steps lie before them, with a condition for their scan
        inner = [p for p in parts if p.before + p.first >= first and p.before + p.last <= last]
        frames = []
        if inner:
            known = spark.createDataFrame([(p.file, p.before) for p in inner], "_file string, _before long")
            df = spark.read.parquet(*[p.file for p in inner])
            kind = dict(df.dtypes)[self.step]
            df = df.select("*", F.col("_metadata.file_path").alias("_file")).join(F.broadcast(known), "_file")  # a row a file of the slice
            frames.append(df.withColumn(self.step, (F.col(self.step) + F.col("_before")).cast(kind)).drop("_file", "_before"))
        for before in sorted({p.before for p in parts if p not in inner}):
            df = spark.read.parquet(*[p.file for p in parts if p.before == before and p not in inner])
            kind = dict(df.dtypes)[self.step]
            df = df.where(F.col(self.step).between(first - before, last - before))
            frames.append(df.withColumn(self.step, (F.col(self.step) + before).cast(kind)))
        out = reduce(DataFrame.unionByName, frames)
        return out.where("false") if none else out


class Memo:
    """A variable's slices over the files of a manifest. scans counts how often files were read, opened lists them."""

    def __init__(self, spark: SparkSession, variable: Variable, manifest: Manifest):
        if variable.with_time:
            times = time_axis(spark, *variable.axis, variable.step or 1.0, variable.n_sub).orderBy("t_idx")
            self.times = np.array([r["time"] for r in times.collect()])  # a declared axis: a number a step
            if len(self.times) != manifest.total:
                raise ValueError(f"{variable.path}: {manifest.total} steps, but the time axis has {len(self.times)}")
        self.spark, self.variable, self.manifest = spark, variable, manifest
        self.held: tuple[int, int, DataFrame] | None = None
        self.stored: list[DataFrame] = []
        self.scans, self.opened = 0, []

    def _steps(self, t0: float | None, t1: float | None, method: str, rep: int) -> tuple[int, int]:
        """The first and last step that a request needs; the first of the axis, for its keys, if none."""
        if not self.variable.with_time:
            return 1, max(1, self.manifest.total)
        t = np.floor(self.times) if rep > 1 else self.times
        if method in ("interp", "extrap"):
            at = int(np.searchsorted(t, t0 + TIME_TOLERANCE, side="right"))
            return max(at, 1), min(at + 1, len(t))
        hit = np.flatnonzero((t >= t0 - TIME_TOLERANCE) & (t <= (t0 if t1 is None or method == "exact" else t1) + TIME_TOLERANCE))
        return (int(hit[0]) + 1, int(hit[-1]) + 1) if len(hit) else (1, 1)

    def update(self, t0: float | None = None, t1: float | None = None, method: str = "exact", rep: int = 1) -> DataFrame:
        """What Variable.update gives, from the steps that are held where they are enough."""
        first, last = self._steps(t0, t1, method, rep)
        if self.held is None or not (self.held[0] <= first and last <= self.held[1]):
            self.scans += 1
            self.opened += [p.file for p in self.manifest.needed(first, last)]
            df = self.manifest.read(self.spark, first, last)
            if self.variable.with_time:
                times = self.spark.createDataFrame([(k, float(self.times[k - 1])) for k in range(first, last + 1)], "t_idx long, time double")
                df = df.drop("time").join(F.broadcast(times), "t_idx")  # a row a step of the slice
            self.held = first, last, cut(df)
            self.stored.append(self.held[2])
        return self.variable.applied(self.held[2], t0, t1, method, rep)

    def close(self) -> None:
        """Delete what is stored; slices that were not written yet are lost."""
        if self.stored:
            cut(self.spark.range(0), *self.stored)
        self.held, self.stored = None, []
