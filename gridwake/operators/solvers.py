"""Sparse linear systems as tables: A is (i, j, a), vectors are (i, v).

A product is the same join and aggregation as regridding. Solvers are driver loops that hold all
their vectors in one table by i and fetch two scalars a step; each step's table is cut off from its
lineage through the folder in spark.checkpoint.dir (a temporary one only where none is set on a local
master), and the step before it is deleted.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def cut(df: DataFrame, *before: DataFrame) -> DataFrame:
    """df as stored in the shared folder; the tables `before`, cut earlier and not needed any more, are deleted."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gridwake-steps-"))
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/gridwake/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    for x in before:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.cut_at)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return out


def product(a: DataFrame, x: DataFrame, value: str = "v") -> DataFrame:
    """A x as (i, v); rows without an entry are 0 and left out."""
    return a.join(x.select(F.col("i").alias("j"), F.col(value).alias("_x")), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("_x")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")


def jacobi(a: DataFrame, b: DataFrame, tol: float = 1e-10, most: int = 200) -> tuple[DataFrame, int, float]:
    """(x, steps, relative residual) for a diagonally dominant matrix."""
    diagonal = a.where("i = j").select("i", F.col("a").alias("d"))
    rest = cut(a.where("i <> j"))
    state = cut(b.join(diagonal, "i").select("i", F.col("v").alias("b"), "d", F.lit(0.0).alias("v")))
    scale = state.agg(F.sqrt(F.sum(F.col("b") * F.col("b")))).first()[0] or 1.0
    change = float("inf")
    for step in range(1, most + 1):
        off = product(rest, state).withColumnRenamed("v", "off")
        state = cut(state.join(off, "i", "left").select("i", "b", "d", ((F.col("b") - F.coalesce("off", F.lit(0.0))) / F.col("d")).alias("v"), F.col("v").alias("old")), state)
        change = state.agg(F.sqrt(F.sum(F.pow((F.col("v") - F.col("old")) * F.col("d"), 2)))).first()[0] / scale
        if change <= tol:
            break
    return state.select("i", "v"), step, change


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-10, most: int = 500) -> tuple[DataFrame, int, float]:
    """(x, steps, relative residual) for a symmetric positive definite matrix, preconditioned by its diagonal."""
    diagonal = a.where("i = j").select("i", F.col("a").alias("d"))
    s = b.join(diagonal, "i").select("i", "d", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.col("d")).alias("p"))
    s = held = cut(s)
    dot = F.sum(F.col("r") * F.col("r") / F.col("d"))
    rz, norm = s.agg(dot, F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
    if not rz:
        return s.select("i", F.col("x").alias("v")), 0, 0.0
    first, residual = norm, 1.0
    for step in range(1, most + 1):
        s = held = cut(s.join(product(a, s, "p").withColumnRenamed("v", "q"), "i", "left").fillna(0.0, ["q"]), held)
        alpha = rz / s.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        s = s.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new, norm = s.agg(dot, F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
        residual = norm / first
        if residual <= tol:
            break
        s = s.withColumn("p", F.col("r") / F.col("d") + new / rz * F.col("p"))
        rz = new
    return s.select("i", F.col("x").alias("v")), step, residual


def power_iteration(a: DataFrame, start: DataFrame, tol: float = 1e-9, most: int = 200) -> tuple[float, DataFrame]:
    """The eigenvalue of largest size and its unit vector."""
    x, value = start, 0.0
    for _ in range(most):
        y = cut(product(a, x))
        size = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
        new = y.join(x.withColumnRenamed("v", "_x"), "i").agg(F.sum(F.col("v") * F.col("_x"))).first()[0]
        x = y.select("i", (F.col("v") / size).alias("v"))
        if abs(new - value) <= tol * abs(new):
            return float(new), x
        value = new
    return float(value), x


def bicgstab(a: DataFrame, b: DataFrame, tol: float = 1e-10, most: int = 500) -> tuple[DataFrame, int, float]:
    """(x, steps, relative residual) for a general matrix, preconditioned by its diagonal (van der Vorst 1992)."""
    diagonal = a.where("i = j").select("i", F.col("a").alias("d"))
    s = b.join(diagonal, "i").select("i", "d", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("r0"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    s = held = cut(s)
    sums = lambda *pairs: s.agg(*[F.sum(F.col(x) * F.col(y)) for x, y in pairs]).first()
    rho, first = sums(("r0", "r"))[0], sums(("r", "r"))[0] ** 0.5
    if not first:
        return s.select("i", F.col("x").alias("v")), 0, 0.0
    before, alpha, omega, residual, step = 1.0, 1.0, 1.0, 1.0, 0
    scaled = lambda c: F.col(c) / F.col("d")
    times = lambda df, c, out: df.join(product(a, df.select("i", scaled(c).alias("y")), "y").withColumnRenamed("v", out), "i", "left").fillna(0.0, [out])
    for step in range(1, most + 1):
        beta = rho / before * (alpha / omega) if step > 1 else 0.0
        s = s.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v"))).drop("v")
        s = held = cut(times(s, "p", "v"), held)
        alpha = rho / sums(("r0", "v"))[0]
        s = s.withColumn("h", F.col("r") - alpha * F.col("v"))
        s = held = cut(times(s, "h", "t"), held)
        th, tt = sums(("t", "h"), ("t", "t"))
        omega = th / tt if tt else 0.0
        s = s.select("i", "d", (F.col("x") + alpha * scaled("p") + omega * scaled("h")).alias("x"), (F.col("h") - omega * F.col("t")).alias("r"), "r0", "p", "v")
        before = rho
        rho, rr = sums(("r0", "r"), ("r", "r"))
        residual = rr**0.5 / first
        if residual <= tol or not omega:
            break
    return s.select("i", F.col("x").alias("v")), step, residual
