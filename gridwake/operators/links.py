"""Sparse links between cells: build, prune, bake, store and apply.

Links are rows (dst, src, w) or (dst, src, dist, quadrant, xn, yn), with an optional `pos` (place in
link order) that breaks ties. Applying them is one equi-join with the field on src and one grouped
aggregation by dst, which Spark combines before its shuffle; Spark broadcasts the smaller side by
its own size limits. Only weights above 0 and values that are there count; a target without any is NULL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.operators.neighbours import nearest  # noqa: F401  the map build of this module's callers
from gridwake.sources.arrays import ClassicFile

TINY = 1e-12
PRUNE = 1e-4


def _position() -> Column:
    return F.col("src").cast("long")


def _joined(links: DataFrame, field: DataFrame, value: str) -> DataFrame:
    pos = links if "pos" in links.columns else links.withColumn("pos", _position())
    return pos.join(field.where(F.col(value).isNotNull()), "src")


def apply(links: DataFrame, field: DataFrame, method: str = "mean", keys: list[str] | None = None, value: str = "value", radius: float | None = None) -> DataFrame:
    """(dst, keys, value). method: mean, count (weighted mode) or stdev over w; nn, shepard, radius, quadrant or bilinear over dist."""
    keys = list(keys or [])
    by = ["dst", *keys]
    v = F.col(value)
    if method in ("nn", "shepard", "radius", "quadrant", "bilinear") and "dist" in links.columns:
        rows = _joined(links, field, value)
        if radius is not None:
            rows = rows.where(F.col("dist") <= radius)
        if method == "nn":
            return rows.groupBy(*by).agg(F.min_by(v, F.struct("dist", "pos")).alias(value))
        if method in ("shepard", "radius"):
            return _weighted(rows.withColumn("w", shepard_weight(F.col("dist"))), by, value)
        near = rows.where("quadrant between 1 and 4").groupBy(*by, "quadrant").agg(F.min(F.struct("dist", "pos", v.alias("v"), *[c for c in ("xn", "yn") if c in rows.columns])).alias("n"))
        if method == "quadrant":
            return _weighted(near.select(*by, F.col("n.v").alias(value), shepard_weight(F.col("n.dist")).alias("w")), by, value)
        return _corners(near, links, by, value)
    rows = _joined(links, field, value).where("w > 0")
    if method in ("mean", "shepard", "bilinear"):
        return _weighted(rows, by, value)
    if method == "count":
        votes = rows.groupBy(*by, value).agg(F.sum("w").alias("total"), F.min("pos").alias("first"))
        return votes.groupBy(*by).agg(F.max_by(v, F.struct("total", -F.col("first"))).alias(value))
    if method == "stdev":
        centre = _weighted(rows, by, value).withColumnRenamed(value, "_mean")
        far = F.col("w") * F.pow(v - F.col("_mean"), 2)
        return rows.join(centre, by).groupBy(*by).agg(F.sqrt(F.sum(far) / F.sum("w")).alias(value))
    raise ValueError(f"unknown method {method!r}")


def _weighted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def shepard_weight(dist: Column, power: float = 2.0, least: float = TINY) -> Column:
    return F.pow(F.greatest(dist, F.lit(least)), -power)


def _corners(near: DataFrame, links: DataFrame, by: list[str], value: str) -> DataFrame:
    """Bilinear between the nearest of each quadrant (1 NE, 2 NW, 3 SW, 4 SE) where there are four, else inverse distance.

    The target's place is the links' (x, y) columns; distances are plane ones.
    """
    place = links.groupBy("dst").agg(F.first("x").alias("_x"), F.first("y").alias("_y"))
    wide = near.groupBy(*by).agg(*[F.max(F.when(F.col("quadrant") == q, F.col("n"))).alias(f"q{q}") for q in (1, 2, 3, 4)]).join(place, "dst")
    q1, q2, q3, q4 = (F.col(f"q{i}") for i in (1, 2, 3, 4))
    top, low = (q2["yn"] + q1["yn"]) / 2, (q3["yn"] + q4["yn"]) / 2

    def part(along, whole):
        return F.when(whole > 0, along / whole).otherwise(F.lit(0.0))

    a1 = part(F.hypot(F.col("_x") - q2["xn"], top - q2["yn"]), F.hypot(q1["xn"] - q2["xn"], q1["yn"] - q2["yn"]))
    a2 = part(F.hypot(F.col("_x") - q3["xn"], low - q3["yn"]), F.hypot(q4["xn"] - q3["xn"], q4["yn"] - q3["yn"]))
    a3 = part(F.abs(F.col("_y") - low), F.abs(top - low))
    upper, lower = q2["v"] + a1 * (q1["v"] - q2["v"]), q3["v"] + a2 * (q4["v"] - q3["v"])
    there = [F.when(q.isNotNull(), shepard_weight(q["dist"])).otherwise(F.lit(0.0)) for q in (q1, q2, q3, q4)]
    spread = sum(w * F.coalesce(q["v"], F.lit(0.0)) for w, q in zip(there, (q1, q2, q3, q4), strict=True)) / sum(there)
    four = q1.isNotNull() & q2.isNotNull() & q3.isNotNull() & q4.isNotNull()
    return wide.select(*by, F.when(four, lower + a3 * (upper - lower)).otherwise(spread).alias(value))


def on_targets(result: DataFrame, targets: DataFrame, keys: list[str] | None = None, value: str = "value", old: str | None = None, mask: Column | None = None) -> DataFrame:
    """A row for each target: unmapped ones are NULL, or keep the column `old`; so do those that mask leaves out."""
    out = targets.join(result, ["dst", *(keys or [])], "left")
    new = F.col(value) if mask is None else F.when(mask, F.col(value))
    return out.withColumn(value, F.coalesce(new, F.col(old)) if old else new)


def prune(links: DataFrame, cutoff: float = PRUNE) -> DataFrame:
    """Without links of less than cutoff times their target's total weight.

    The totals are a grouped aggregation joined back, so a target with many links is split over tasks.
    """
    total = links.groupBy("dst").agg(F.sum("w").alias("_total"))
    return links.join(total, "dst").where(F.col("w") >= cutoff * F.col("_total")).select(*links.columns)


def bake(links: DataFrame, power: float = 2.0) -> DataFrame:
    """(dst, src, w): frozen inverse-distance weights that add up to 1 for each target."""
    w = links.withColumn("w", shepard_weight(F.col("dist"), power))
    total = w.groupBy("dst").agg(F.sum("w").alias("_total"))
    return w.join(total, "dst").select("dst", "src", (F.col("w") / F.col("_total")).alias("w"))


def write(links: DataFrame, path: str, scrip_only: bool = False) -> None:
    """As Parquet, by dst; scrip_only keeps addresses and weights alone."""
    if scrip_only:
        links = links.select("dst", "src", "w")
    links.repartitionByRange("dst").sortWithinPartitions("dst").write.mode("overwrite").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bake_bilinear(links: DataFrame) -> DataFrame:
    """(dst, src, w): frozen bilinear weights of targets with a neighbour in every quadrant, else inverse-distance ones.

    links (dst, src, dist, x, y, xn, yn, quadrant): the weights are those that apply(..., "bilinear") gives its values.
    """
    nearest_of = lambda q: F.min(F.when(F.col("quadrant") == q, F.struct("dist", "src", "xn", "yn"))).alias(f"q{q}")
    wide = links.groupBy("dst").agg(F.first("x").alias("x"), F.first("y").alias("y"), *[nearest_of(q) for q in (1, 2, 3, 4)])
    x, y = F.col("x"), F.col("y")
    q = {k: F.col(f"q{k}") for k in (1, 2, 3, 4)}
    mid = lambda a, b: (q[a]["yn"] + q[b]["yn"]) / 2
    part = lambda at, height, a, b: F.coalesce(F.hypot(at - q[a]["xn"], height - q[a]["yn"]) / F.nullif(F.hypot(q[b]["xn"] - q[a]["xn"], q[b]["yn"] - q[a]["yn"]), F.lit(0.0)), F.lit(0.0))
    top, low = mid(2, 1), mid(3, 4)
    a1, a2 = part(x, top, 2, 1), part(x, low, 3, 4)
    a3 = F.coalesce(F.abs(y - low) / F.nullif(F.abs(top - low), F.lit(0.0)), F.lit(0.0))
    four = {3: (1 - a2) * (1 - a3), 4: a2 * (1 - a3), 2: (1 - a1) * a3, 1: a1 * a3}
    every = q[1].isNotNull() & q[2].isNotNull() & q[3].isNotNull() & q[4].isNotNull()
    pairs = F.array(*[F.struct(q[k]["src"].alias("src"), F.when(every, four[k]).otherwise(shepard_weight(q[k]["dist"])).alias("w"), every.alias("four")) for k in (1, 2, 3, 4)])
    rows = wide.select("dst", F.inline(pairs)).where("src is not null")
    total = rows.groupBy("dst").agg(F.sum("w").alias("_total"))
    return rows.join(total, "dst").select("dst", "src", F.when(F.col("four"), F.col("w")).otherwise(F.col("w") / F.col("_total")).alias("w"))


def write_scrip(links: DataFrame, path: str, n_src: int, n_dst: int, scrip_only: bool = False) -> None:
    """A map file for other tools: addresses and a weight matrix, and, for distance links, what their kernels need.

    A classic netCDF file of one map, links by dst and src, each task writing a range of it.
    """
    from gridwake.sources.sink import positions, write_arrays

    distance = "dist" in links.columns
    extra = [c for c in ("dist", "quadrant", "xn", "yn") if distance and c in links.columns]
    weights = links.join(bake(links), ["dst", "src"]) if distance else links
    p, n = positions(weights.select("dst", "src", "w", *extra), ["dst", "src"])
    kind = 2 if distance and not scrip_only else 1
    column = lambda c, code="f8": ("num_links", p.select("at", F.col(c).cast("double").alias("v")), {}, code)
    of = {"src_address": column("src", "i4"), "dst_address": column("dst", "i4"), "remap_matrix": column("w")}
    if kind == 2:
        of |= {f"mp_{c}": column(c, "i4" if c == "quadrant" else "f8") for c in extra}
    variables: dict = {"meta": (["params"], np.array([n_src, n_dst, kind], "i4"), {})}
    variables |= {name: ([d, "num_wgts"] if name == "remap_matrix" else [d], *rest) for name, (d, *rest) in of.items()}
    write_arrays(links.sparkSession, path, {"num_links": n, "num_wgts": 1, "params": 3}, variables)


def read_scrip(spark, path: str) -> DataFrame:
    """Links of a map file: (dst, src, w), or (dst, src, dist, ...) of a distance map. Files without `meta` hold weights."""
    f = ClassicFile(path)
    whole = lambda name: f.steps(name, 0, f.shape(name)[0])
    distance = "meta" in f.vars and int(whole("meta")[2]) == 2
    columns = {"dst": whole("dst_address"), "src": whole("src_address")}
    if distance:
        columns |= {c: whole(f"mp_{c}") for c in ("dist", "quadrant", "xn", "yn") if f"mp_{c}" in f.vars}
    else:
        columns["w"] = whole("remap_matrix").reshape(len(columns["dst"]), -1)[:, 0]
    p = pd.DataFrame({k: v.astype("i8" if v.dtype.kind in "iu" else "f8") for k, v in columns.items()})
    return spark.createDataFrame(p)


def masked_average(df: DataFrame, by: list[str], value: Column, weight: Column, mask: Column | None = None) -> DataFrame:
    """Weighted mean over what is there and unmasked."""
    use = value.isNotNull() if mask is None else value.isNotNull() & mask
    return df.groupBy(*by).agg((F.sum(F.when(use, weight * value)) / F.sum(F.when(use, weight))).alias("value"))


def most_frequent(df: DataFrame, by: list[str], value: str = "value", weight: str = "w", pos: str = "pos") -> DataFrame:
    """Weighted mode; of equal totals the value met first."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("t"), F.min(pos).alias("p"))
    return votes.groupBy(*by).agg(F.max_by(F.col(value), F.struct("t", -F.col("p"))).alias(value))


# --- building links ---------------------------------------------------------------------------


#: Ids that one row of a place holds at most.
IDS = 1024


def _by_place(points: DataFrame, ident: str, dims: tuple[str, ...]) -> DataFrame:
    """(dims, ids): a row for up to IDS points of equal place."""
    turn = F.row_number().over(Window.partitionBy(*dims).orderBy(ident))
    rows = points.select(ident, *dims, F.floor((turn - 1) / IDS).alias("_part"))
    return rows.groupBy(*dims, "_part").agg(F.collect_list(ident).alias("ids")).drop("_part")


def radius_pairs(targets: DataFrame, sources: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y"), digits: int | None = None) -> DataFrame:
    """(dst, src, dist): all pairs within radius (inclusive), dist rounded if digits are given. targets (dst, dims), sources (src, dims).

    Points meet by cell of a lattice of that width: a target looks into the 3**d cells around its own. Points of equal place
    meet others once, as a list, which is spread into pairs when the distance is known.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    s = _by_place(sources, "src", dims).select(F.col("ids").alias("_srcs"), *[F.col(c).alias(f"_{c}") for c in dims], *[cell(c).alias(f"c_{c}") for c in dims])
    t = _by_place(targets, "dst", dims).withColumnRenamed("ids", "_dsts")
    for c in dims:
        t = t.withColumn(f"c_{c}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    d2 = sum(F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in dims)
    near = s.join(t.hint("merge"), [f"c_{c}" for c in dims]).withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= radius)
    near = near.select("_dsts", "_srcs", (F.col("dist") if digits is None else F.round("dist", digits)).alias("dist"))
    return near.select(F.explode("_dsts").alias("dst"), "_srcs", "dist").select("dst", F.explode("_srcs").alias("src"), "dist")


def quadrant(x: Column, y: Column, xn: Column, yn: Column) -> Column:
    """Of a neighbour in the plane: 1 right of and not below, 2 above and not right, 3 left of and not above, else 4."""
    return F.when((xn > x) & (yn >= y), 1).when((xn <= x) & (yn > y), 2).when((xn < x) & (yn <= y), 3).otherwise(4)


class Registry:
    """Grids by name, and links between two of them by method: built on first use, stored under `path`, and read from
    there again by later sessions unless load is False. What is stored names both grids; a map of others is built anew."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path
        self.grids: dict = {}
        self.maps: dict = {}

    def add(self, name: str, grid) -> None:
        if name in self.grids:
            raise ValueError(f"grid {name!r} is there already")
        self.grids[name] = grid

    def links(self, source: str, target: str, method: str, build, load: bool = True) -> DataFrame:
        key = (source, target, method)
        if key not in self.maps:
            # the folder's name follows from both grids' parameters, so a map of another grid of that name is no hit
            of = hashlib.blake2b(repr((self.grids[source], self.grids[target])).encode(), digest_size=6).hexdigest()
            at = f"{self.path}/{source}-{target}-{method}-{of}" if self.path else None
            links = self._stored(at) if at and load else None
            if links is None:
                links = build(self.grids[source], self.grids[target], method)
                if at:
                    links.write.mode("overwrite").parquet(at)
                    links = self.spark.read.parquet(at)
            self.maps[key] = links
        return self.maps[key]

    def _stored(self, at: str) -> DataFrame | None:
        """The links of an earlier session, if they were written to the end."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(at)

    def prime(self, pairs, build) -> None:
        """Build, or load, the links of (source, target, method) triples ahead of use."""
        for source, target, method in pairs:
            self.links(source, target, method, build)

    def remap(self, source: str, target: str, method: str, build, field: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
        """A field (src, keys, value) of any number of levels on the target grid; equal grids are passed through."""
        if self.grids[source] == self.grids[target]:
            return field.withColumnRenamed("src", "dst")
        return apply(self.links(source, target, method, build), field, "mean", keys, value)
