"""k nearest neighbours of points, however unevenly they are spread.

A k-d tree of at most LEAVES leaves is fitted to a sample of the sources (about SAMPLE of them a leaf, the only points
that the driver sees); it decides where points go, not what is found. A leaf with many sources is dealt to several
blocks of some LEAF, so that neither a dense cluster nor many copies of one place make a large group. A target
first meets one block of its own leaf. The k-th distance found there, or the distance within which the leaves' tight
boxes are sure to hold k sources, bounds the rest: in a second round the target meets only blocks of leaves whose
box it reaches. Inside a block the same is done once more with boxes of BOX points, nearest first.

Defined results: of equal distances the smaller src comes first; points with a null or nan coordinate have no
neighbours and are none; sources of one place are all found; fewer sources than k are all returned; empty tables give no
row; dst must name one target; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.operators.solvers import cut

LEAF, LEAVES, SAMPLE, BOX = 4096, 4096, 64, 16
#: Targets whose distances to boxes are held at once.
BATCH = 512


class Splits:
    """A k-d tree as heap-ordered arrays: at each node the widest axis and its median."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.at = depth, np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        held = {0: points}
        for node in range(2**depth - 1):
            p = held.pop(node)
            if len(p):
                self.axis[node] = np.argmax(p.max(0) - p.min(0))
                x = p[:, self.axis[node]]
                self.at[node] = np.median(x)
                right = x > self.at[node]
            else:
                right = np.zeros(0, bool)
            held[2 * node + 1], held[2 * node + 2] = p[~right], p[right]

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)


class Boxes:
    """Points in boxes of at most BOX, by halves along the widest axis."""

    def __init__(self, p: np.ndarray):
        order, spans, leaves = np.arange(len(p)), [(0, len(p))], []
        while spans:
            lo, hi = spans.pop()
            if hi - lo <= BOX:
                leaves.append((lo, hi))
                continue
            x = p[order[lo:hi]]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(x[:, np.argmax(x.max(0) - x.min(0))], half)]
            spans += [(lo, lo + half), (lo + half, hi)]
        self.rows = np.full((len(leaves), BOX), -1)
        for n, (lo, hi) in enumerate(leaves):
            self.rows[n, : hi - lo] = order[lo:hi]
        self.points = np.where((self.rows >= 0)[..., None], p[self.rows], np.nan)
        self.low, self.high = np.nanmin(self.points, 1), np.nanmax(self.points, 1)

    def nearest(self, t: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Squared distances and rows of the k nearest points of each t within bound (squared), inf and -1 behind; and the pairs formed."""
        best, who = np.full((len(t), k), np.inf), np.full((len(t), k), np.iinfo(np.int64).max)
        pairs = 0
        for at in range(0, len(t), BATCH):
            some = slice(at, at + BATCH)
            x = t[some]
            far = reach(x, self.low, self.high)
            order = np.argsort(far, 1, kind="stable")
            far = np.take_along_axis(far, order, 1)
            d, w, limit, live = best[some], who[some], bound[some].copy(), np.arange(len(x))
            for turn in range(order.shape[1]):
                live = live[far[live, turn] <= np.minimum(limit[live], d[live, -1])]
                if not len(live):
                    break
                box = order[live, turn]
                new = ((self.points[box] - x[live, None]) ** 2).sum(2)
                pairs += int((~np.isnan(new)).sum())
                new[np.isnan(new) | (new > limit[live, None])] = np.inf
                every, rows = np.concatenate([d[live], new], 1), np.concatenate([w[live], self.rows[box]], 1)
                first = np.lexsort((rows, every), axis=1)[:, :k]
                d[live], w[live] = np.take_along_axis(every, first, 1), np.take_along_axis(rows, first, 1)
        return best, np.where(np.isinf(best), -1, who), pairs


def reach(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes (0 inside); never more than to a point of the box, as rounding is monotone."""
    out = np.zeros((len(p), len(low)))
    for c in range(p.shape[1]):
        d = np.maximum(np.maximum(low[:, c] - p[:, c, None], p[:, c, None] - high[:, c]), 0)
        out += d * d
    return out


def nearest(targets: DataFrame, sources: DataFrame, k: int, dims: tuple[str, ...] = ("x", "y"), dist_max: float | None = None, leaf: int = LEAF) -> DataFrame:
    """(dst, src, dist, rank): the k nearest sources of each target within dist_max. targets (dst, dims), sources (src, dims)."""
    dims, leaf = list(dims), max(leaf, 2 * k)
    kinds = dict(targets.dtypes)["dst"], dict(sources.dtypes)["src"]
    place = [f"p{i}" for i in range(len(dims))]

    def usable(df: DataFrame, name: str) -> DataFrame:
        df = df.select(name, *[F.col(c).cast("double").alias(p) for c, p in zip(dims, place, strict=True)])
        for p in place:
            df = df.where(F.col(p).isNotNull() & ~F.isnan(p))
        return df

    sources, targets = usable(sources, "src"), usable(targets, "dst")
    total = sources.count()
    depth = min(LEAVES, max(1, -(-total // leaf)) * 2 - 1).bit_length() - 1
    share = min(1.0, SAMPLE * 2**depth / max(total, 1))
    drawn = sources.where(F.pmod(F.xxhash64("src", *place), F.lit(1 << 30)) < int(share * (1 << 30))) if depth else sources.where("false")
    splits = Splits(drawn.select(*place).toPandas().to_numpy(float), depth)

    def in_leaf(df: DataFrame, name: str, kind: str) -> DataFrame:
        def run(frames):
            for f in frames:
                yield f.assign(leaf=splits.leaf(f[place].to_numpy(float)))

        return df.mapInPandas(run, ", ".join([f"{name} {kind}", *(f"{p} double" for p in place), "leaf int"]))

    rows = cut(in_leaf(sources, "src", kinds[1]))
    parts = F.ceil(F.count("*") / F.lit(leaf)).cast("int")
    boxes = cut(rows.groupBy("leaf").agg(F.count("*").alias("n"), parts.alias("parts"), *[f(p).alias(f"{g}{p}") for p in place for f, g in ((F.min, "lo"), (F.max, "hi"))]))
    known = boxes.orderBy("leaf").toPandas()  # one row a leaf
    number, held, pieces = known["leaf"].to_numpy(), known["n"].to_numpy(), known["parts"].to_numpy()
    low, high = (known[[f"{g}{p}" for p in place]].to_numpy(float) for g in ("lo", "hi"))
    blocks = rows.join(boxes.select("leaf", "parts"), "leaf").withColumn("part", F.pmod(F.xxhash64("src", *place), "parts").cast("int")).drop("parts")
    limit = np.inf if dist_max is None else dist_max * dist_max * (1 + 1e-12)

    def home(frames):
        for f in frames:
            if len(number):
                far = reach(f[place].to_numpy(float), low, high)
                at = far.argmin(1)  # the nearest box: its own, if it is in one
                yield f.assign(leaf=number[at], pick=pieces[at], bound=limit)

    t_schema = ", ".join([f"dst {kinds[0]}", *(f"{p} double" for p in place), "leaf int, pick int, bound double"])
    asked = targets.mapInPandas(home, t_schema).withColumn("part", F.pmod(F.xxhash64("dst"), "pick").cast("int")).drop("pick")
    found_schema = f"dst {kinds[0]}, src {kinds[1]}, d2 double"

    def met(asked: DataFrame) -> DataFrame:
        """asked (dst, place, leaf, part, bound) against the blocks that they name, in groups of bounded size."""
        asked = cut(asked)
        deals = asked.groupBy("leaf", "part").agg(F.ceil(F.count("*") / F.lit(4 * leaf)).cast("int").alias("deals"))
        some = asked.join(deals, ["leaf", "part"]).withColumn("deal", F.pmod(F.xxhash64("dst"), "deals").cast("int"))
        some = some.select(*[F.col(c).alias(c) for c in ("dst", *place, "leaf", "part", "deal", "bound")])
        held = blocks.join(deals, ["leaf", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        held = held.select(*[F.col(c).alias(c) for c in ("src", *place, "leaf", "part", "deal")])

        def run(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if s.empty or t.empty:
                return pd.DataFrame({"dst": [], "src": [], "d2": []})
            s = s.sort_values("src", kind="stable")  # rows are by src, so that of equal distances the smaller one is first
            d, who, _ = Boxes(s[place].to_numpy(float)).nearest(t[place].to_numpy(float), t["bound"].to_numpy(float), k)
            i, n = np.nonzero(who >= 0)
            return pd.DataFrame({"dst": t["dst"].to_numpy()[i], "src": s["src"].to_numpy()[who[i, n]], "d2": d[i, n]})

        by = ["leaf", "part", "deal"]
        return held.groupBy(*by).cogroup(some.groupBy(*by)).applyInPandas(run, found_schema)

    first = cut(met(asked))
    seen = first.groupBy("dst").agg(F.when(F.count("*") >= k, F.max("d2")).alias("kth"))
    again = asked.withColumnRenamed("leaf", "home").withColumnRenamed("part", "seen").join(seen, "dst", "left")

    def further(frames):
        for f in frames:
            p = f[place].to_numpy(float)
            far = reach(p, low, high)
            corner = np.zeros(far.shape)
            for c in range(p.shape[1]):
                d = np.maximum(np.abs(p[:, c, None] - low[:, c]), np.abs(p[:, c, None] - high[:, c]))
                corner += d * d
            order = np.argsort(corner, 1)
            enough = np.cumsum(held[order], 1) >= k  # so many leaves hold k sources for sure
            sure = np.where(enough.any(1), np.take_along_axis(np.take_along_axis(corner, order, 1), enough.argmax(1)[:, None], 1)[:, 0] * (1 + 1e-12), np.inf)
            bound = np.minimum(np.minimum(np.where(f["kth"].isna(), np.inf, f["kth"].to_numpy(float)), sure), f["bound"].to_numpy(float))
            i, n = np.nonzero(far <= bound[:, None])
            yield f.iloc[i].assign(leaf=number[n], parts=pieces[n], bound=bound[i]).drop(columns="kth")

    schema = ", ".join([f"dst {kinds[0]}", *(f"{p} double" for p in place), "home int, bound double, seen int, leaf int, parts int"])
    again = again.select("dst", *place, "home", "bound", "seen", "kth").mapInPandas(further, schema)
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("leaf <> home or part <> seen")
    every = first.unionByName(met(again.select("dst", *place, "leaf", "part", "bound")))
    out = every.withColumn("dist", F.sqrt("d2"))
    if dist_max is not None:
        out = out.where(F.col("dist") <= dist_max)
    top = Window.partitionBy("dst").orderBy("dist", "src")
    return out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("dst", "src", "dist", "rank")


def nearest_on_sphere(targets: DataFrame, sources: DataFrame, k: int, dist_max: float | None = None, body=None, leaf: int = LEAF) -> DataFrame:
    """(dst, src, chord, dist, rank) for targets (dst, lon, lat), sources (src, lon, lat): ranked by the unit sphere's chord, dist in geodesic metres.

    dist_max is in metres.
    """
    def embedded(df: DataFrame, name: str) -> DataFrame:
        x, y, z = geo.sphere_embed(F.col("lon"), F.col("lat"))
        return df.select(name, x.alias("x"), y.alias("y"), z.alias("z"))

    near = nearest(embedded(targets, "dst"), embedded(sources, "src"), k, ("x", "y", "z"), leaf=leaf)
    both = near.join(targets.select("dst", "lon", "lat"), "dst").join(sources.select("src", F.col("lon").alias("lonn"), F.col("lat").alias("latn")), "src")
    out = both.select("dst", "src", F.col("dist").alias("chord"), geo.planet_distance(body)("lon", "lat", "lonn", "latn").alias("dist"), "rank")
    return out if dist_max is None else out.where(F.col("dist") <= dist_max)
