"""Exact top-k search by inner product with a pivot table.

Pivots are chosen among the vectors, each as far as possible from the span of those before. The table
holds every vector's distances to all pivots. A query's and a row's distances to one pivot bound their
own distance from below by their difference; all pivots at once bound it by the simplex that the
distances fix, which is never less than the largest of the single bounds (Connor, Vadicamo, Rabitti
2017). With the norms known, a lower bound on the distance is an upper bound on the inner product.

Rows are dealt to blocks by the nearest of the first pivots. A query first meets one block of its own
cell, which gives it a k-th score to beat. Cells that cannot reach it by their intervals of distances
are ruled out; a query meets the blocks of the others, where rows are evaluated in order of their
bounds, and the search stops at the first bound that the k-th score exceeds. Any pivots give the same
result; these are found on a sample of SAMPLE rows (at most; those of least hash).

Defined results: rows without vec_id, vectors that are null, hold null or non-finite components, or could
have scores beyond the range of long, take no part; vectors of unlike length are never compared (empty
ones score 0 with each other); ties go to the smaller vec_id; repeated rows are candidates each, rows of
the query's own vec_id are not, and a query id's different vectors have a list each, equal ones one
together; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import common, vectors
from gridwake.llm.vectors import TILE

SAMPLE = 512
#: Pivots for each dimension of the vectors.
SHARE = 0.75
#: Queries whose bounds are held at once.
BATCH = 128
_FOUND = "query_id long, qkey long, vec_id long, score long"


class Pivots:
    """Pivots of vectors of one length, and the coordinates that distances to them give."""

    def __init__(self, sample: np.ndarray):
        left, chosen, basis = sample.astype(np.float64), [], []
        most = int(np.ceil(SHARE * sample.shape[1]))
        size = (left * left).sum(1)
        floor = 1e-6 * size.max(initial=0)
        while len(chosen) < most and size.max(initial=0) > floor:
            k = int(size.argmax())
            e = left[k] / np.sqrt(size[k])
            chosen.append(k)
            basis.append(e)
            left = left - np.outer(left @ e, e)
            left = left - np.outer(left @ e, e)  # once more against rounding
            size = (left * left).sum(1)
        self.points = sample[chosen].astype(np.float64).reshape(len(chosen), sample.shape[1])
        e = np.array(basis).reshape(len(chosen), sample.shape[1])
        self.norms = (self.points**2).sum(1)
        self.solve = np.linalg.inv(self.points @ e.T).T if len(chosen) else np.zeros((0, 0))

    def table(self, x: np.ndarray) -> np.ndarray:
        """Distances of x to the pivots."""
        d = (x * x).sum(1)[:, None] + self.norms - 2 * x @ self.points.T
        return np.sqrt(np.maximum(d, 0))

    def coordinates(self, norms: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pivots' span, and what is left of the norm outside of it, from squared norms and distances."""
        a = ((norms[:, None] + self.norms - distances**2) / 2) @ self.solve
        return a, np.sqrt(np.maximum(norms - (a * a).sum(1), 0))


def bounds(a: np.ndarray, b: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Upper bounds on the inner products of all pairs with places a, b and remainders r, s, with room for rounding."""
    size_a, size_b = np.sqrt((a * a).sum(1) + r * r), np.sqrt((b * b).sum(1) + s * s)
    return a @ b.T + np.outer(r, s) + np.outer(1e-7 * size_a, size_b) + 1e-6


def in_bound_order(upper: np.ndarray, ids: np.ndarray, score, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows that reach `least`, and how many rows were evaluated.

    Rows are evaluated in runs of decreasing bounds until the k-th score exceeds all bounds that are left.
    """
    open_, got, named, seen, run = np.flatnonzero(upper >= least), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
    while len(open_):
        if len(open_) > run:
            cut = np.argpartition(-upper[open_], run - 1)
            now, open_ = open_[cut[:run]], open_[cut[run:]]
        else:
            now, open_ = open_, open_[:0]
        seen += len(now)
        s = score(now)
        hit = s >= least
        got, named = np.concatenate([got, s[hit]]), np.concatenate([named, ids[now[hit]]])
        if len(got) >= k:
            best = np.lexsort((named, -got))[:k]
            got, named = got[best], named[best]
            least = max(least, got[-1])
        open_ = open_[upper[open_] >= least]
        run *= 4
    best = np.lexsort((named, -got))[:k]
    return named[best], got[best], seen


def search(f: pd.DataFrame, q: pd.DataFrame, pivots: Pivots, dims: int, k: int) -> tuple[pd.DataFrame, int]:
    """The k best rows of block f for each query of q that reach its `least`; and the number of pairs evaluated."""
    out, seen = [pd.DataFrame({"query_id": [], "qkey": [], "vec_id": [], "score": []}).astype("int64")], 0
    if f.empty or q.empty:
        return out[0], seen
    x, y = vectors.unpacked(f["v"], dims), vectors.unpacked(q["v"], dims)
    place = lambda p, d: pivots.coordinates((p * p).sum(1), np.stack(d).reshape(len(p), len(pivots.points)))
    (a, r), (b, s) = place(y, q["away"]), place(x, f["away"])
    ids, qid, qkey = f["vec_id"].to_numpy(), q["vec_id"].to_numpy(), q["qkey"].to_numpy()
    least = q["least"].to_numpy(float, na_value=-np.inf)
    for at in range(0, len(q), BATCH):
        rows = slice(at, at + BATCH)
        upper = np.floor(bounds(a[rows], b, r[rows], s))
        upper[qid[rows][:, None] == ids] = -np.inf
        for i, u in enumerate(upper, at):
            lowest = max(least[i], -(2.0**63))  # own rows lie below
            named, got, n = in_bound_order(u, ids, lambda now, i=i: vectors.exact(y[i : i + 1], x[now])[0], lowest, k)
            seen += n
            out.append(pd.DataFrame({"query_id": qid[i], "qkey": qkey[i], "vec_id": named, "score": got}))
    return pd.concat(out, ignore_index=True), seen


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    rows = common.stored(vectors.integers(embeddings, scale), "topk-rows")
    drawn = rows.select("dims", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).toPandas()
    pivots = {int(d): Pivots(vectors.unpacked(f["v"], int(d))) for d, f in drawn.groupby("dims")}
    plain = lambda d: pivots[d] if d in pivots else Pivots(np.zeros((1, d)))  # noqa: E731  no pivot: norms alone
    cells = max(1, -(-rows.count() // tile))

    @common.lean
    def measured(frames):
        for f in frames:
            for d, g in f.groupby("dims"):
                x = vectors.unpacked(g["v"], d)
                away = plain(d).table(x)
                near = away[:, :cells]
                yield g.assign(away=list(away), norm=(x * x).sum(1), cell=near.argmin(1) if near.shape[1] else 0)

    table = common.stored(rows.mapInPandas(measured, "vec_id long, dims int, v binary, salt int, away array<double>, norm double, cell int"), "topk-table")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    widest = max((len(p.points) for p in pivots.values()), default=0)
    span = [f(F.get("away", F.lit(i))).alias(f"{name}{i}") for i in range(widest) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    sizes = common.stored(table.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq"), F.max("norm").alias("norm"), *span), "topk-cells")
    # of the lengths that have pivots only, so that there are no more cells than pivots
    known = {int(d): f for d, f in sizes.where(F.col("dims").isin(list(pivots))).orderBy("dims", "cell").toPandas().groupby("dims")} if pivots else {}
    # cells whose queries travel together: neighbours by number, up to a tile's size
    bundle = {d: dict(zip(f["cell"], (f["nq"].cumsum() - f["nq"]) // tile, strict=True)) for d, f in known.items()}
    dealing = sizes.select("dims", "cell", vectors.parts(F.col("n"), tile).alias("parts"), vectors.parts(F.col("nq"), tile).alias("deals"))
    placed = table.join(dealing, ["dims", "cell"]).withColumn("part", vectors.dealt(F.col("parts")))
    placed = placed.select("vec_id", "dims", "v", "away", "cell", "part", "deals")
    queries = placed.where(is_query).withColumn("qkey", F.xxhash64("v")).dropDuplicates(["vec_id", "dims", "qkey"])
    queries = queries.withColumn("deal", F.pmod(F.xxhash64("vec_id", "qkey"), "deals").cast("int"))
    queries = queries.select(*[F.col(c).alias(c) for c in ("vec_id", "qkey", "dims", "v", "away", "cell", "part", "deal")])  # names of their own beside placed
    placed = placed.drop("deals")

    def met(key, f: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return search(f, q, plain(int(key[0])), int(key[0]), k)[0]

    home = ["dims", "cell", "part"]
    first = placed.groupBy(*home).cogroup(queries.withColumn("least", F.lit(None).cast("long")).groupBy(*home)).applyInPandas(met, _FOUND)
    first = common.stored(first, "topk-home")
    beat = first.groupBy("query_id", "qkey").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    asked = queries.join(beat.withColumnRenamed("query_id", "vec_id"), ["vec_id", "qkey"], "left")

    @common.lean
    def reached(frames):
        for f in frames:
            for d, g in f.groupby("dims"):
                cells_of = known.get(int(d))
                if cells_of is None:
                    yield g.assign(cells=[[0]] * len(g), bundle=0)
                    continue
                n = len(plain(d).points)
                away, x = np.stack(g["away"]).reshape(len(g), n), vectors.unpacked(g["v"], d)
                lo, hi = (cells_of[[f"{c}{i}" for i in range(n)]].to_numpy(float) for c in ("lo", "hi"))
                gap = np.maximum(lo - away[:, None], away[:, None] - hi).max(2, initial=0)
                norms = (x * x).sum(1)[:, None] + cells_of["norm"].to_numpy(float)
                reach = (norms - gap**2) / 2 + 1e-6 * norms + 1 >= g["least"].to_numpy(float, na_value=-np.inf)[:, None]
                number = cells_of["cell"].to_numpy(np.int32)
                yield g.assign(cells=[number[r] for r in reach], bundle=g["home"].map(bundle[int(d)]))

    asked = asked.select("vec_id", "qkey", "dims", "v", "away", "least", F.col("cell").alias("home"), F.col("part").alias("seen"), "deal")
    asked = common.stored(asked.mapInPandas(reached, "vec_id long, qkey long, dims int, v binary, away array<double>, least long, home int, seen int, deal int, cells array<int>, bundle int"), "topk-asked")
    sent = asked.withColumn("cell", F.explode("cells")).drop("cells").join(dealing.drop("deals"), ["dims", "cell"])
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell <> home or part <> seen")
    sent = sent.select(*[F.col(c).alias(c) for c in ("vec_id", "qkey", "dims", "v", "away", "least", "cell", "part", "bundle", "deal")])
    pair = ["dims", "cell", "part", "bundle", "deal"]
    blocks = placed.join(sent.select(*pair).distinct(), home).select(*[F.col(c).alias(c) for c in (*pair, "vec_id", "v", "away")])
    rest = blocks.groupBy(*pair).cogroup(sent.groupBy(*pair)).applyInPandas(met, _FOUND)
    by = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
with g as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from g q join g c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s
qualify rank <= 20
"""
