"""Hard negatives by branch-and-bound over ball trees.

Rows are dealt to blocks, those of one label together as far as a block's size allows, and every block
is built into a ball tree once: a node is a centre, a radius, and the label if all its rows have one. An
anchor's inner product with a row of a node lies within |anchor| * radius of that with the centre. The
same search serves both steps: an anchor's positives are the best rows of its label, without a window; then
the windows that the positives' scores open are searched for other labels. A node is left out if it
holds no row of a label that counts, if it lies outside of all windows of an anchor that are still
open, or strictly beneath the k-th score found so far; what is left of a leaf is evaluated exactly.

Defined results: rows without vec_id or label, vectors that are null, hold null or non-finite components,
or could have scores beyond the range of long, take no part; vectors of unlike length are never compared;
ties go to the smaller vec_id; repeated rows are candidates each, rows of the anchor's own vec_id are
neither its positives nor its negatives, and an anchor id's different vectors or labels are mined each,
equal ones once; positives of negative score have an empty window; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import common, vectors
from gridwake.llm.vectors import TILE

LEAF = 32
#: Anchors that are searched for at once.
BATCH = 256
#: Leaves that an anchor sees before the k-th scores close others.
FIRST = 4
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Rows in leaf order, and nodes with their range of rows; children come after their parent."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order, spans, parents, at = np.arange(len(x)), [(0, len(x))], [-1], 0
        while at < len(spans):
            lo, hi = spans[at]
            if hi - lo > LEAF:
                rows = order[lo:hi]
                p = x[rows]
                far = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
                other = p[((p - far) ** 2).sum(1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = rows[np.argsort(p @ (other - far), kind="stable")]
                spans += [(lo, lo + half), (lo + half, hi)]
                parents += [at, at]
            at += 1
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.span, self.parent = np.array(spans), np.array(parents)
        leaf = np.ones(len(spans), bool)
        leaf[self.parent[1:]] = False
        self.leaves = np.flatnonzero(leaf)
        self.centre, self.radius = np.zeros((len(spans), x.shape[1])), np.zeros(len(spans))
        self.only, self.label = np.zeros(len(spans), bool), np.zeros(len(spans), np.int64)
        for n, (lo, hi) in enumerate(spans):
            self.centre[n] = self.x[lo:hi].mean(0)
            self.radius[n] = np.sqrt(((self.x[lo:hi] - self.centre[n]) ** 2).sum(1).max())
            self.label[n], self.only[n] = self.labels[lo], (self.labels[lo:hi] == self.labels[lo]).all()

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype("<i4") if k == "x" else v for k, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in z.files:
                setattr(tree, k, z[k].astype(float) if k == "x" else z[k])
        return tree

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each q with rows of each node, with room for rounding."""
        mid, size = q @ self.centre.T, np.sqrt((q * q).sum(1))
        room = np.outer(size, self.radius) + 1e-9 * np.outer(size, self.radius + np.sqrt((self.centre**2).sum(1))) + 1e-6
        return mid - room, mid + room


class Best:
    """For each (anchor, window) the k best rows by score, then id."""

    def __init__(self, n: int, windows: int, k: int):
        self.score = np.full((n, windows, k), NONE)
        self.id = np.full((n, windows, k), ALL)

    def add(self, at: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of anchors `at` (rows) with ids (columns) for window w; NONE does not count."""
        k = self.score.shape[2]
        new = (score >= self.score[at, w, -1:]).any(1) & (score > NONE).any(1)
        if not new.any():
            return
        at, score = at[new], score[new]
        every = np.concatenate([self.score[at, w], score], 1)
        names = np.concatenate([self.id[at, w], np.broadcast_to(ids, score.shape)], 1)
        by_id = np.argsort(names, 1, kind="stable")
        every, names = np.take_along_axis(every, by_id, 1), np.take_along_axis(names, by_id, 1)
        best = np.argsort(~every, 1, kind="stable")[:, :k]  # decreasing; ~ does not overflow
        self.score[at, w], self.id[at, w] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)


def search(tree: BallTree, q: np.ndarray, qid: np.ndarray, qlabel: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[Best, int]:
    """The k best rows of the same or other labels for each window low..high (anchors x windows); and the pairs evaluated."""
    least, most = tree.bounds(q)
    best, seen = Best(len(q), low.shape[1], k), 0

    def wanted(nodes) -> np.ndarray:
        """Anchors x nodes: whether a window of the anchor may still get a row from the node."""
        out = np.zeros((len(q), len(nodes)), bool)
        for w in range(low.shape[1]):
            floor = np.maximum(low[:, w], best.score[:, w, -1])[:, None]
            out |= (most[:, nodes] >= floor) & (least[:, nodes] <= high[:, w : w + 1]) & (low[:, w : w + 1] <= high[:, w : w + 1])
        match = qlabel[:, None] == tree.label[nodes]
        return out & (match | ~tree.only[nodes] if same else ~match | ~tree.only[nodes])

    def evaluate(leaf: int, at: np.ndarray) -> None:
        nonlocal seen
        lo, hi = tree.span[leaf]
        seen += len(at) * (hi - lo)
        s = vectors.exact(q[at], tree.x[lo:hi])
        match = qlabel[at][:, None] == tree.labels[lo:hi]
        s[(match != same) | (qid[at][:, None] == tree.ids[lo:hi])] = NONE
        for w in range(low.shape[1]):
            best.add(at, w, np.where((s >= low[at, w : w + 1]) & (s <= high[at, w : w + 1]), s, NONE), tree.ids[lo:hi])

    alive = wanted(np.arange(len(tree.parent)))
    for n in range(1, len(tree.parent)):  # a child of what is left out is left out
        alive[:, n] &= alive[:, tree.parent[n]]
    alive = alive[:, tree.leaves]
    # the leaves that may hold the most for an anchor first
    promise = np.where(alive, np.minimum(most[:, tree.leaves], high.max(1, initial=NONE)[:, None]), -np.inf)
    for first in np.argsort(-promise, 1, kind="stable")[:, :FIRST].T:
        for leaf in np.unique(first):
            at = np.flatnonzero((first == leaf) & alive[:, leaf])
            if len(at):
                evaluate(tree.leaves[leaf], at)
                alive[at, leaf] = False
    for leaf in np.argsort(-promise.max(0, initial=-np.inf), kind="stable"):
        at = np.flatnonzero(alive[:, leaf] & wanted(tree.leaves[leaf : leaf + 1])[:, 0])
        if len(at):
            evaluate(tree.leaves[leaf], at)
    return best, seen


_BEST = "anchor_id long, akey long, window int, vec_id long, score long"


def _searched(trees: pd.DataFrame, anchors: pd.DataFrame, dims: int, same: bool, k: int) -> pd.DataFrame:
    out = [pd.DataFrame({c: [] for c in ("anchor_id", "akey", "window", "vec_id", "score")}).astype("int64")]
    for data in trees["tree"]:
        tree = BallTree.unpacked(data)
        for s in range(0, len(anchors), BATCH):
            f = anchors.iloc[s : s + BATCH]
            width = max(map(len, f["low"]), default=0)
            low, high = np.full((len(f), width), ALL), np.full((len(f), width), NONE)
            for i, (a, b) in enumerate(zip(f["low"], f["high"], strict=True)):
                low[i, : len(a)], high[i, : len(b)] = a, b
            ids, keys = f["vec_id"].to_numpy(), f["akey"].to_numpy()
            best, _ = search(tree, vectors.unpacked(f["v"], dims), ids, f["label"].to_numpy(), low, high, same, k)
            i, w, n = np.nonzero(best.score > NONE)
            out.append(pd.DataFrame({"anchor_id": ids[i], "akey": keys[i], "window": w, "vec_id": best.id[i, w, n], "score": best.score[i, w, n]}))
    return pd.concat(out, ignore_index=True)


def mine(embeddings: DataFrame, label=None, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows whose vec_id is divisible by `every`.

    label: a column in place of the table's own; window: the negatives' least and most score in per cent of the positive's.
    """
    label = F.col("label") if label is None else label
    rows = embeddings.select("vec_id", label.cast("long").alias("label"), "embedding").where("label is not null")
    rows = common.stored(vectors.integers(rows, scale, "label"), "negatives-rows")
    buckets = max(1, -(-rows.count() // tile))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("dims", "label"), F.lit(buckets)).cast("int"))
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    sizes = common.stored(rows.groupBy("dims", "bucket").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("na")), "negatives-sizes")
    sizes = sizes.select("dims", "bucket", vectors.parts(F.col("n"), tile).alias("parts"), vectors.parts(F.col("na"), tile).alias("deals"))
    rows = rows.join(sizes, ["dims", "bucket"])

    def built(key, f: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(vectors.unpacked(f["v"], int(key[0])), f["vec_id"].to_numpy(), f["label"].to_numpy())
        return pd.DataFrame({"dims": [key[0]], "bucket": [key[1]], "part": [key[2]], "only": [bool(tree.only[0])], "one": [int(tree.label[0])], "tree": [tree.packed()]})

    block = ["dims", "bucket", "part"]
    trees = rows.withColumn("part", vectors.dealt(F.col("parts"))).groupBy(*block).applyInPandas(built, "dims int, bucket int, part int, only boolean, one long, tree binary")
    trees = common.stored(trees, "negatives-trees")
    anchors = rows.where(is_anchor).withColumn("akey", F.xxhash64("v", "label")).dropDuplicates(["vec_id", "dims", "akey"])
    anchors = anchors.select("vec_id", "akey", "label", "dims", "v", F.col("bucket").alias("home"), F.pmod(F.xxhash64("vec_id", "akey"), "deals").cast("int").alias("deal"))

    def met(anchors: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
        """anchors (with low, high and blocks' keys) against the trees that they name."""
        pair = [*block, "home", "deal"]
        anchors = anchors.select(*[F.col(c).alias(c) for c in (*pair, "vec_id", "akey", "label", "v", "low", "high")])
        blocks = blocks.join(anchors.select(*pair).distinct(), block).select(*[F.col(c).alias(c) for c in (*pair, "tree")])

        def run(key, t: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
            return _searched(t, a, int(key[0]), same, k)

        return blocks.groupBy(*pair).cogroup(anchors.groupBy(*pair)).applyInPandas(run, _BEST)

    best = lambda found, k: found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "akey", "window").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    near = anchors.join(trees.drop("tree").withColumnRenamed("bucket", "home"), ["dims", "home"]).where("not only or one = label")
    whole = [F.array(F.lit(x)).alias(c) for c, x in (("low", int(NONE) + 1), ("high", int(ALL)))]
    near = near.select("dims", F.col("home").alias("bucket"), "part", "home", "deal", "vec_id", "akey", "label", "v", *whole)
    found = best(met(near, trees, True, positives), positives)
    known = found.groupBy("anchor_id", "akey").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    share = lambda per_cent, p: p["score"].cast("decimal(20,0)") * F.lit(per_cent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    asked = anchors.join(known.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "akey"])
    edges = {"low": F.transform("positives", lambda p: F.ceil(share(window[0], p)).cast("long")), "high": F.transform("positives", lambda p: F.floor(share(window[1], p)).cast("long"))}
    asked = common.stored(asked.withColumns(edges), "negatives-asked")
    # all blocks are asked for: groups of anchors by number alone, as few as a tile's size allows
    deals = max(1, -(-asked.count() // tile))
    sent = asked.drop("home").withColumns({"home": F.lit(0), "deal": F.pmod(F.xxhash64("vec_id", "akey"), F.lit(deals)).cast("int")})
    sent = sent.join(trees.drop("tree"), "dims").where("not only or one <> label")
    hard = best(met(sent, trees, False, negatives), negatives)
    names = asked.select(F.col("vec_id").alias("anchor_id"), "akey", "positives")
    out = hard.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(names, ["anchor_id", "akey"])
    positive = F.get("positives", F.col("window"))
    return out.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings"), label)


ORACLE = """
with g as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, c.vec_id, a.label = c.label same, list_inner_product(a.v, c.v)::bigint score from g a join g c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int rank, vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
