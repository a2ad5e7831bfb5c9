"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of BLOCK dimensions. If two
are within squared distance e = 2 - 2 * cosine, then in some block they are within e times the
block's share of the dimensions. So each block is range-joined under its own budget: a block's first
coordinate is cut into strips as wide as the budget's root, a vector meets the vectors of its own
strip and of the next. Strips of more than TILE vectors are cut into tiles, each a task of bounded
size. A pair found in a block is verified at once on the whole vectors in double precision, and
counts only if no earlier block finds it as well, so that pairs are never written out: a tile
returns link counts, and a spanning forest of its links.

Equal vectors are joined once, with their number. Defined results: vectors that are null, zero, or
hold null or non-finite components, and rows without vec_id, link with nothing; vectors of unlike
length are never compared; rows of one vec_id are one vertex for components; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.llm import common

BLOCK = 16
TILE = 8192
#: Room for rounding in the blocks' budgets; pairs are verified on the whole vectors.
SLACK = 1e-9
#: And for single precision: products of unit vectors' blocks of at most 31 components are off by less than a tenth of it.
SINGLE = 1e-4


def rotation(dims: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q


def blocks(dims: int) -> list[slice]:
    n = max(1, dims // BLOCK)
    at = [round(i * dims / n) for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def budgets(dims: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (s.stop - s.start) / dims + SLACK for s in blocks(dims)]


def _usable(v, kind: str) -> bytes | None:
    if v is None or not len(v):
        return None
    try:
        x = np.asarray(v, kind)
    except (TypeError, ValueError):
        return None
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def tile_links(u: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, cosine: float, same: bool):
    """Weighted link counts of the vectors u (unit), and forest edges, for pairs of rows a x b found in this block."""
    dims = u.shape[1]
    x, parts, budget = u @ rotation(dims), blocks(dims), budgets(dims, cosine)
    count, parent = np.zeros(len(u), np.int64), np.arange(len(u))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # squared distances in the block as one product, in single precision: pairs that pass are measured again below
    mine = x[:, parts[block]]
    norm, one = (mine * mine).sum(1)[:, None], np.ones((len(u), 1))
    left, right = np.hstack([-2 * mine, norm, one]).astype(np.float32), np.hstack([mine, one, norm]).astype(np.float32)
    most, other = np.float32(budget[block] + SLACK + SINGLE), right[b].T
    edges = []
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        i, j = np.nonzero(left[rows] @ other <= most)
        i, j = rows[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 200_000):
            p, q = i[lo : lo + 200_000], j[lo : lo + 200_000]
            hit = np.einsum("ij,ij->i", u[p], u[q]) >= cosine
            p, q = p[hit], q[hit]
            within = [((x[p][:, y] - x[q][:, y]) ** 2).sum(1) <= budget[k] for k, y in enumerate(parts[: block + 1])]
            first = within.pop()
            for earlier in within:
                first &= ~earlier
            p, q = p[first], q[first]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            while (parent != parent[parent]).any():
                parent = parent[parent]
            new = parent[p] != parent[q]
            for s, t in zip(p[new].tolist(), q[new].tolist(), strict=True):
                r, z = root(s), root(t)
                if r != z:
                    parent[max(r, z)] = min(r, z)
                    edges.append((s, t))
    return count, edges


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    width = np.dtype(kind).itemsize

    @common.lean
    def usable(frames):
        for f in frames:
            v = [None if pd.isna(i) else _usable(x, kind) for i, x in zip(f["vec_id"], f["embedding"], strict=True)]
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": v})

    rows = common.stored(vectors.select("vec_id", "embedding").mapInPandas(usable, "vec_id long, v binary").withColumn("key", F.sha2("v", 256)), "vectors")
    reps = common.stored(rows.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-reps")

    @common.lean
    def strips(frames):
        for f in frames:
            out = []
            for dims, part in f.groupby(f["v"].map(len) // width):
                x = unit(np.stack([np.frombuffer(v, kind) for v in part["v"]]).astype(np.float64)) @ rotation(dims)
                for k, (s, e) in enumerate(zip(blocks(dims), budgets(dims, cosine), strict=True)):
                    cell = np.floor(x[:, s.start] / math.sqrt(e)).astype(int)
                    out.append(part.assign(dims=dims, block=k, cell=cell, home=True))
                    out.append(part.assign(dims=dims, block=k, cell=cell + 1, home=False))
            yield from out

    placed = reps.select("rep", "copies", "v").mapInPandas(strips, "rep long, copies long, v binary, dims int, block int, cell int, home boolean")
    # a unit vector's coordinate is within -1..1: a fixed number of strips for each length of vectors
    counts = placed.drop("v").groupBy("dims", "block", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    sizes = counts.withColumn("nh", F.ceil(F.col("h") / TILE).cast("int")).withColumn("ng", F.ceil(F.col("g") / TILE).cast("int")).where("nh > 0").select("dims", "block", "cell", "nh", "ng")
    dealt = placed.join(F.broadcast(sizes), ["dims", "block", "cell"])
    part = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("nh")).otherwise(F.greatest("ng", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("part", part)
    # tile (i, j) with j >= 0: home parts i <= j; with j < 0: home part i and guest part -1 - j
    tiles = F.expr("""if(home,
        concat(transform(sequence(part, nh - 1), j -> named_struct('i', part, 'j', j)),
               if(part > 0, transform(sequence(0, part - 1), i -> named_struct('i', i, 'j', part)), array()),
               if(ng > 0, transform(sequence(0, ng - 1), g -> named_struct('i', part, 'j', -1 - g)), array())),
        transform(sequence(0, nh - 1), i -> named_struct('i', i, 'j', -1 - part)))""")
    dealt = dealt.withColumn("tile", F.explode(tiles)).select("rep", "copies", "v", "dims", "block", "cell", "home", "part", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"))

    def joined(key, f: pd.DataFrame) -> pd.DataFrame:
        block, i, j = int(key[1]), int(key[3]), int(key[4])
        f = f.sort_values("rep").reset_index(drop=True)
        a = np.flatnonzero(f["home"] & (f["part"] == i))
        b = np.flatnonzero(~f["home"] if j < 0 else f["home"] & (f["part"] == j))
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        u = unit(np.stack([np.frombuffer(v, kind) for v in f["v"]]).astype(np.float64))
        count, edges = tile_links(u, f["copies"].to_numpy(), a, b, block, cosine, i == j)
        rep, hit = f["rep"].to_numpy(), np.flatnonzero(count)
        e = np.array(edges, int).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([rep[hit], rep[e[:, 0]]]), "b": np.concatenate([rep[hit], rep[e[:, 1]]]), "n": np.concatenate([count[hit], np.zeros(len(e), np.int64)])})

    found = common.stored(dealt.groupBy("dims", "block", "cell", "i", "j").applyInPandas(joined, "a long, b long, n long"), "vector-links")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    # ids that stand for several vectors: all rows of one id are one vertex
    same = rows.where("v is not null").join(reps.select("key", "rep"), "key").select("vec_id", "rep", "key")
    parts = common.components(found.where("n = 0").select("a", "b").unionByName(same.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), "vectors")
    by_key = reps.select("key", "rep", "copies").join(links, "rep", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(by_key, "key", "left").join(parts, rows["vec_id"] == parts["id"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
