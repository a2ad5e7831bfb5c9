"""N-gram Jaccard join with signature trees.

A document is its set of 5-word shingles. Two link if 100 * |intersection| >= 75 * |union|. Steps:

1. Equal sets form a class; the class's smallest document stands for it.
2. Quick links, in rounds: classes of a min-hash bucket are verified against one class of it taken by
   hash, another for each bucket and round, if half of their min-hashes agree and they are in
   different components so far. Stars like these join the bulk of large groups of copies.
3. The rest is complete. A class keeps its kept() shingles of least hash; these hold the prefix of
   n - ceil(0.75 n) + 1 shingles of which two linked sets share one under any order. As the hash order
   makes them a random sample, two linked sets also share `fewest` of them; that bound fails with a
   chance below 1e-16 a pair, as the 64-bit hashes themselves do. Classes with fewer shingles that
   other components have drop out. What is left is searched by signature trees: nodes hold the OR of
   their classes' shingle bitmaps and their range of sizes, and a traversal of node pairs leaves out
   those whose largest possible overlap is too small, whose sizes cannot link, or that lie within one
   component. Pairs that reach the leaves are compared in place, and none whose components a tile has
   joined already, so that a tile writes no pairs but at most one link for each component it joins.
   - Components of more than LARGE classes are each cut into tiles once. Classes of smaller components
     that share `fewest` shingles with one of them are sent there.
   - The others meet in buckets by shingle, each class in the buckets of its first shingles in an
     order that puts buckets first that are small for the number of shingles they serve.
4. Leaves hold hashes cut to 20 bits more than the size of their set, which can only overstate an
   overlap. Links are proved on the whole hashes; where one fails, the components that were joined
   through it are searched again with whole hashes.

Only links within a component found before are left unproved, as they change no component.

Defined results: null and empty texts have no shingle and link with nothing; a text of fewer than
five words is one shingle; very long texts are hashed whole; equal or repeated rows link; rows of one
doc_id are one vertex; rows without doc_id link with nothing; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.llm import common

WORDS = 5
MINS = 6
#: Quick links need so many equal min-hashes, and are sought in so many rounds.
AGREE, ROUNDS = 3, 2
#: Classes, and shingles, of one side of a tile on average; classes from which a component is searched as a whole.
TILE, TILE_SHINGLES = 1024, 500_000
LARGE = 64
#: Large components up to which their list is broadcast, 24 bytes each.
BROADCAST = 200_000
FANOUT = 8
LEAST_BITS, MOST_BITS = 256, 1 << 13
#: Shingles of least hash that are kept of each document at least.
PREFIX = 128

_U = np.uint64
_C = np.random.default_rng(99).integers(1, 2**62, (WORDS + 1, WORDS), dtype=np.uint64) * _U(2) + _U(1)
_M = np.random.default_rng(98).integers(1, 2**62, MINS, dtype=np.uint64) * _U(2) + _U(1)
_FLAGS = 22


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and the bounds of each text's part."""
    w = common.Words(texts)
    n = np.diff(w.first[: len(texts) + 1])
    h = w.hash
    full = np.maximum(n - WORDS + 1, 0)
    count = np.where(n == 0, 0, np.maximum(full, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(texts)), count)
    at = w.first[:-1][text] + np.arange(bounds[-1]) - bounds[text]
    out = np.zeros(bounds[-1], np.uint64)
    size = np.minimum(n, WORDS)[text]
    for k in range(WORDS):
        has = size > k
        out[has] += h[at[has] + k] * _C[size[has], k]
    out = common.mix(out)
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(texts)))])


def links(overlap, a, b):
    """100 * overlap >= 75 * union of sets of sizes a and b."""
    return 100 * overlap >= 75 * (a + b - overlap)


def kept(n):
    """How many shingles of least hash are kept of a set of n: PREFIX, and the whole prefix of larger sets."""
    return np.minimum(n, np.maximum(PREFIX, n - np.ceil(0.75 * n) + 1))


def fewest(n: np.ndarray) -> np.ndarray:
    """How many kept shingles two linked sets share at least, for a set of n: three quarters less what a sample
    without replacement may miss (Serfling 1974) at 1e-16, over all sizes that can link."""
    n = np.asarray(n, float)
    miss = 0.0
    for m in (n, np.ceil(n / 0.75)):
        p = kept(m)
        miss = np.maximum(miss, np.sqrt(18.5 * p * (1 - (p - 1) / np.maximum(m, 1)).clip(0)))
        # a whole set is no sample
        miss = np.where(p >= m, np.maximum(miss * (m > n), 0), miss)
    return np.maximum(1, np.ceil(0.75 * kept(n) - miss)).astype(int)


def bits_of(n: int) -> int:
    return max(24, n.bit_length() + 19)


def packed(h: np.ndarray, wide: bool = False) -> bytes:
    """A sorted set's upper bits as gaps of three bytes; whole hashes if wide, or if a gap does not fit."""
    if not wide:
        v = h >> _U(64 - bits_of(len(h)))
        gaps = np.diff(v, prepend=_U(0))
        if (gaps < 1 << 24).all():
            return gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return h.tobytes()


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """The values of a packed set, and their bits."""
    if len(data) == 8 * n:
        return np.frombuffer(data, np.uint64), 64
    gaps = np.zeros((n, 4), np.uint8)
    gaps[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return np.cumsum(gaps.view("<u4")[:, 0], dtype=np.uint64), bits_of(n)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 (of the set), mins, prefix for each row; rows without shingles have n = 0."""

    @common.lean
    def run(frames):
        for f in frames:
            texts, ids = common.encoded(f["text"]), f["doc_id"].to_numpy()
            for lo, hi in common.chunks(texts):
                h, bounds = shingles(texts[lo:hi])
                n = np.diff(bounds)
                some = n > 0
                sums, mins = [], []
                cuts = bounds[:-1][some]
                for salt in (0x51, 0xA7C15):
                    part = np.zeros(hi - lo, np.uint64)
                    part[some] = np.add.reduceat(common.mix(h + _U(salt)), cuts) if len(cuts) else 0
                    sums.append(part.view(np.int64))
                for m in _M:
                    part = np.zeros(hi - lo, np.uint64)
                    part[some] = np.minimum.reduceat(h * m, cuts) if len(cuts) else 0
                    mins.append(part.view(np.int64))
                prefix = [h[a : a + k].view(np.int64) for a, k in zip(bounds, kept(n).astype(int), strict=False)]
                yield pd.DataFrame({"doc_id": ids[lo:hi], "n": n, "h1": sums[0], "h2": sums[1], "mins": list(np.stack(mins, 1)), "prefix": prefix})

    return common.texts(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n long, h1 long, h2 long, mins array<long>, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, tag: str) -> DataFrame:
    """(cid, set) of the classes wanted (cid, rep): sorted hashes of whole texts."""
    maybe = common.Bloom(wanted.select("rep").distinct(), "rep")

    @common.lean
    def sets(frames):
        for f in frames:
            f = f[maybe.has(f["key"].to_numpy())]
            texts = common.encoded(f["text"])
            for lo, hi in common.chunks(texts):
                h, bounds = shingles(texts[lo:hi])
                each = [h[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                cid = np.array([common.mix(x + _U(0x51)).sum(dtype=np.uint64) for x in each], np.uint64)
                yield pd.DataFrame({"cid": cid.view(np.int64), "set": [x.tobytes() for x in each]})

    found = common.texts(docs.where("doc_id is not null"), "text", maybe.key("doc_id").alias("key")).mapInPandas(sets, "cid long, set binary")
    found = found.join(wanted.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.first("set").alias("set"))
    return common.stored(found, f"{tag}-sets")


def proved(sets: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """The pairs (x, y, a, b) of classes x and y, with documents a and b, that link by their whole sets."""
    both = pairs.join(sets.select(F.col("cid").alias("x"), F.col("set").alias("s")), "x").join(sets.select(F.col("cid").alias("y"), F.col("set").alias("t")), "y")

    @common.lean
    def test(frames):
        for f in frames:
            ok = []
            for s, t in zip(f["s"], f["t"], strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                every = np.concatenate([s, t])
                every.sort()
                ok.append(bool(len(s) and len(t) and links(np.count_nonzero(every[1:] == every[:-1]), len(s), len(t))))
            yield f[["x", "y", "a", "b"]][ok]

    return common.stored(common.texts(both, "x", "y", "a", "b", "s", "t").mapInPandas(test, "x long, y long, a long, b long"), f"{tag}-links")


def verified(docs: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """The pairs (x, y, a, b) that link, from the documents' texts."""
    pairs = common.stored(pairs.distinct(), f"{tag}-pairs")
    ends = [pairs.select(F.col(c).alias("cid"), F.col(d).alias("rep")) for c, d in (("x", "a"), ("y", "b"))]
    sets = sets_of(docs, ends[0].unionByName(ends[1]).distinct(), tag)
    out = proved(sets, pairs, tag)
    common.discard(pairs, sets)
    return out


class Tree:
    """Classes sorted by size, the most frequent component last; level 0 holds their bitmaps, each node above the OR of FANOUT."""

    def __init__(self, ids, reps, comps, sizes, sets, width: int):
        of, count = np.unique(comps, return_counts=True)
        order = np.lexsort((ids, sizes, comps == of[count.argmax()]))
        self.ids, self.reps, self.n, self.comps = ids[order], reps[order], sizes[order], comps[order]
        self.sets = [sets[k] for k in order]
        b = np.zeros((len(ids), width), np.uint8)
        for i, (v, bits) in enumerate(self.sets):
            b[i, (v >> _U(bits - width.bit_length() + 1)).astype(np.int64)] = 1
        excess = self.n - b.sum(1, dtype=np.int64)
        b = np.packbits(b, axis=1).view(np.uint64)
        self.levels = [(b, self.n, self.n, excess, self.comps, self.comps)]
        while len(self.levels[-1][0]) > FANOUT:
            b, lo, hi, ex, c0, c1 = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut)))

    def __len__(self):
        return len(self.ids)


def possible(x, y, i, j) -> np.ndarray:
    """Which node pairs (i of level x, j of level y) may hold a link between components."""
    (bx, lx, hx, ex, cx, dx), (by, ly, hy, ey, cy, dy) = x, y
    ok = (4 * hx[i] >= 3 * ly[j]) & (4 * hy[j] >= 3 * lx[i]) & ~((cx[i] == dx[i]) & (cy[j] == dy[j]) & (cx[i] == cy[j]))
    k = np.flatnonzero(ok)
    for at in range(0, len(k), 4096):
        p, q = i[k[at : at + 4096]], j[k[at : at + 4096]]
        most = np.bitwise_count(bx[p] & by[q]).sum(1, dtype=np.int64) + np.minimum(ex[p], ey[q])
        ok[k[at : at + 4096]] = 7 * np.minimum(most, np.minimum(hx[p], hy[q])) >= 3 * (lx[p] + ly[q])
    return ok


def traverse(x: Tree, y: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of x and y (of x alone without y) that may link, by pairs."""
    alone = y is None
    y = x if alone else y
    a, b = len(x.levels) - 1, len(y.levels) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(x.levels[a][0])), np.arange(len(y.levels[b][0])), indexing="ij"))
    while True:
        keep = i <= j if alone else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        ok = possible(x.levels[a], y.levels[b], i, j)
        i, j = i[ok], j[ok]
        if a == 0 and b == 0:
            keep = i < j if alone else np.ones(len(i), bool)
            return i[keep], j[keep]
        step = np.arange(FANOUT)
        if a and a >= b or not b:
            a -= 1
            i, j = (i[:, None] * FANOUT + step).ravel(), np.repeat(j, FANOUT)
            i, j = i[i < len(x.levels[a][0])], j[i < len(x.levels[a][0])]
            if not alone:
                continue
        b = a if alone else b - 1
        i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + step).ravel()
        i, j = i[j < len(y.levels[b][0])], j[j < len(y.levels[b][0])]


def forest(x: Tree, y: Tree, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the leaves i and j that link: enough to join all components that links between them join."""
    if not len(i):
        return []
    names, lab = np.unique(np.concatenate([x.comps, y.comps]), return_inverse=True)
    of_x, of_y = lab[: len(x)], lab[len(x) :]
    root = np.arange(len(names))
    flags = np.zeros(1 << _FLAGS, bool)
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    out = []
    for lo, hi in zip(cut, [*cut[1:], len(i)], strict=True):
        p = i[lo]
        v, bits = x.sets[p]
        mark = v >> _U(bits - _FLAGS)
        flags[mark] = True
        for at in range(lo, hi, 512):
            q = j[at : min(at + 512, hi)]
            q = q[root[of_y[q]] != root[of_x[p]]]
            if not len(q):
                continue
            size = y.n[q]
            hits = flags[np.concatenate([y.sets[k][0] >> _U(y.sets[k][1] - _FLAGS) for k in q])]
            most = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
            for k in q[links(most, x.n[p], size)]:
                r, s = root[of_x[p]], root[of_y[k]]
                if r == s:
                    continue
                w, depth = y.sets[k]
                least = min(bits, depth)
                a, b = v >> _U(bits - least), w >> _U(depth - least)
                found = np.searchsorted(b, a)
                if links(int(np.count_nonzero(b[np.minimum(found, len(b) - 1)] == a)), len(a), len(b)):
                    out.append((p, k))
                    root[root == s] = r
        flags[mark] = False
    return out


_ROW = ("k", "i", "j", "side", "cid", "rep", "comp", "n")


def searched(rows: DataFrame) -> DataFrame:
    """(x, y, a, b, c, d): links that join components c and d in each tile of rows (k, i, j, side, cid, rep, comp, n, set).

    A tile compares its side 0 with its side 1, or side 0 with itself if it has no side 1 and i = j.
    """

    def search(f: dict):
        trees = []
        sizes = f["n"]
        if len(sizes) < 2 or f["comp"].min() == f["comp"].max():
            return None
        width = min(max(LEAST_BITS, 1 << int(8 * sizes.max() - 1).bit_length()), MOST_BITS)
        for side in (0, 1):
            at = np.flatnonzero(f["side"] == side)
            at = at[np.unique(f["cid"][at], return_index=True)[1]]
            if len(at):
                trees.append(Tree(f["cid"][at], f["rep"][at], f["comp"][at], sizes[at], [unpacked(f["set"][k], int(sizes[k])) for k in at], width))
        x, y = trees[0], trees[-1]
        if x is y and (f["i"][0] != f["j"][0] or len(x) < 2):
            return None
        found = forest(x, y, *traverse(x, None if x is y else y))
        if not found:
            return None
        p, q = np.array(found).T
        return pd.DataFrame({"x": x.ids[p], "y": y.ids[q], "a": x.reps[p], "b": y.reps[q], "c": x.comps[p], "d": y.comps[q]})

    @common.lean
    def run(frames):
        held: dict | None = None
        for frame in frames:
            f = {c: frame[c].to_numpy() for c in (*_ROW, "set")}
            if held is not None:
                f = {c: np.concatenate([held[c], f[c]]) for c in f}
            change = np.zeros(len(f["k"]), bool)
            for c in ("k", "i", "j"):
                change[1:] |= f[c][1:] != f[c][:-1]
            cuts = [0, *np.flatnonzero(change)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if (out := search({c: x[lo:hi] for c, x in f.items()})) is not None:
                    yield out
            held = {c: x[cuts[-1] :] for c, x in f.items()}  # the last tile may go on
        if held is not None and len(held["k"]) and (out := search(held)) is not None:
            yield out

    dealt = rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    found = common.texts(dealt, *_ROW, "set").mapInPandas(run, "x long, y long, a long, b long, c long, d long")
    two = [F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")]
    return found.groupBy(*two).agg(F.min(F.struct("x", "y", "a", "b")).alias("l")).select("l.*", "c", "d")


def parts(count: str = "size", shingles: str = "total"):
    return F.greatest(F.ceil(F.col(count) / TILE), F.ceil(F.col(shingles) / TILE_SHINGLES), F.lit(1)).cast("int")


def mixed_rows(known: DataFrame, equal: DataFrame, so_far: DataFrame) -> DataFrame:
    """(token, cid, rep, n, need, comp): kept shingles that classes of several components have, of classes that have enough."""
    twice = common.stored(known.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token"), "jaccard-twice")
    maybe = common.Bloom(twice, "token", hashed=True)

    @common.lean
    def enough(frames):
        for f in frames:
            size = f["prefix"].map(len).to_numpy()
            every = np.concatenate([*f["prefix"], np.zeros(0, np.int64)]).astype(np.int64)
            hit = maybe.has(every)
            of = np.repeat(np.arange(len(f)), size)
            need = fewest(f["n"].to_numpy())
            use = hit & (np.bincount(of[hit], minlength=len(f)) >= need)[of]
            own = {c: f[c].to_numpy()[of[use]] for c in ("cid", "rep", "n")}
            yield pd.DataFrame({"token": every[use], **own, "need": need[of[use]]})

    one = common.texts(known, F.col("h1").alias("cid"), F.col("doc_id").alias("rep"), "n", "prefix").mapInPandas(enough, "token long, cid long, rep long, n long, need int")
    one = one.join(equal.select(F.col("a").alias("rep"), F.col("h1").alias("cid")), ["rep", "cid"], "left_anti")
    rows = every = common.stored(one.join(so_far.withColumnRenamed("id", "rep"), "rep", "left").select("token", "cid", "rep", "n", "need", F.coalesce("component", "rep").alias("comp")).distinct(), "jaccard-rows")
    out = common.stored(several(rows), "jaccard-mixed")
    common.discard(twice, every)
    return out


def several(rows: DataFrame) -> DataFrame:
    """The rows of shingles that several components have, of classes that have `need` of these."""
    mixed = rows.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("token")
    rows = rows.join(mixed, "token").withColumn("of", F.count("*").over(Window.partitionBy("cid")))
    return rows.where("of >= need")


def large_tiles(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Tiles of the large components (rows with size) and the classes of smaller ones that may link with them."""
    tokens = rows.where("size is not null").select("token", F.col("comp").alias("to"), F.col("size").alias("of_size")).distinct()
    smaller = (F.col("comp") != F.col("to")) & (F.struct(F.coalesce("size", F.lit(0)), "comp") < F.struct("of_size", "to"))
    seek = rows.withColumnRenamed("token", "t").join(tokens, (F.col("t") == F.col("token")) & smaller)
    seek = seek.groupBy("cid", "rep", "comp", "n", "need", "to").count().where("count >= need").select("cid", "rep", "comp", "n", "to")
    seek = common.stored(seek, "jaccard-seek")
    cut = seek.groupBy("to").agg(F.count("*").alias("s"), F.sum("n").alias("sn")).join(large.withColumnRenamed("comp", "to"), "to")
    cut = cut.select("to", parts().alias("p"), parts("s", "sn").alias("q"))
    cut = F.broadcast(cut) if large.count() <= BROADCAST else cut
    part = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    own = rows.where("size is not null").select("cid", "rep", "comp", "n", F.col("comp").alias("to")).distinct().join(cut, "to")
    own = own.select(F.col("to").alias("k"), part("p").alias("i"), F.explode(F.expr("sequence(0, q - 1)")).alias("j"), F.lit(0).alias("side"), "cid", "rep", "comp", "n")
    come = seek.join(cut, "to").select(F.col("to").alias("k"), F.explode(F.expr("sequence(0, p - 1)")).alias("i"), part("q").alias("j"), F.lit(1).alias("side"), "cid", "rep", "comp", "n")
    return own.unionByName(come)


def bucket_tiles(rows: DataFrame) -> DataFrame:
    """Tiles of the buckets by shingle of the rows."""
    by_token = rows.groupBy("token").agg(F.bit_xor(F.xxhash64("cid")).alias("set"), F.count("*").alias("size"))
    serves = by_token.groupBy("set", "size").agg(F.min("token").alias("bucket"), F.count("*").alias("m"))
    order = by_token.join(serves, ["set", "size"]).select("token", "bucket", (F.col("size") / F.col("m")).alias("cost"))
    rows = rows.join(order, "token")
    # two linked classes share `need` of these shingles, so one among all but the last need - 1 of each
    first = Window.partitionBy("cid").orderBy("cost", "bucket", "token")
    rows = rows.withColumn("at", F.row_number().over(first)).where("at <= of - need + 1").select("bucket", "cid", "rep", "comp", "n").distinct()
    rows = common.stored(rows, "jaccard-buckets")
    buckets = rows.groupBy("bucket").agg(F.bit_xor(F.xxhash64("cid")).alias("set"), F.count("*").alias("size"), F.sum("n").alias("total"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    buckets = buckets.groupBy("set", "size", "total").agg(F.min("bucket").alias("bucket")).select("bucket", parts().alias("p"))
    rows = rows.join(buckets, "bucket").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("p")).cast("int"))
    tiles = F.expr("transform(sequence(0, p - 1), o -> named_struct('i', least(part, o), 'j', greatest(part, o)))")
    rows = rows.select(F.col("bucket").alias("k"), F.inline(tiles), "part", "cid", "rep", "comp", "n")
    return rows.select("k", "i", "j", (F.col("part") != F.col("i")).cast("int").alias("side"), "cid", "rep", "comp", "n")


def rest(docs: DataFrame, known: DataFrame, equal: DataFrame, so_far: DataFrame) -> DataFrame:
    """(a, b): proved links that join all components of so_far that are linked."""
    rows = mixed_rows(known, equal, so_far)
    sizes = rows.select("comp", "cid", "n").distinct().groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    large = common.stored(sizes.where(F.col("size") > LARGE), "jaccard-large")
    listed = large.select("comp", "size")
    rows = common.stored(rows.join(F.broadcast(listed) if large.count() <= BROADCAST else listed, "comp", "left"), "jaccard-sized")
    small = rows.where("size is null").select("token", "cid", "rep", "n", "need", "comp")
    dealt = common.stored(large_tiles(rows, large).unionByName(bucket_tiles(several(small))), "jaccard-tiles")
    sets = sets_of(docs, dealt.select("cid", "rep").distinct(), "jaccard-rest")

    def found(tiles: DataFrame, wide: bool) -> tuple[DataFrame, DataFrame]:
        @common.lean
        def shrink(frames):
            for f in frames:
                yield f.assign(set=[packed(np.frombuffer(s, np.uint64), wide) for s in f["set"]])

        leaves = common.texts(sets, "cid", "set").mapInPandas(shrink, "cid long, set binary")
        edges = common.stored(searched(tiles.join(leaves, "cid")), "jaccard-found")
        return edges, proved(sets, edges.select("x", "y", "a", "b"), "jaccard-rest")

    edges, good = found(dealt, False)
    if good.count() == edges.count():
        return good.select("a", "b")
    return good.select("a", "b").unionByName(found(suspects(dealt, edges, good), True)[1].select("a", "b"))


def suspects(tiles: DataFrame, edges: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of tiles whose components were joined, perhaps through others, by an edge that is not good."""
    claimed = common.stored(common.components(edges.select(F.col("c").alias("a"), F.col("d").alias("b")), "jaccard-claimed"), "jaccard-claimed")
    failed = edges.join(good.select("x", "y"), ["x", "y"], "left_anti").select(F.col("c").alias("id")).distinct()
    groups = claimed.join(failed, "id").select("component").distinct()
    return tiles.join(claimed.join(groups, "component").select(F.col("id").alias("comp")), "comp")


def quick_pairs(classes: DataFrame, so_far: DataFrame | None, k: int) -> DataFrame:
    """(x, y, a, b): classes and the one taken from a min-hash bucket of theirs."""
    comp = F.col("rep") if so_far is None else F.coalesce("component", "rep")
    rows = classes if so_far is None else classes.join(so_far, F.col("rep") == F.col("id"), "left")
    each = rows.select("rep", F.col("h1").alias("cid"), "n", "mins", comp.alias("comp")).select("*", F.posexplode("mins").alias("k", "m"))
    taken = F.min(F.struct(F.xxhash64("cid", "k", F.lit(k)).alias("h"), "cid", "rep", "n", "mins", "comp")).alias("c")
    centre = each.groupBy("k", "m").agg(taken, F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("k", "m", "c")
    near = each.join(centre, ["k", "m"]).where("comp <> c.comp and 4 * n >= 3 * c.n and 4 * c.n >= 3 * n")
    agree = sum((F.col("mins")[i] == F.col("c.mins")[i]).cast("int") for i in range(MINS))
    return near.where(agree >= AGREE).select(F.col("cid").alias("x"), F.col("c.cid").alias("y"), F.col("rep").alias("a"), F.col("c.rep").alias("b"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    sketch = common.stored(sketches(docs), "jaccard")
    known = sketch.where("n > 0 and doc_id is not null")
    classes = common.stored(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins")), "jaccard-classes")
    equal = known.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "h1")
    equal = common.stored(equal, "jaccard-equal")
    so_far = None
    for k in range(ROUNDS):
        quick = verified(docs, quick_pairs(classes, so_far, k), "jaccard-quick").select("a", "b")
        before = equal.select("a", "b") if so_far is None else so_far.select(F.col("id").alias("a"), F.col("component").alias("b"))
        so_far = common.stored(common.components(quick.unionByName(before), f"jaccard-{k}"), "jaccard-so-far")
        if quick.isEmpty():
            break
    found = rest(docs, known, equal, so_far)
    joined = common.components(found.unionByName(so_far.select(F.col("id").alias("a"), F.col("component").alias("b"))), "jaccard-all")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without all but the smallest doc_id of each component, and one row of each doc_id; null doc_ids stay.

    A document without any shingle is a component of its own, so all of these stay.
    """
    gone = common.stored(join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))

