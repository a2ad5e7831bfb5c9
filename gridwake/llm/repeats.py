"""Repeated passages, found with run-length indexes over candidate contexts.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Whole copies of a text
are settled first. For the rest, each LENGTH-byte window is filed under its minimizer (the K-gram of
least hash in it), so that equal windows always meet. Minimizers that occur twice are extended to
the bytes that all windows on their left, or right, share; equal contexts (the bytes of all windows
filed there) collapse to their first occurrence, and every later one is marked whole.

Keys with several contexts are left: these go to run-length indexes. The contexts, by first
occurrence, form a text whose Burrows-Wheeler transform (suffixes ordered by LENGTH bytes, then by
place) is kept as runs, with the suffix position sampled at both ends of each run. Each context is
streamed through it backwards; a match of LENGTH bytes whose earliest occurrence, the sample at the
head of its rows, is before the context's own place is marked. Keys with more than CONTEXTS contexts
are split by window: their windows' hashes are aggregated instead, the least place kept.

The result is exact but for collisions of 64-bit hashes. Defined results: null is empty; texts of
fewer than LENGTH bytes stay whole; very long ones are cut into blocks that share their windows; rows without doc_id come first; rows of one doc_id with equal
texts are one document, with unlike texts they are ordered by their hashes; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

LENGTH = 100
K = 56
HALF = (LENGTH - K) // 2
#: Contexts of a key up to which it goes to an index, and bytes of text in one index.
CONTEXTS = 4096
INDEX_BYTES = 1_000_000
#: Copies up to which their ids are broadcast to leave their texts out, 16 bytes each; beyond, they are joined by shuffle.
COPIES = 1_000_000

_U = np.uint64
_BLOCK = 4_000_000
#: Low bits of a minimizer word that hold a place in its block; _BLOCK + LENGTH must stay below their range.
_PLACE = _U(0xFFFFFF)


class Windows:
    """The runs of windows of some texts that have the same minimizer.

    text: number of the text; shift: from places in joined to places in the text; p: the minimizer's
    place, lo and hi: the first and last window's starts, all in joined.
    """

    def __init__(self, texts: list[bytes]):
        blocks = [(i, a) for i, t in enumerate(texts) for a in range(0, max(len(t) - LENGTH + 1, 1), _BLOCK)]
        parts = [texts[i][a : a + _BLOCK + LENGTH - 1] for i, a in blocks]
        self.joined = b"".join(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.concatenate([[0], np.cumsum(size)])
        buf = np.frombuffer(self.joined, np.uint8)
        self.h = common.prefix_hash(common._BYTE[buf])
        n = len(buf) - K + 1
        if len(buf) < LENGTH:
            self.p = self.lo = self.hi = self.text = self.shift = np.zeros(0, np.int64)
            return
        g = common.mix((self.h[K:] - self.h[:-K]) * common.inverses(len(self.h))[:n])
        m = (g & ~_PLACE) | (np.arange(len(buf)) - np.repeat(start[:-1], size))[:n].astype(np.uint64)
        step, reach = 1, LENGTH - K + 1
        while step < reach:
            by = min(step, reach - step)
            m = np.minimum(m[: len(m) - by], m[by:])
            step += by
        block = np.repeat(np.arange(len(parts)), np.maximum(size - LENGTH + 1, 0))
        s = np.arange(len(block)) - np.repeat(np.cumsum(np.maximum(size - LENGTH + 1, 0)) - np.maximum(size - LENGTH + 1, 0), np.maximum(size - LENGTH + 1, 0)) + start[block]
        p = (m[s] & _PLACE).astype(np.int64) + start[block]
        cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (block[1:] != block[:-1])])) if len(p) else np.zeros(0, int)
        self.p, self.lo = p[cut], s[cut]
        self.hi = s[np.concatenate([cut[1:], [len(s)]]) - 1] if len(cut) else cut
        b = block[cut]
        at = np.array(blocks, np.int64).reshape(-1, 2)
        self.text, self.shift = at[b, 0], at[b, 1] - start[b]
        self.anchor = g[self.p]

    def sides(self, keep: np.ndarray):
        """For the runs `keep`, their left and right halves: run, first and last start, key."""
        out = []
        for side in (0, 1):
            lo = self.lo[keep] if side == 0 else np.maximum(self.lo[keep], self.p[keep] - HALF + 1)
            hi = np.minimum(self.hi[keep], self.p[keep] - HALF) if side == 0 else self.hi[keep]
            ok = lo <= hi
            run, lo, hi = keep[ok], lo[ok], hi[ok]
            p = self.p[run]
            a, b = (p - HALF, p + K) if side == 0 else (p, p + LENGTH - HALF + 1)
            key = common.mix(common.span_hash(self.h, a, b) + _U(side + 1))
            out.append((run, lo, hi, key))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def context(self, run, lo, hi):
        return common.mix(common.span_hash(self.h, lo, hi + LENGTH) + (self.p[run] - lo).astype(np.uint64) * _U(0x632BE59BD9B4E019))


class RunLengthIndex:
    """The Burrows-Wheeler transform, ordered by LENGTH bytes and then place, of texts, as runs."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint64) + _U(1)
        code[self.start[1:] - 1] = 0
        self.code = code.astype(np.int64)
        n = len(code)
        packed = np.zeros(n, np.uint64)
        for k in range(6):  # six symbols of nine bits
            packed <<= _U(9)
            packed[: n - k] |= code[k:]
        rank, depth = self._ranks(packed)[0], 6
        while depth < LENGTH:
            by = min(depth, LENGTH - depth)
            pair = rank << _U(32)
            pair[: n - by] |= rank[by:] + _U(1)
            depth += by
            rank, order = self._ranks(pair)
        sorted_rank = rank[order]
        bwt = self.code[order - 1]
        self.classes = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        cut = np.flatnonzero(self.classes | np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads = bwt[cut]
        self.run_start = cut
        lengths = np.diff(np.concatenate([cut, [n]]))
        self.first, self.last = order[cut], order[cut + lengths - 1]
        # the run at which the class of each run begins
        self.class_run = np.maximum.accumulate(np.where(self.classes[cut], np.arange(len(cut)), 0))
        by_head = np.argsort(self.heads, kind="stable")
        self.head_key = self.heads[by_head] * len(cut) + by_head
        self.before = np.concatenate([[0], np.cumsum(lengths[by_head])])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.ends = row[self.start[1:] - 1]

    @staticmethod
    def _ranks(key: np.ndarray):
        order = np.argsort(key, kind="stable")
        by = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], (by[1:] != by[:-1]).astype(np.int64)])).astype(np.uint64)
        return rank, order

    def run_of(self, row: np.ndarray) -> np.ndarray:
        """The run at which the class of a row begins."""
        return self.class_run[np.searchsorted(self.run_start, row, side="right") - 1]

    def earliest(self) -> np.ndarray:
        """For each place of the texts, the earliest place of the LENGTH bytes that start there.

        All texts are streamed backwards at once; a step finds, for the symbol before, the first row of
        the present rows that it precedes, and so the rows of the longer match.
        """
        out = np.full(len(self.code), -1, np.int64)
        place = self.start[1:] - 1
        begin = self.start[:-1].copy()
        run = self.run_of(self.ends)
        while len(place):
            on = place > begin
            place, begin, run = place[on] - 1, begin[on], run[on]
            at = np.searchsorted(self.head_key, self.code[place] * len(self.run_start) + run)
            run = self.run_of(self.before[at])
            out[place] = self.first[run]
        return out


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the intervals."""
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[cut], reach[np.concatenate([cut[1:], [len(start)]]) - 1]


def _index(f: pd.DataFrame) -> pd.DataFrame:
    """Marks (doc, v, s, e) of contexts of whole keys (key, doc, v, at, c)."""
    f = f.sort_values(["key", "doc", "v", "at"]).reset_index(drop=True)
    texts = f["c"].tolist()
    index = RunLengthIndex(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = size - LENGTH + 1
    text = np.repeat(np.arange(len(texts)), windows)
    k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = index.start[text] + k
    hit = index.earliest()[place] < place
    text, k = text[hit], k[hit]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (k[1:] != k[:-1] + 1)])) if len(text) else text
    stop = np.concatenate([new[1:], [len(text)]]) - 1 if len(text) else text
    own = f.iloc[text[new]]
    return pd.DataFrame({"doc": own["doc"].to_numpy(), "v": own["v"].to_numpy(), "s": own["at"].to_numpy() + k[new], "e": own["at"].to_numpy() + k[stop] + LENGTH})


def marks(texts: DataFrame) -> DataFrame:
    """(doc, v, s, e): intervals of texts (doc, v, text) to remove."""
    kept = common.texts(texts, "doc", "v", "text")

    def scanned(frames):
        for f in frames:
            t, doc, v = common.encoded(f["text"]), f["doc"].to_numpy(), f["v"].to_numpy()
            for lo, hi in common.chunks(t, 500_000):
                yield Windows(t[lo:hi]), doc[lo:hi], v[lo:hi]

    @common.lean
    def anchors(frames):
        for w, _, _ in scanned(frames):
            if len(w.p):
                yield pd.DataFrame({"anchor": w.anchor.view(np.int64)})

    twice = kept.mapInPandas(anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")
    twice = common.stored(twice, "repeats-anchors")
    maybe = common.Bloom(twice, "anchor", hashed=True)

    def sides(w, doc, v):
        run, lo, hi, key = w.sides(np.flatnonzero(maybe.has(w.anchor.view(np.int64)))) if len(w.p) else (np.zeros(0, int),) * 4
        of, at = w.text[run], lo + w.shift[run]
        context = w.context(run, lo, hi) if len(run) else np.zeros(0, np.uint64)
        ident = common.mix(key + context * _U(31) + doc[of].astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15) + v[of].astype(np.int64).view(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + at.astype(np.uint64) * _U(0x165667B19E3779F9)) if len(run) else context
        return run, lo, hi, {"key": key.astype(np.uint64).view(np.int64), "ctx": context.view(np.int64), "doc": doc[of], "v": v[of], "at": at, "len": hi - lo + LENGTH, "id": ident.view(np.int64)}

    @common.lean
    def occurrences(frames):
        for x in scanned(frames):
            yield pd.DataFrame(sides(*x)[3])

    every = common.stored(kept.mapInPandas(occurrences, "key long, ctx long, doc long, v long, at int, len int, id long"), "repeats-places")
    firsts = common.stored(every.groupBy("key", "ctx").agg(F.min(F.struct("doc", "v", "at", "id")).alias("f"), F.count("*").alias("n")).select("key", "ctx", F.col("f.id").alias("id"), "n"), "repeats-firsts")
    again = every.join(firsts.where("n > 1").select("key", "ctx", F.col("id").alias("first")), ["key", "ctx"]).where("id <> first").select("doc", "v", F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e"))
    keys = firsts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1")
    unlike = common.stored(firsts.select("key", "id").join(keys, "key"), "repeats-unlike")
    wanted = common.Bloom(unlike, "id", hashed=True)

    @common.lean
    def contexts(frames):
        for w, doc, v in scanned(frames):
            run, lo, hi, row = sides(w, doc, v)
            on = wanted.has(row["id"]) if len(run) else np.zeros(0, bool)
            f = pd.DataFrame({k: row[k][on] for k in ("id", "key", "doc", "v", "at")})
            f["c"] = [w.joined[a : b + LENGTH] for a, b in zip(lo[on], hi[on], strict=True)]
            yield f

    rows = kept.mapInPandas(contexts, "id long, key long, doc long, v long, at int, c binary").join(unlike.select("id", "contexts"), "id")
    rows = common.stored(rows, "repeats-contexts")

    @common.lean
    def indexed(frames):
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            # rows come by key: what is behind the last change of key waits for more
            f = f.reset_index(drop=True)
            while len(f):
                total = np.cumsum(f["c"].map(len).to_numpy()) + size
                change = np.flatnonzero(f["key"].to_numpy() != np.concatenate([[held[-1]["key"].iloc[-1] if held else f["key"].iloc[0]], f["key"].to_numpy()[:-1]]))
                over = change[total[change] >= INDEX_BYTES]
                cut = int(over[0]) if len(over) else len(f)
                held.append(f.iloc[:cut])
                size = int(total[cut - 1]) if cut else size
                f = f.iloc[cut:].reset_index(drop=True)
                if len(over):
                    yield _index(pd.concat(held))
                    held, size = [], 0
            held = [x for x in held if len(x)]
        if held:
            yield _index(pd.concat(held))

    few = rows.where(F.col("contexts") <= CONTEXTS).select("key", "doc", "v", "at", "c").repartition("key").sortWithinPartitions("key").mapInPandas(indexed, "doc long, v long, s int, e int")

    @common.lean
    def each_window(frames):
        for f in frames:
            for row in f.itertuples(index=False):
                h = common.prefix_hash(common._BYTE[np.frombuffer(row.c, np.uint8)])
                k = np.arange(len(row.c) - LENGTH + 1)
                yield pd.DataFrame({"w": common.mix(common.span_hash(h, k, k + LENGTH) ^ _U(row.key % 2**64)).view(np.int64), "doc": row.doc, "v": row.v, "s": row.at + k})

    window = rows.where(F.col("contexts") > CONTEXTS).select("key", "doc", "v", "at", "c").mapInPandas(each_window, "w long, doc long, v long, s int")
    window = common.stored(window, "repeats-windows")
    first = window.groupBy("w").agg(F.min(F.struct("doc", "v", "s")).alias("f"), F.count("*").alias("n")).where("n > 1")
    many = window.join(first, "w").where(F.struct("doc", "v", "s") != F.col("f")).select("doc", "v", "s", (F.col("s") + LENGTH).alias("e"))
    return again.unionByName(few).unionByName(many)


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes, end exclusive) for each row of docs."""
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    v = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    doc = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", doc.alias("doc"), v.alias("v"), "text", F.sha2("text", 256).alias("sha"))
    heads = common.stored(rows.select("doc", "v", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "repeats-heads")
    firsts = heads.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min(F.struct("doc", "v")).alias("f"), F.count("*").alias("n")).where("n > 1")
    copies = heads.join(firsts, "sha").where(F.struct("doc", "v") != F.col("f")).select("doc", "v").distinct()
    copies = common.stored(copies, "repeats-copies")
    texts = rows.dropDuplicates(["doc", "v"]) if repeated else rows
    found = marks(texts.join(F.broadcast(copies) if copies.count() <= COPIES else copies, ["doc", "v"], "left_anti"))
    by_doc = common.stored(found.groupBy("doc", "v").agg(F.collect_list(F.struct("s", "e")).alias("m")), "repeats-marks")
    touched = common.Bloom(by_doc.select("doc").unionByName(copies.select("doc")), "doc")

    def split(frames):
        for f in frames:
            yield f.assign(on=touched.has(f.pop("key").to_numpy()))

    @common.lean
    def cut(frames):
        for f in frames:
            out = []
            for doc_id, text, copy, m in zip(f["doc_id"], common.encoded(f["text"]), f["copy"], f["m"], strict=True):
                if copy:
                    s, e = np.array([0]), np.array([len(text)])
                else:
                    x = [(r["s"], r["e"]) for r in m] if m is not None else []
                    x = np.array(x, np.int64).reshape(-1, 2)
                    s, e = merge(x[:, 0], x[:, 1])
                kept = b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)], strict=True))
                out.append((doc_id, len(text), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in zip(s, e, strict=True))))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    keyed = common.texts(rows, "doc_id", "doc", "v", "text", "sha", touched.key("doc").alias("key"))
    flagged = keyed.select("doc_id", "doc", "v", "sha", F.octet_length("text").cast("long").alias("n_bytes"), "key").mapInPandas(split, "doc_id long, doc long, v long, sha string, n_bytes long, on boolean")
    whole = flagged.where("not on").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit("").alias("spans"))

    @common.lean
    def chosen(frames):
        for f in frames:
            yield f[touched.has(f.pop("key").to_numpy())]

    some = keyed.drop("sha").select("doc_id", "doc", "v", "text", "key").mapInPandas(chosen, "doc_id long, doc long, v long, text string")
    some = some.join(by_doc, ["doc", "v"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc", "v"], "left")
    done = some.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "m").mapInPandas(cut, schema)
    return whole.unionByName(done)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.table(spark, sf_dir, "documents"))
