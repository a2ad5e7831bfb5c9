"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. A seed is the hash of the words at the
positions that a fixed mask keeps; the others may differ. Equal seeds of a document and a benchmark
item fix an alignment, which is verified: it counts if some window of WINDOW aligned words has at
least LEAST equal ones (so up to three substitutions). The two masks hit every such window (checked
over all 286 patterns in the tests), so none is missed. An item shorter than WINDOW is one window
and needs the same share of equal words; two more masks hit all its patterns (checked in the tests).
With fewer than five words that is all of them, and the item's whole word sequence is its seed.
Documents are given the masks that some item needs.

Defined results: null or empty texts, of documents or items, match nothing; very long texts are searched
whole; repeated rows of a document are one result; of alignments that tie in equal words the first one is
given; an empty table or benchmark gives no row; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

#: Kept positions of the masks 11101 and 11011.
MASKS = ((0, 1, 2, 4), (0, 1, 3, 4))
#: With these, every pattern of an item of 5 to 12 words has a seed.
SHORT = (*MASKS, (0, 1, 2, 3), (0, 2, 3, 4))
SPAN = 5
WINDOW, LEAST = 13, 10
#: Up to so many seeds the benchmark is broadcast, some 100 bytes each; beyond, seeds are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
WORD = r"[\p{L}\p{N}]+"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks whose seeds an item of n words is found by."""
    return MASKS if n >= WINDOW else SHORT if n >= SPAN else (tuple(range(n)),)


def seeds(rows: DataFrame, at: str, *keep: str, masks=MASKS) -> DataFrame:
    """rows (with an array column w) once for each position and mask that fits there: keep, at, h."""
    least = min(mask[-1] for mask in masks) + 1
    starts = rows.where(F.size("w") >= least).select(*{*keep, "w"}, F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias(at))
    each = []
    for mask in masks:
        h = F.xxhash64(F.lit("".join(map(str, mask))), *(F.get("w", F.col(at) + k) for k in mask))
        each.append(F.struct((h if mask[-1] < least else F.when(F.col(at) + mask[-1] < F.size("w"), h)).alias("h")))
    out = starts.select(*keep, at, F.inline(F.array(*each)))
    return out.where("h is not null") if any(mask[-1] >= least for mask in masks) else out


#: For an alignment (document words w, item words iw, d the position of the item's first word): words that are
#: equal, and the most in a window.
_EQUAL = "transform(sequence(0, size(iw) - 1), j -> if(get(w, d + j) <=> iw[j], 1, 0))"
_SUM = "aggregate({0}, 0, (a, x) -> a + x)"
_BEST = f"array_max(transform(sequence(0, greatest(size(iw) - {WINDOW}, 0)), j -> {_SUM.format(f'slice(eq, j + 1, {WINDOW})')}))"
_NEED = f"cast(ceil(least(size(iw), {WINDOW}) * {LEAST} / {WINDOW}) as int)"


def verified(hits: DataFrame) -> DataFrame:
    """hits (doc_id, w, item_id, iw, d) to the pairs that hold, with their best alignment."""
    hits = hits.withColumn("eq", F.expr(_EQUAL)).withColumn("n_equal", F.expr(_SUM.format("eq")))
    hits = hits.where(f"n_equal >= {_NEED}").withColumn("n_window", F.expr(_BEST)).where(f"n_window >= {_NEED}")
    best = F.max(F.struct("n_equal", "n_window", (-F.col("d")).alias("d"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_equal", "b.n_window", (-F.col("b.d")).alias("word_start"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_equal, n_window, word_start for each contaminated pair."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", words().alias("w"))
    items = benchmark.where("item_id is not null").select("item_id", words().alias("w")).where(F.size("w") > 0).distinct()
    of = {}
    for r in items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct().collect():
        of.setdefault(masks_of(r["n"]), []).append(r["n"])
    masks = tuple(sorted({mask for group in of for mask in group})) or MASKS
    theirs = [seeds(items.where(F.least(F.size("w"), F.lit(WINDOW)).isin(n)), "q", "item_id", masks=group) for group, n in of.items()]
    theirs = reduce(DataFrame.unionByName, theirs or [seeds(items, "q", "item_id")])
    own = items.select("item_id", F.col("w").alias("iw"))
    if theirs.count() <= BROADCAST_SEEDS:
        hits = seeds(docs, "p", "doc_id", "w", masks=masks).join(F.broadcast(theirs), "h").join(F.broadcast(own), "item_id")
        return verified(hits.select("doc_id", "w", "item_id", "iw", (F.col("p") - F.col("q")).alias("d")))
    near = seeds(docs, "p", "doc_id", masks=masks).join(theirs, "h").select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("d")).distinct()
    return verified(near.join(own, "item_id").join(docs, "doc_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id matches an item."""
    found = common.stored(matches(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: All alignments by equal words, without seeds.
ORACLE = """
with dw as (select row_number() over () r, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null and doc_id is not null),
iw as (select row_number() over () s, item_id, w, len(w) n, ceil(least(len(w), 13) * 10 / 13) need from (select distinct item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark where item_id is not null and text is not null)),
d as (select r, doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from dw),
i as (select s, unnest(w) word, unnest(range(1, n + 1)) q from iw),
al as (select r, any_value(doc_id) doc_id, s, p - q d, count(*) n_equal, list(q) qs from d join i using (word) group by r, s, p - q),
sc as (select doc_id, item_id, d, n_equal, need, list_max(list_transform(range(1, greatest(n - 12, 1) + 1), lambda j: len(list_filter(qs, lambda q: q >= j and q < j + 13)))) n_window from al join iw using (s) where n_equal >= need),
ok as (select *, row_number() over (partition by doc_id, item_id order by n_equal desc, n_window desc, d) k from sc where n_window >= need)
select doc_id, item_id, n_equal::integer n_equal, n_window::integer n_window, d::integer word_start from ok where k = 1
"""
