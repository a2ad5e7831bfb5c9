"""Filter interaction audit by a subset-zeta transform.

Each document gets a mask of the filters that it fails. Masks are counted per part, which is all that
leaves the corpus: 2**n counts a part. The zeta transform sums them over subsets, so that the survivors
of any set of filters, whatever its order, are one number; what a step of an order removes is the
difference between two neighbouring sets, and so are the labelled documents that it loses.

Defined results: null text is empty, null lang is the empty part; a document counts as good or toxic if
any row of labels says so, rows without labels or doc_id as neither; a row without doc_id repeats
nobody, and rows of one doc_id do not repeat each other (filter E asks for a smaller doc_id); repeated
rows count each; very long texts count whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

#: Fixed values of the five filters: least words, least share of distinct words and most share of capitals in per cent, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"
GAP = r"[\x20\x09-\x0D]+"
NAMES = "ABCDE"
MEASURES = ("n", "good", "toxic")


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of docs; bit k of mask is set if the row fails filter NAMES[k]."""
    t = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("words", F.array_remove(F.split("t", GAP, -1), ""))
    n = F.size("words").cast("long")
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long")
    own = (n < WORDS, 100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT * n, 100 * capitals > CAPITALS * F.length("t"), F.col("t").rlike(MARKS))
    # from here on a row has a digest in place of its text
    rows = common.stored(t.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), _mask(own).alias("mask")), "masks")
    # a copy meets the first of its text by its own doc_id, so that a large group of copies is no hot key
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    out = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, 1 << len(own)).otherwise(0)
    return out.select("part", mask.alias("mask"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("good", "toxic")])


def _mask(fails) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def counts(rows: DataFrame, n: int) -> DataFrame:
    """For each part an array of 2**n counts, by mask, of each of MEASURES."""
    by = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by = by.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("m"))
    return by.select("part", *[F.expr(f"transform(sequence(0, {2**n - 1}), k -> coalesce(m[k].{c}, 0L))").alias(c) for c in MEASURES])


def survivors(counted: DataFrame, n: int) -> DataFrame:
    """The same arrays by set of filters: at index s, the rows that fail none of the filters in s."""
    for k in range(n):  # zeta transform: sums over the subsets of each mask
        b = 1 << k
        counted = counted.select("part", *[F.expr(f"transform({c}, (x, i) -> if((i & {b}) > 0, x + {c}[i - {b}], x))").alias(c) for c in MEASURES])
    # rows that fail none of s are those whose mask lies in the complement of s: the array from behind
    return counted.select("part", *[F.reverse(c).alias(c) for c in MEASURES])


def order_steps(alive: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step in it."""
    n = len(names)
    orders = ["".join(p) for p in permutations(names)]
    bits = [1 << names.index(f) for p in orders for f in p]
    before = [sum(1 << names.index(f) for f in p[:k]) for p in orders for k in range(n)]
    # by filter: the differences over all sets that it may follow, as often as an order has that set before it
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
    shares = [" + ".join(f"{weight(s)} * (n[{s}] - n[{s | 1 << k}])" for s in range(2**n) if not s >> k & 1) for k in range(n)]
    each = alive.select("*", F.expr(f"array({', '.join(shares)})").alias("shares"), F.explode(F.sequence(F.lit(0), F.lit(len(bits) - 1))).alias("k"))
    at = lambda values, k: F.get(F.lit(values), k)
    each = each.select("*", at(bits, F.col("k")).alias("bit"), at(before, F.col("k")).alias("before"), at(orders, F.floor(F.col("k") / n).cast("int")).alias("filter_order"))
    each = each.withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    every = 2**n - 1
    return each.select(
        "part",
        "filter_order",
        (F.col("k") % n + 1).cast("int").alias("step"),
        F.get("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(every) - F.col("bit")) - F.get("n", F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.log2("bit").cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    n = len(NAMES)
    return order_steps(survivors(counts(masked(docs, labels), n), n), NAMES)


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


_LETTERS = "(select unnest(['A', 'B', 'C', 'D', 'E']) l)"
ORACLE = rf"""
with w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') words from documents),
known as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
d as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end fails
  from w left join known using (doc_id)),
g as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from d group by part, fails),
o as (select v.l || w.l || x.l || y.l || z.l filter_order from {_LETTERS} v, {_LETTERS} w, {_LETTERS} x, {_LETTERS} y, {_LETTERS} z where len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
s as (select filter_order, step, left(filter_order, step - 1) prior, substr(filter_order, step, 1) f from o, (select unnest(range(1, 6))::int step)),
r as (select part, filter_order, step, f,
    coalesce(sum(n) filter (translate(fails, prior || f, '') = fails), 0)::bigint kept,
    coalesce(sum(n) filter (contains(fails, f) and translate(fails, prior, '') = fails), 0)::bigint removed,
    coalesce(sum(n) filter (contains(fails, f) and translate(fails, prior, '') <> fails), 0)::bigint redundant,
    coalesce(sum(n) filter (fails = f), 0)::bigint unique_fails,
    coalesce(sum(good) filter (contains(fails, f) and translate(fails, prior, '') = fails), 0)::bigint good_lost,
    coalesce(sum(toxic) filter (contains(fails, f) and translate(fails, prior, '') = fails), 0)::bigint toxic_lost
  from g, s group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from r
"""
