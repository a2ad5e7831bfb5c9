"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns. Opaque tokens (runs of
20 or more token characters with letters and digits, outside base spans) are further candidates.
The hashes of all candidates are counted over the corpus by distinct repositories and owners: a
value that many owners have is an example that is copied around, one that a few have looks live.
Base spans are always reported; opaque ones are added where their value looks live.

Defined results: null text is empty and has no span; very long texts are scanned whole; repeated rows are
reported each; spans that start together are ordered by kind; an empty table gives no row; extra columns
are ignored. Offsets are code points, end exclusive. A null repository
or owner counts as one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

#: The patterns asked for. Hex and access need no second filter, as their matches are
#: whole runs: a run that is too short holds no longer one.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LEAST = 6
#: A value that at least so many owners, or twice as many repositories, have is an example.
OWNERS = 5
#: Tasks that the documents with one value are dealt to.
SALTS = 16

_SPAN = "struct<s:int,k:int,e:int,h:string>"


def _spans(pattern: str, kind: int, keep: str, value: str) -> Column:
    """Array of (s, k, e, h) of a pattern's matches; keep and value are SQL over m (match) and g (group)."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = 2 if KINDS[kind] == "assign" else 0
    b, m, g = "x.`0`", "x.`1`", "x.`2`"  # text before a match, match, group; the last is the text behind all
    fold = f"""aggregate(
        arrays_zip(split(t, '{p}', -1), regexp_extract_all(t, '{p}', 0), regexp_extract_all(t, '{p}', {group})),
        named_struct('p', 0, 'o', cast(array() as array<{_SPAN}>)),
        (a, x) -> named_struct('p', a.p + length({b}) + length({m}), 'o', if({m} is not null and {keep.format(m=m, g=g)},
            concat(a.o, array(named_struct('s', a.p + length({b}), 'k', {kind}, 'e', a.p + length({b}) + length({m}), 'h', sha2({value.format(m=m, g=g)}, 256)))), a.o)),
        a -> a.o)"""
    return F.when(F.col("t").rlike(pattern), F.expr(fold)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def spans(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """docs' columns `keep`, with base and opaque: arrays of (s, k, e, h) by start, then kind."""
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = t.select(
        *keep,
        F.array_sort(F.concat(_spans(ASSIGN, 0, f"length({{g}}) >= {ASSIGN_LEAST}", "{g}"), _spans(ACCESS, 1, "true", "{m}"), _spans(HEX, 2, "true", "{m}"))).alias("base"),
        _spans(OPAQUE, 3, "{m} rlike '[0-9]' and {m} rlike '[A-Za-z]'", "{m}").alias("opaque"),
    )
    return found.withColumn("opaque", F.expr("if(size(opaque) = 0, opaque, filter(opaque, o -> not exists(base, b -> b.s < o.e and o.s < b.e)))"))


def ownership(found: DataFrame) -> DataFrame:
    """h, n_repositories, n_owners of every candidate value of found (base, opaque, repository, owner)."""
    each = found.where("size(base) + size(opaque) > 0").select(
        F.explode(F.concat("base.h", "opaque.h")).alias("h"),
        F.coalesce(F.col("repository"), F.lit("")).alias("repository"),
        F.coalesce(F.col("owner"), F.lit("")).alias("owner"),
    )
    return each.groupBy("h").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def judged(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """found (each row with a `row` of its own) with `live`: the set of hashes of its candidates that look live."""
    own = ownership(found)
    live = own.where((F.col("n_owners") < owners) & (F.col("n_repositories") < 2 * owners)).select("h")
    # a value may be in all documents of one owner: its rows go to SALTS tasks
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    has = found.where("size(base) + size(opaque) > 0").select("row", salt.alias("salt"), F.explode(F.array_distinct(F.concat("base.h", "opaque.h"))).alias("h"))
    live = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_doc = has.join(live, ["h", "salt"]).groupBy("row").agg(F.collect_set("h").alias("live"))
    return found.join(by_doc, "row", "left").withColumn("live", F.coalesce("live", F.expr("cast(array() as array<string>)")))


def scan(docs: DataFrame, repository: Column, owner: Column, owners: int = OWNERS) -> DataFrame:
    """One row for each row of docs: counts, digests and spans; n_live and n_example by value."""
    keyed = docs.select("doc_id", "text", repository.alias("repository"), owner.alias("owner"))
    # stored, so that a row's number stays what it is; doc_id may be null or repeated
    found = common.stored(spans(keyed, "doc_id", "repository", "owner").withColumn("row", F.monotonically_increasing_id()), "secrets")
    out = judged(found, owners).withColumn("added", F.expr("filter(opaque, o -> array_contains(live, o.h))"))
    count = lambda k: F.expr(f"cast(size(filter(base, b -> b.k = {k})) as bigint)")
    name = "case x.k when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'opaque' end"
    text = lambda a: F.expr(f"array_join(transform({a}, x -> concat_ws(':', {name}, x.s, x.e)), ',')")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("array_sort(concat(base, added))").alias("spans"),
        F.expr("cast(size(array_distinct(filter(base, b -> array_contains(live, b.h)).h)) + size(array_distinct(added.h)) as bigint)").alias("n_live"),
        F.expr("cast(size(array_distinct(filter(base, b -> not array_contains(live, b.h)).h)) as bigint)").alias("n_example"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column, mark: str = "[secret]", owners: int = OWNERS) -> DataFrame:
    """docs with every span that looks live replaced by mark; n_chars follows. No row is dropped.

    The spans' offsets are found again on the row's own text; live values come by doc_id (null is like any other) and text.
    Rows without any candidate pass by: only texts that may change are shuffled.
    """
    may = F.coalesce(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX) | F.col("text").rlike(OPAQUE), F.lit(False))
    every, docs = docs, docs.where(may)
    digest = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", digest.alias("digest"), repository.alias("repository"), owner.alias("owner"))
    found = spans(keyed, "doc_id", "digest", "repository", "owner").where("size(base) + size(opaque) > 0")
    found = common.stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    live = judged(found, owners).where("size(live) > 0").groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(F.array_distinct(F.flatten(F.collect_set("live"))).alias("live"))
    live = common.stored(live, "live")
    packed = docs.select("doc_id", digest.alias("digest"), F.struct(*[F.col(c) for c in docs.columns]).alias("r"))
    wide = packed.join(live, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    wide = wide.select("r", "live", F.when(F.col("live").isNotNull(), F.col("r.text")).alias("text"))
    wide = spans(wide, "r", "live")
    wide = wide.withColumn("cut", F.expr("if(live is null, array(), filter(array_sort(concat(base, opaque)), x -> array_contains(live, x.h)))"))
    fold = """aggregate(cut, named_struct('p', 0, 'o', ''),
        (a, x) -> if(x.e <= a.p, a, named_struct('p', x.e, 'o', if(x.s >= a.p, concat(a.o, substring(r.text, a.p + 1, x.s - a.p), '%s'), a.o))),
        a -> concat(a.o, substring(r.text, a.p + 1)))""" % mark
    wide = wide.withColumn("clean", F.expr(f"if(size(cut) > 0, {fold}, r.text)"))
    changed = wide.select(*[(F.col("clean") if c == "text" else F.when(F.size("cut") > 0, F.length("clean").cast("long")).otherwise(F.col("r")[c]) if c == "n_chars" else F.col("r")[c]).alias(c) for c in docs.columns])
    return every.where(~may).unionByName(changed)


def sources() -> tuple[Column, Column]:
    """Repository and owner in `documents`: a source's part in one language, and the source."""
    return F.concat_ws("/", "source", "lang"), F.col("source")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), *sources())


def _sql(pattern: str, kind: int, name: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""select rid, doc_id, repository, owner, {kind} k, '{name}' name, s, s + length(m) e, g h from (
      select rid, doc_id, repository, owner, ms[i] m, gs[i] g,
        list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) s
      from (select *, unnest(range(1, len(ms) + 1)) i from (
        select rid, doc_id, repository, owner, regexp_extract_all(t, '{p}') ms, regexp_extract_all(t, '{p}', {group}) gs, regexp_split_to_array(t, '{p}') parts from d)))
    where {keep}"""


ORACLE = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, concat_ws('/', source, lang) repository, coalesce(source, '') owner from documents),
base as ({_sql(ASSIGN, 0, 'assign', 2, f'length(g) >= {ASSIGN_LEAST}')} union all {_sql(ACCESS, 1, 'access', 0, 'true')} union all {_sql(HEX, 2, 'hex', 0, 'true')}),
opaque as (select * from ({_sql(OPAQUE, 3, 'opaque', 0, "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')")}) o
  where not exists (select 1 from base b where b.rid = o.rid and b.s < o.e and o.s < b.e)),
every as (select * from base union all select * from opaque),
own as (select h, count(distinct repository) < {2 * OWNERS} and count(distinct owner) < {OWNERS} live from every group by h),
kept as (select e.*, live from every e join own using (h) where e.k < 3 or live),
agg as (select rid, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex,
  coalesce(string_agg(name || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter (k < 3), '') base,
  coalesce(string_agg(name || ':' || s::bigint || ':' || e::bigint, ',' order by s, k), '') spans,
  count(distinct case when live then h || (k = 3)::varchar end) n_live, count(distinct case when not live then h end) n_example from kept group by rid)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
  coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example from d left join agg using (rid)
"""
