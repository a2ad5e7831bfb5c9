"""What the operators of this subpackage share: tables, stored intermediates, hashing, components.

Stored intermediates go to the folder in ``spark.checkpoint.dir`` as Parquet, so that a lost
executor never takes the only copy of a result along and lineage stays short.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gridwake-"))
        base = f"file://{_own[0]}"
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridwake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables from which all that was needed has been stored in turn."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of one batch of texts on its way to Python; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def texts(docs: DataFrame, *columns) -> DataFrame:
    """docs' columns for a partition function, in batches of bounded size (a setting of the session)."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(*columns)


def release() -> None:
    """Give freed memory back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """A partition function whose worker keeps no freed memory when it has ended."""

    @functools.wraps(run)
    def wrapped(frames):
        try:
            yield from run(frames)
        finally:
            release()

    return wrapped


def crc_mod(column: str, n: int):
    """crc32 of a column as text, modulo n: the folds of labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def chunks(texts: list[bytes], most: int = 1_000_000):
    """Runs of texts of about `most` bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PRIME = _U(0x9E3779B97F4A7C15)
#: Positions are counted in a span of this size, so that a string hashes alike wherever it stands.
_SPAN = 1 << 62
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1 << 16), _PRIME, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


_INVERSE = _U(pow(int(_PRIME), -1, 2**64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        p = np.full(max(n, 1 << 16), _INVERSE, np.uint64)
        p[0] = 1
        _inverses = np.cumprod(p, dtype=np.uint64)
    return _inverses


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """h with (h[e] - h[s]) * inverses[s] the polynomial hash of codes[s:e] (mod 2**64)."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[: len(codes)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = inverses(len(h))
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER_HASH = _BYTE[_LOWER]


class Words:
    """Words of a run of texts: hash, bounds in the joined bytes, and number of the text of each.

    split="space": runs of bytes other than x20, x09-x0D; split="word": runs of ASCII letters and
    digits and of non-ASCII bytes. A-Z count as a-z in the hashes.
    """

    def __init__(self, texts: list[bytes], split: str = "space"):
        self.joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        inside = ~_SPACE[buf] if split == "space" else _WORD[buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = span_hash(prefix_hash(_LOWER_HASH[buf]), self.start, self.end)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.text_start)  # of each text's words; one more at the end


def crc_fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(id, component) with the smallest id reachable, for every id on an edge (a, b).

    Large-star and small-star steps (Kiveris et al. 2014) on tables in the shared folder; each
    step's minima are aggregated before the shuffle, so a vertex with many links costs its rows only.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-e")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        large = stored(large, f"{tag}-l")
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, f"{tag}-s")
        discard(large)
    own = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return own.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("id"), "b", F.lit(False).alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("root")))
    bad = ends.groupBy("id").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.max("root").alias("root")).where("least <> most or (root and least is not null)")
    return bad.isEmpty()


def labelled_ids(labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """At most `most` (doc_id, y) of the labelled rows that `keep` allows, those of least crc32.

    Rows that name a document twice count once, with the larger label; null labels are left out.
    """
    rows = labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label)).alias("y"))
    return rows.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


def fitted(sample: DataFrame, fit) -> bytes | None:
    """fit(pandas frame) run on one executor over a sample of bounded size; its bytes, None if no row."""

    def run(frames):
        import pandas as pd

        frames = list(frames)
        if frames and sum(map(len, frames)):
            yield pd.DataFrame({"model": [fit(pd.concat(frames, ignore_index=True))]})

    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return None if row is None or row[0] is None else bytes(row[0])


class Bloom:
    """A Bloom filter of a column of ids, of 16 bits an id but 2**27 bits at most.

    It thins rows before a join that decides exactly; beyond its size it passes more rows, never fewer.
    has() takes what key() gives for the ids to test; with hashed=True, ids that are hashes themselves.
    """

    def __init__(self, ids: DataFrame, column: str, hashed: bool = False):
        self.bits = min(1 << max(15, (16 * ids.count()).bit_length()), 1 << 27)
        x = F.col(column) if hashed else self.key(column)
        at = F.explode(F.array(x.bitwiseAND(self.bits - 1), F.shiftrightunsigned(x, 32).bitwiseAND(self.bits - 1)))
        parts = ids.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
        self.map = np.zeros(self.bits // 8, np.uint8)
        for r in parts:
            self.map[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    @staticmethod
    def key(column: str):
        return F.xxhash64(column)

    def has(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64)
        out = np.ones(len(x), bool)
        for shift in (0, 32):
            at = (x >> _U(shift)) & _U(self.bits - 1)
            out &= (self.map[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out
