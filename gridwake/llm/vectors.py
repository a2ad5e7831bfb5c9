"""Integer vectors for exact scores, and how they are dealt to tasks.

A score of a query set against all rows is formed in tiles: a block of at most some TILE rows meets a
block of queries in one task. Blocks that bounds rule out are never sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.llm import common

#: Rows and queries of a tile, about.
TILE = 4096


def _integers(v, scale: int) -> bytes | None:
    if v is None:
        return None
    try:
        x = np.asarray(v, np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    most = np.abs(x).max(initial=0)
    return x.astype("<i4").tobytes() if most < 2.0**31 and most * most * len(x) < 2.0**63 else None


def integers(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """vec_id, the columns `keep`, dims, v (floor(scale * x) as little-endian int32) and salt, of the rows that take part.

    Left out: rows without vec_id, vectors that are null or hold null or non-finite components, and such as could
    have scores beyond the range of long (len(v) * max(v)**2 of 2**63 or more, or components of 2**31 or more).
    salt tells rows of one vec_id apart when they are dealt.
    """
    kinds = dict(vectors.dtypes)

    @common.lean
    def run(frames):
        for f in frames:
            v = [_integers(x, scale) for x in f["embedding"]]
            dims = [-1 if x is None else len(x) // 4 for x in v]
            out = f[["vec_id", *keep]].assign(dims=dims, v=v, salt=np.arange(len(f)))
            yield out[out["dims"] >= 0]

    schema = ", ".join(["vec_id long", *(f"{k} {kinds[k]}" for k in keep), "dims int, v binary, salt int"])
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), *keep, "embedding")
    return rows.mapInPandas(run, schema)


def unpacked(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dims).astype(np.float64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, both of whole numbers; in doubles where these hold every sum."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def parts(n, tile: int):
    """How many blocks n rows are cut into (a column)."""
    return F.greatest(F.ceil(n / F.lit(tile)), F.lit(1)).cast("int")


def dealt(n) -> F.Column:
    """The block of 0..n-1 that a row goes to."""
    return F.pmod(F.xxhash64("vec_id", "salt"), n).cast("int")
