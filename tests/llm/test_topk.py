"""Exact top-k search against a full comparison."""

import math

import numpy as np
import pytest

from gridwake.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string, cell int, part int, rank int"


def clustered(n, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, dims))


def awkward():
    x = clustered(400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(60)]  # ties
    rows += [(20, x[3].tolist()), (40, x[40].tolist()), (41, x[41].tolist())]  # another vector of a query's id; repeated rows
    rows += [(500, None), (520, [math.nan] * 24), (540, [None] * 24), (560, [math.inf] * 24), (580, [1e30] * 24), (None, x[0].tolist()), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (620, []), (621, []), (640, [0.0] * 24)]
    return rows


def brute(rows, k, every, scale):
    use = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v)]
    out = []
    for i, q in sorted({r for r in use if r[0] % every == 0}):
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in use if j != i and len(v) == len(q))
        out += [(i, n, j, -v) for n, (v, j) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "sample"), [(4096, 512), (32, 512), (100, 10), (50, 1)])
def test_equals_a_full_comparison(spark, monkeypatch, tile, sample):
    monkeypatch.setattr(topk, "SAMPLE", sample)
    rows = awkward()
    df = spark.createDataFrame([(i, v, 1, "s", 2, 3, 4) for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, topk.top_k(df, k=7, tile=tile).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, 7, 20, 64)


def test_few_rows_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none).count() == 0
    one = spark.createDataFrame([(20, [1.0, 0.5], 1, "s", 2, 3, 4)], SCHEMA)
    assert topk.top_k(one).count() == 0
    two = one.unionByName(spark.createDataFrame([(21, [0.5, -0.01], 1, "s", 2, 3, 4)], SCHEMA))
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(20, 1, 21, 64 * 32 - 32)]


def test_scores_beyond_doubles():
    a = np.array([[2.0**27 - 1, 2.0**27 - 1, 1]])
    assert vectors.exact(a, a)[0, 0] == 2 * (2**27 - 1) ** 2 + 1


@pytest.mark.parametrize("dims", [2, 24, 64])
def test_bounds_hold_and_exceed_the_single_ones(dims):
    x = np.floor(64 * clustered(300, dims, 3))
    p = topk.Pivots(x[:100])
    d = p.table(x)
    norms = (x * x).sum(1)
    a, r = p.coordinates(norms, d)
    upper = topk.bounds(a, a, r, r)
    assert (upper >= x @ x.T).all()
    single = (norms[:, None] + norms - np.abs(d[:, None] - d[None]).max(2) ** 2) / 2
    assert (upper <= single + 1e-5 * np.sqrt(np.outer(norms, norms)) + 1e-3).all()


def test_evaluation_stops_at_the_bound():
    x = np.floor(64 * clustered(4000, 64, 5))
    p = topk.Pivots(x[:300])
    a, r = p.coordinates((x * x).sum(1), p.table(x))
    upper, ids, total = topk.bounds(a[:50], a, r[:50], r), np.arange(len(x)), 0
    for i, u in enumerate(upper):
        named, got, seen = topk.in_bound_order(u, ids, lambda now, i=i: vectors.exact(x[i : i + 1], x[now])[0], -np.inf, 20)
        s = (x @ x[i]).astype(np.int64)
        best = np.lexsort((ids, -s))[:20]
        assert named.tolist() == best.tolist() and got.tolist() == s[best].tolist()
        total += seen
    assert total < 0.25 * upper.size  # the rest was ruled out by bounds alone
