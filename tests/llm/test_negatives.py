"""Hard negatives against a full comparison, and ball trees against all rows."""

import math

import numpy as np
import pytest

from gridwake.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, home int, deal int, tree string, rank int"


def clustered(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 4, n)
    x = rng.normal(size=(4, dims))[label] + 0.6 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None], label


def awkward():
    x, label = clustered(500)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    rows += [(2000 + i, x[7].tolist(), i % 2) for i in range(40)]  # ties, of two labels
    rows += [(50, x[3].tolist(), 2), (100, x[100].tolist(), int(label[100])), (101, x[101].tolist(), int(label[101]))]  # another vector of an anchor; repeated rows
    rows += [(600, None, 1), (650, [math.nan] * 16, 1), (700, [None] * 16, 1), (750, [-math.inf] * 16, 1), (800, x[1].tolist(), None), (None, x[1].tolist(), 1)]
    rows += [(850, [1.0, 2.0], 1), (851, [2.0, 1.0], 1), (852, [2.0, 0.9], 3), (900, [], 1), (901, [], 2), (950, [0.0] * 16, 9), (951, [0.0] * 16, 9)]
    return rows


def brute(rows, every=50, positives=5, count=3, window=(50, 95), scale=256):
    use = [(i, k, tuple(math.floor(scale * c) for c in v)) for i, v, k in rows if None not in (i, v, k) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, k, q in sorted({r for r in use if r[0] % every == 0}):
        s = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, m) for j, m, v in use if j != i and len(v) == len(q)]
        for p, j, _ in sorted(x for x in s if x[2] == k)[:positives]:
            hard = sorted((n, m) for n, m, other in s if other != k and window[0] * -p <= 100 * -n <= window[1] * -p)[:count]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(hard, 1)]
    return sorted(out)


COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("tile", [4096, 40, 150])
def test_equals_a_full_comparison(spark, tile):
    rows = awkward()
    df = spark.createDataFrame([(i, v, k, 1, 2, "x", 3) for i, v, k in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, negatives.mine(df, tile=tile).select(*COLS).collect()))
    assert got == brute(rows) and len(got) > 50


def test_none_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none).count() == 0
    three = spark.createDataFrame([(50, [1.0, 0.0], 1, 1, 2, "x", 3), (51, [1.0, 0.0], 1, 1, 2, "x", 3), (52, [0.75, 5.0], 2, 1, 2, "x", 3)], SCHEMA)
    assert [tuple(r) for r in negatives.mine(three).select(*COLS).collect()] == [(50, 51, 1, 52, 65536, 49152)]
    assert negatives.mine(three.where("label = 1")).count() == 0


def test_tree_covers_its_rows_and_bounds_hold():
    x, label = clustered(1000, 12, 4)
    x = np.floor(256 * x)
    t = negatives.BallTree.unpacked(negatives.BallTree(x, np.arange(1000), label).packed())
    assert sorted(t.ids.tolist()) == list(range(1000)) and (t.x == x[t.ids]).all()
    assert sorted(i for n in t.leaves for i in range(*t.span[n])) == list(range(1000))
    low, high = t.bounds(x[:40])
    s = x[:40] @ t.x.T
    for n, (a, b) in enumerate(t.span):
        assert (low[:, n] <= s[:, a:b].min(1)).all() and (high[:, n] >= s[:, a:b].max(1)).all()
        assert t.only[n] == (len(set(t.labels[a:b].tolist())) == 1)


def test_bounds_leave_rows_out():
    rng = np.random.default_rng(8)
    centres = 1000 * rng.normal(size=(40, 32))
    which = rng.integers(0, 40, 4000)
    x = np.floor(centres[which] + 30 * rng.normal(size=(4000, 32)))
    label = which % 5
    t = negatives.BallTree(x, np.arange(4000), label)
    q, low = x[:64], np.full((64, 1), negatives.NONE + 1)
    best, seen = negatives.search(t, q, np.arange(64), label[:64], low, np.full((64, 1), negatives.ALL), True, 5)
    for i in range(64):
        s = np.where((label == label[i]) & (np.arange(4000) != i), x @ x[i], -np.inf)
        assert best.id[i, 0].tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist()
    assert seen < 0.15 * 64 * 4000
    top = best.score[:, 0, 0].astype(float)
    low, high = np.ceil(top * 0.5)[:, None].astype(np.int64), np.floor(top * 0.95)[:, None].astype(np.int64)
    best, seen = negatives.search(t, q, np.arange(64), label[:64], low, high, False, 3)
    for i in range(64):
        s = x @ x[i]
        s = np.where((label != label[i]) & (s >= low[i]) & (s <= high[i]), s, -np.inf)
        want = [j for j in np.lexsort((np.arange(4000), -s))[:3].tolist() if s[j] > -np.inf]
        assert best.id[i, 0][: len(want)].tolist() == want and (best.score[i, 0][len(want) :] == negatives.NONE).all()
    assert seen < 0.3 * 64 * 4000
