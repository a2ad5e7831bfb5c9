import numpy as np
import pytest

from gridwake.operators import links


@pytest.mark.parametrize("ids", [2, 1024])
def test_points_of_equal_place_are_all_paired(spark, monkeypatch, ids):
    monkeypatch.setattr(links, "IDS", ids)
    rng = np.random.default_rng(6)
    a, b = rng.integers(-4, 5, (60, 2)) / 2.0, rng.integers(-4, 5, (90, 2)) / 2.0
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(1000, None, 0.0), (1001, -0.0, -0.0)], "dst long, x double, y double")
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)] + [(1000, 0.0, None)], "src long, x double, y double")
    a = np.vstack([a, [[0.0, 0.0]]])
    names = [*range(60), 1001]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    got = sorted((r["dst"], r["src"], r["dist"]) for r in links.radius_pairs(t, s, 1.25, digits=9).collect())
    want = sorted((names[i], int(j), round(float(d[i, j]), 9)) for i, j in np.argwhere(d <= 1.25))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_places_meet_once(spark):
    """400 targets and 500 sources at one place each: one row joins, 200,000 pairs follow."""
    t = spark.range(400).selectExpr("id as dst", "id * 0D as x", "id * 0D as y")
    s = spark.range(500).selectExpr("id as src", "id * 0D + 1 as x", "id * 0D as y")
    out = links.radius_pairs(t, s, 1.25, digits=3)
    assert out.count() == 200_000 and out.distinct().count() == 200_000
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(k for k, line in enumerate(plan) if "Join Inner" in line)
    assert sum("explode" in line for line in plan[:joined]) == 2 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
