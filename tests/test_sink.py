"""Array files: what a slice reads, and writing by many tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.sources import arrays, sink


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "f.nc")
    z = np.arange(40 * 6 * 5, dtype=float).reshape(40, 6, 5)
    arrays.write_classic(path, {"time": 40, "y": 6, "x": 5}, {"time": (["time"], 1990.0 + np.arange(40) / 2, {}), "v": (["time", "y", "x"], z, {})})
    return path, z


def rows(df):
    return {(r["time_idx"], r["y_idx"], r["x_idx"]): r["value"] for r in df.collect()}


CASES = {
    "time_idx = 7": lambda t, y, x: t == 7,
    "time_idx > 36 and y_idx <= 2": lambda t, y, x: t > 36 and y <= 2,
    "time_idx in (3, 9) and x_idx = 2": lambda t, y, x: t in (3, 9) and x == 2,
    "y_idx >= 3 and y_idx < 5": lambda t, y, x: 3 <= y < 5,
    "time between 1995.0 and 1996.0": lambda t, y, x: 1995 <= 1990 + (t - 1) / 2 <= 1996,
    "time_idx = 50": lambda t, y, x: False,
    "value < 31 or y_idx = 6": lambda t, y, x: (t - 1) * 30 + (y - 1) * 5 + x - 1 < 31 or y == 6,
}


@pytest.mark.parametrize("where", CASES)
def test_conditions_give_the_rows_they_ask_for(spark, file, where):
    path, z = file
    df = arrays.read_classic(spark, path, "v", time="time", cells=90)
    want = {(t + 1, y + 1, x + 1): z[t, y, x] for t, y, x in np.ndindex(z.shape) if CASES[where](t + 1, y + 1, x + 1)}
    assert rows(df.where(where)) == want


def test_bytes_follow_the_slice(file, monkeypatch):
    path, _ = file
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    taken = []
    made = arrays.ClassicFile
    monkeypatch.setattr(arrays, "ClassicFile", lambda p: taken.append(made(p)) or taken[-1])

    def read(*filters):
        taken.clear()
        r = arrays.PrunedReader(path, "v", 10_000)
        left = list(r.pushFilters(list(filters)))
        n = sum(b.num_rows for p in r.partitions() for b in r.read(p))
        return n, sum(f.taken for f in taken), left

    assert read() == (1200, 9600, [])
    assert read(IsNotNull(("time_idx",)), EqualTo(("time_idx",), 4)) == (30, 240, [])
    assert read(GreaterThan(("time_idx",), 38), LessThanOrEqual(("y_idx",), 2)) == (20, 160, [])
    other = EqualTo(("x_idx",), 2)
    assert read(other) == (1200, 9600, [other])


def test_what_a_slice_does_not_need_may_be_gone(spark, file):
    path, z = file
    os.truncate(path, os.path.getsize(path) - 20 * 240)  # the last 20 steps
    df = arrays.read_classic(spark, f"file://{path}", "v")
    assert rows(df.where("time_idx <= 3 and y_idx = 1")) == {(t + 1, 1, x + 1): z[t, 0, x] for t in range(3) for x in range(5)}


def test_many_tasks_write_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "CELLS", 50)
    rng = np.random.default_rng(0)
    z = rng.normal(size=(11, 7, 3))
    z[rng.random(z.shape) < 0.2] = np.nan
    cells = [(i + 1, j + 1, k + 1, None if np.isnan(z[i, j, k]) else float(z[i, j, k])) for i, j, k in np.ndindex(z.shape) if (i + j + k) % 6 or not np.isnan(z[i, j, k])]
    df = spark.createDataFrame(cells, "a int, b int, c int, value double").repartition(5)
    path = str(tmp_path / "z.nc")
    arrays.to_classic(df, path, ["a", "b", "c"], units="K")
    f = arrays.ClassicFile(path)
    got = f.steps("value", 0, 11)
    assert (got == np.where(np.isnan(z), arrays.MISSING, z)).all()
    assert f.vars["value"]["attributes"]["units"] == "K" and os.listdir(tmp_path) == ["z.nc"]


def test_a_failed_write_leaves_the_target(spark, tmp_path):
    path = str(tmp_path / "z.nc")
    arrays.to_classic(spark.range(1, 4).select(F.col("id").cast("int").alias("i"), F.lit(1.0).alias("value")), path, ["i"])
    before = open(path, "rb").read()
    bad = spark.range(3).select(F.col("id").alias("at"), F.expr("if(id < 2, 1.0D, raise_error('lost'))").cast("double").alias("v"))
    with pytest.raises(Exception, match="lost"):
        sink.write_arrays(spark, path, {"i": 3}, {"value": (["i"], bad, {})})
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["z.nc"]


def test_positions_are_those_of_a_sort(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), (F.col("id") % 3).alias("m"))
    placed, n = sink.positions(df, ["m", "k"])
    got = [(r["m"], r["k"]) for r in placed.orderBy("at").collect()]
    assert n == 500 and got == sorted(got) and sorted(r["at"] for r in placed.collect()) == list(range(500))
    none, n = sink.positions(df.where("false"), ["k"])
    assert n == 0 and none.count() == 0
