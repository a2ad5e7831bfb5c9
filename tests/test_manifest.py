"""Many files along time: which are opened, and what a memo saves."""

import shutil

import pytest
from pyspark.sql import functions as F

from gridwake.operators.slices import Variable
from gridwake.sources import arrays
from gridwake.sources.manifest import Manifest, Memo


@pytest.fixture
def files(spark, tmp_path):
    """Ten files of five steps each: value is the step, and 100 more a cell; one folder is empty of rows."""
    paths = []
    for k in range(10):
        df = spark.createDataFrame([(i, t, float(t + 5 * k + 100 * (i - 1))) for i in (1, 2, 3) for t in range(1, 6)], "i int, t_idx int, value double")
        df.coalesce(1).write.parquet(str(tmp_path / f"part_{k}"))
        paths.append(str(tmp_path / f"part_{k}"))
    spark.createDataFrame([], "i int, t_idx int, value double").write.parquet(str(tmp_path / "part_3x"))
    return [*paths, str(tmp_path / "part_3x")]


def jobs(spark, f):
    """Jobs that f starts."""
    group = f"count-{id(f)}"
    spark.sparkContext.setJobGroup(group, "")
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    return out, n


def test_one_manifest_for_all_files(spark, files, tmp_path):
    manifest, n = jobs(spark, lambda: Manifest.of(spark, files))
    assert manifest.total == 50 and len(manifest.parts) == 10
    assert n <= 3  # schema and counts, however many files there are
    manifest.save(spark, str(tmp_path / "manifest"))
    again = Manifest.load(spark, str(tmp_path / "manifest"))
    assert again.parts == manifest.parts and again.step == "t_idx"
    assert sorted((r["i"], r["t_idx"], r["value"]) for r in manifest.read(spark).collect()) == [(i, t, t + 100.0 * (i - 1)) for i in (1, 2, 3) for t in range(1, 51)]
    assert arrays.stitched(spark, files).count() == 150


def test_only_needed_files_are_opened(spark, files):
    manifest = Manifest.of(spark, files)
    for p in files[1:3] + files[5:10]:  # what the slice does not need is gone
        shutil.rmtree(p)
    out = manifest.read(spark, 18, 22)
    assert len(out.inputFiles()) == 2
    assert sorted((r["t_idx"], r["value"]) for r in out.where("i = 1").collect()) == [(t, float(t)) for t in range(18, 23)]
    plan = manifest.read(spark, 18, 18)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(t_idx), GreaterThanOrEqual(t_idx,3), LessThanOrEqual(t_idx,3)]" in plan
    assert manifest.read(spark, 60, 70).count() == 0


def test_memo_gives_what_a_whole_scan_gives_and_reads_once(spark, files):
    arrays.stitched(spark, files).write.parquet(files[0] + "_whole")
    v = Variable(files[0] + "_whole", "t", scale=2.0, offset=5.0, with_time=True, axis=(2001.0, 2050.0), step=1.0)
    memo = Memo(spark, v, Manifest.of(spark, files))
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    for request in [(2007.0,), (2004.0, 2012.0, "range"), (2011.5, None, "interp"), (1990.0, None, "extrap"), (2060.0, None, "extrap"), (2001.0, 2050.0, "range_mean"), (2048.0, 2055.0, "range_sum"), (1999.0,)]:
        got, want = memo.update(*request), v.update(spark, *request)
        assert [tuple(map(str, r)) for r in rows(got.select(*sorted(got.columns)))] == [tuple(map(str, r)) for r in rows(want.select(*sorted(got.columns)))], request
    memo = Memo(spark, v, Manifest.of(spark, files))
    first = memo.update(2020.25, method="interp")
    assert first.where("i = 1").first()["value"] == pytest.approx(2 * 20.25 + 5)
    assert memo.scans == 1 and len(memo.opened) == 2
    for p in files:  # the files are gone: what is asked for between the same steps needs them no more
        shutil.rmtree(p)
    for t in (2020.25, 2020.5, 2020.9, 2020.0):
        assert memo.update(t, method="interp").where("i = 3").first()["value"] == pytest.approx(2 * (t - 2000 + 200) + 5)
    assert memo.update(2021.0).where("i = 1").first()["value"] == 2 * 21 + 5
    assert memo.scans == 1
    memo.close()


def test_parts_of_years_and_static_fields(spark, tmp_path):
    for k in range(3):
        df = spark.range(1, 13).select(F.lit(1).alias("i"), F.col("id").cast("int").alias("t_idx"), (F.col("id") + 12 * k).cast("double").alias("value"))
        df.coalesce(1).write.parquet(str(tmp_path / f"year_{k}"))
    paths = [str(tmp_path / f"year_{k}") for k in range(3)]
    v = Variable("", "t", with_time=True, axis=(2000.0, 2002.0), step=1.0, n_sub=12)
    memo = Memo(spark, v, Manifest.of(spark, paths))
    got = {r["slot"]: r["value"] for r in memo.update(2001.0, 2002.0, "range_mean", 12).collect()}
    assert got == {m: (m + 13 + m + 25) / 2 for m in range(12)}
    assert len(memo.opened) == 2
    memo.close()
    with pytest.raises(ValueError):
        Memo(spark, Variable("", "t", with_time=True, axis=(2000.0, 2005.0), step=1.0, n_sub=12), Manifest.of(spark, paths))
    static = Memo(spark, Variable("", "t"), Manifest.of(spark, paths[:1]))
    assert static.update().count() == 12
