import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.model import Axis, CoordSystem, Grid
from gridwake.sources import arrays, config
from gridwake.streaming import forcing
from gridwake.streaming.forcing import Forcing


def test_namelist():
    text = '&temp\n  filename = "a_{domain}.nc"\n  units = "K" "K"  ! both\n  scaling = 2.0, 5.0d0\n  on = .true.\n  bad = 3.5x\n/\nrun.dt=0.5 run.name="x!y"\n'
    n = config.Namelist(text)
    assert config.fill_path(n.get("temp", "filename"), domain="greenland") == "a_greenland.nc"
    assert n.vector("temp", "units", str) == ["K", "K"]
    assert n.vector("temp", "scaling") == [2.0, 5.0]
    assert n.get("temp", "on", bool) is True
    assert n.get("temp", "bad", float) == 3.5
    assert (n.get("run", "dt", float), n.get("run", "name")) == (0.5, "x!y")
    with pytest.raises(KeyError):
        n.get("temp", "none")


def test_namelist_over_defaults():
    n = config.Namelist("&a\n x = 2\n extra = 1\n/\n", "&a\n x = 1\n y = 5\n/\n")
    assert (n.get("a", "x", int), n.get("a", "y", int)) == (2, 5)
    assert n.unknown() == ["a.extra"]
    with pytest.raises(KeyError):
        n.get("a", "extra", int)
    assert config.parse_namelist(n.text())["a"] == {"x": "2", "y": "5", "extra": "1"}


def test_variable_table(spark):
    text = "| id | varname | dims | units | long_name |\n|---|---|---|---|---|\n| 1 | H_ice | xc, yc | m | Ice thickness |\n| 2 | time | | yr | Time |\n"
    v = config.variables(spark, text)
    assert config.find_variable(v, "H_ice").first()["dims"] == ["xc", "yc"]
    assert v.count() == 2


def test_grid_description_round_trip():
    g = Grid("grl", Axis(-720.0, 20.0, 85), Axis(-3450.0, 20.0, 145), CoordSystem("stereographic", "km", lon=-40.0, lat=72.0, alpha=7.5))
    assert config.grid_of(config.describe(g)) == g
    lat = config.grid_of("gridtype = lonlat\nxsize = 4\nysize = 3\nxfirst = 0\nxinc = 90\nyvals = 60 0\n -60\n")
    assert (lat.y.x0, lat.y.dx, lat.y.n) == (60.0, -60.0, 3)


def test_decode_and_encode(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-9999.0,), (1e-31,), (1e26,)], "value double")
    assert [r[0] for r in df.select(arrays.decoded(F.col("value"))).collect()] == [1.0, None, None, 0.0, None]
    back = df.select(arrays.encoded(arrays.decoded(F.col("value"), 2.0, 5.0), 2.0, 5.0)).collect()
    assert [r[0] for r in back] == [1.0, -9999.0, -9999.0, 0.0, -9999.0]


def test_slabs_and_stitching(spark, tmp_path):
    for k, part in enumerate((range(1, 6), range(1, 6))):
        df = spark.createDataFrame([(i, t, float(t + 5 * k + 100 * (i - 1))) for i in (1, 2, 3) for t in part], "i int, t_idx int, value double")
        arrays.write_field(df, str(tmp_path / f"part_{k}"), ["t_idx"], scale=2.0, offset=5.0)
    both = arrays.stitched(spark, [str(tmp_path / f"part_{k}") for k in (1, 0)])
    assert arrays.shape(both, ["i", "t_idx"]) == {"i": 3, "t_idx": 10}
    slab = arrays.read_slab(spark, str(tmp_path / "part_1"), {"t_idx": 2}, {"t_idx": 1}, scale=2.0, offset=5.0)
    assert sorted(r["value"] for r in slab.collect()) == [7.0, 107.0, 207.0]
    assert "PushedFilters: [IsNotNull(t_idx)" in slab._jdf.queryExecution().toString()
    assert arrays.transposed(slab, "i", "t_idx").columns == ["t_idx", "i", "value"]
    assert arrays.attributes(arrays.with_attributes(slab, "value", units="K"), "value") == {"units": "K"}


def test_ascii_series(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# time a b\n\n0 0 100\n  1000, 10 200\n! no\ntext\n2.0d3 20 300\n")
    out = {(r["time"], r["channel"]): r["value"] for r in arrays.read_series(spark, str(tmp_path / "s.txt")).collect()}
    assert out == {(0.0, 1): 0.0, (0.0, 2): 100.0, (1000.0, 1): 10.0, (1000.0, 2): 200.0, (2000.0, 1): 20.0, (2000.0, 2): 300.0}
    (tmp_path / "bad.txt").write_text("1\n2\n")
    with pytest.raises(ValueError):
        arrays.read_series(spark, str(tmp_path / "bad.txt"))


def test_classic_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "f.nc")
    df = spark.createDataFrame([(t, i, None if (t, i) == (2, 3) else float(10 * t + i)) for t in range(1, 5) for i in range(1, 4)], "time int, x int, value double")
    arrays.to_classic(df, path, ["time", "x"], units="K")
    f = arrays.ClassicFile(path)
    assert f.vars["value"]["attributes"]["units"] == "K"
    spark.dataSource.register(arrays.ClassicSource)
    back = spark.read.format("classic_netcdf").option("path", path).option("variable", "value").option("cells", "6").load()
    assert back.rdd.getNumPartitions() == 2
    assert {(r["time_idx"], r["x_idx"]): r["value"] for r in back.collect()} == {(r["time"], r["x"]): r["value"] for r in df.collect()}
    arrays.write_classic(path, {"n": 3}, {"v": (["n"], np.array([1, 2, 3], "i2"), {"scale_factor": 0.5, "add_offset": 1.0})})
    assert [r["value"] for r in spark.read.format("classic_netcdf").option("path", path).option("variable", "v").load().orderBy("n_idx").collect()] == [1.5, 2.0, 2.5]


def test_closed_forms(spark):
    t = spark.createDataFrame([(x,) for x in (0.0, 500.0, 1000.0, 1500.0, 2000.0, 3000.0)], "t double")
    ev = lambda p: [r[0] for r in t.orderBy("t").select(forcing.closed_form(p, F.col("t"))).collect()]
    assert ev(Forcing("ramp-time", dt_ramp=1000.0, f_max=10.0)) == [0, 5, 10, 10, 10, 10]
    assert ev(Forcing("ramp-time-step", dt_ramp=1000.0, dt_conv=1000.0, f_max=10.0, f_conv=5.0)) == [0, 5, 10, 7.5, 5, 5]
    assert ev(Forcing("sin", dt_ramp=2000.0, f_max=10.0)) == pytest.approx([5, 10, 5, 0, 5, 5])
    for m in forcing.OPEN:
        p = Forcing(m, dt_ramp=1000.0, dt_conv=700.0, dt_init=100.0, df_dt_max=0.01, df_sign=-1.0, f_max=10.0, f_conv=5.0)
        assert ev(p) == pytest.approx([forcing.open_value(p, r[0]) for r in t.orderBy("t").collect()])


def response(spark, keys=2):
    t = spark.range(300).select((F.col("id") * 50.0).alias("time"))
    return spark.range(keys).select(F.col("id").cast("string").alias("key")).crossJoin(t).select("key", "time", (500 * F.exp(-F.col("time") / 1000)).alias("var"), (-0.5 * F.exp(-F.col("time") / 1000)).alias("dv_dt"))


@pytest.mark.parametrize("method", forcing.FEEDBACK)
def test_feedback_stays_in_bounds(spark, method):
    p = Forcing(method, dt_ave=200.0, tol=0.1, df_dt_max=0.01, f_max=10.0)
    out = forcing.run_batch(response(spark), p).toPandas()
    assert len(out) == 600
    assert out["f"].between(0, 10).all()
    first = out[out.key == "0"].sort_values("time")
    assert (first[first.time < 200]["f"] == 0).all()
    assert first["f"].iloc[-1] > 0


def test_kill_switch(spark):
    p = Forcing("ramp-time", with_kill=True, dt_ave=100.0, dt_ramp=1000.0, tol=1e-3, f_max=10.0)
    out = forcing.run_batch(response(spark, 1).withColumn("dv_dt", F.lit(0.0)), p).toPandas()
    assert not out[out.time < 1000]["kill"].any()
    assert out[out.time >= 1000]["kill"].all()


def test_history_is_a_mean_over_the_window():
    p, s = Forcing("PI42", dt_ave=100.0, tol=0.1, df_dt_max=0.1, f_max=10.0), forcing.State()
    for k in range(10):
        forcing.advance(p, s, 40.0 * k, 0.0, float(k))
    assert s.ave == pytest.approx((7 + 8 + 9) / 3)
    again = forcing.State.loads(s.dumps())
    assert again == s


def test_controllers_by_hand():
    p = Forcing("PI42", tol=0.1, df_dt_max=1.0, f_max=1.0)
    assert forcing.controlled_rate(p, [0.2, 0.4, 0.8], [0.01, 0.02, 0.04]) == pytest.approx((0.1 / 0.2) ** 0.3 * (0.1 / 0.4) ** -0.1 * 0.01)
    p = Forcing("PID1", tol=0.1, df_dt_max=1.0, f_max=1.0)
    assert forcing.controlled_rate(p, [0.2, 0.4, 0.8], [0.01] * 3) == pytest.approx((0.1 / 0.2) ** 0.175 * (0.4 / 0.2) ** 0.075 * (0.4**2 / (0.2 * 0.8)) ** 0.01 * 0.01)
    p = Forcing("H321PID", tol=0.1, df_dt_max=1.0, f_max=1.0)
    want = (0.1 / 0.2) ** (0.0375 + 0.1125) * (0.1 / 0.4) ** 0.025 * (0.1 / 0.8) ** -(0.0125 + 0.1125) * 0.5 * 0.01
    assert forcing.controlled_rate(p, [0.2, 0.4, 0.8], [0.01, 0.02, 0.04]) == pytest.approx(want)


def test_stream_equals_batch(spark, tmp_path):
    p = Forcing("PI42", dt_ave=200.0, tol=0.1, df_dt_max=0.01, f_max=10.0)
    rows = response(spark, 2).where("time < 2000")
    want = {(r["key"], r["time"]): r["f"] for r in forcing.run_batch(rows, p).collect()}
    src = tmp_path / "in"
    for k, (lo, hi) in enumerate(((0, 700), (700, 2000))):
        rows.where(f"time >= {lo} and time < {hi}").coalesce(1).write.parquet(str(src / f"b{k}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = forcing.run_stream(stream, p).writeStream.format("memory").queryName("forced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["key"], r["time"]): r["f"] for r in spark.table("forced").collect()} == pytest.approx(want)


def test_table_has_rates(spark):
    p = Forcing("ramp-time", dt_ramp=100.0, f_max=10.0)
    t = spark.createDataFrame([(x,) for x in (0.0, 50.0, 100.0, 150.0)], "time double")
    out = forcing.tabulate(p, t, 0.0).orderBy("time").collect()
    assert [r["df_dt"] for r in out] == pytest.approx([0.1, 0.1, 0.05, 0.0])
    assert math.isfinite(sum(r["f"] for r in out))
    with pytest.raises(ValueError):
        forcing.tabulate(Forcing("PI42"), t, 0.0)
