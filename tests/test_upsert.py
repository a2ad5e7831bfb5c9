import duckdb

from gridwake.operators import schedule
from gridwake.plans import registry


def test_series_are_matched_apart(spark):
    old = spark.createDataFrame([("a", 1.0, 10.0), ("b", 1.0, 20.0), (None, 1.0, 30.0), ("b", 2.0, 40.0)], "k string, time double, value double")
    new = spark.createDataFrame([("b", 1.00000001, 21.0), (None, 1.0, 31.0), ("c", 2.0, 41.0)], "k string, time double, value double")
    got = schedule.match_time(old, new, by=["k"]).collect()
    assert sorted((r["k"] or "", r["value"]) for r in got) == [("", 30.0), ("", 31.0), ("a", 10.0), ("b", 21.0), ("b", 40.0), ("c", 41.0)]
    assert sorted(r["value"] for r in schedule.match_time(old, new).collect()) == [21.0, 31.0, 41.0]


def test_added_rows_leave_events_of_their_times(spark, tmp_path):
    """Events whose times reach those of the rows that are added."""
    kinds = ["purchase", "view", None]
    rows = [(i, kinds[n % 3], float(n)) for n, i in enumerate([0, 1, 2, *range(1998998, 1999008)])]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["time_upsert"](spark, str(tmp_path)).select("id", "time", "value").collect())
    assert got == sorted(duck.sql(registry.ORACLE_SQL["time_upsert"]).select("id, time, value").fetchall())
    assert len(got) == len(rows) + 5
