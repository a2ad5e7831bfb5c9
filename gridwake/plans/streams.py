"""Forcing generators and sliding means over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.plans.registry import query, rounded, table
from gridwake.streaming import forcing
from gridwake.streaming.forcing import Forcing

#: Days of orders since 1995: the times that generators are evaluated at.
_T = "t as (select o_orderkey as id, date_diff('day', date '1995-01-01', o_orderdate::date)::double as t from orders)"


def times(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("t"))


def _closed(name: str, p: Forcing, sql: str):
    def f(spark, d):
        return times(spark, d).select("id", "t", rounded(forcing.closed_form(p, F.col("t")), 9).alias("f"))

    f.__name__ = name
    return query(f"with {_T} select id, t, round({sql}, 9) + 0.0 as f from t")(f)


_closed("forcing_ramp", Forcing("ramp-time", dt_ramp=1000.0, f_min=0.0, f_max=10.0), "least(greatest(t / 100, 0), 10)")
_closed("forcing_slope", Forcing("ramp-slope", df_dt_max=0.004, df_sign=-1.0, dt_init=100.0, f_min=2.0, f_max=10.0), "least(greatest(10 - 0.004 * greatest(t - 100, 0), 2), 10)")
_closed("forcing_step", Forcing("ramp-time-step", dt_ramp=1000.0, dt_conv=1000.0, f_min=0.0, f_max=10.0, f_conv=5.0), "case when t <= 1000 then t / 100 when t <= 2000 then 10 - (t - 1000) / 200 else 5 end")
_closed("forcing_sin", Forcing("sin", dt_ramp=2000.0, f_min=0.0, f_max=10.0), "5 * sin(2 * pi() * t / 2000) + 5")


@query(f"""with {_T}, f as (select distinct t, least(greatest(t / 100, 0), 10) as f from t) select t as time, round(f, 9) as f_mean,
  round((coalesce(lead(f) over w, f) - coalesce(lag(f) over w, f)) / (coalesce(lead(t) over w, t) - coalesce(lag(t) over w, t)), 9) as df_dt from f window w as (order by t)""")
def forcing_table(spark, d):
    p = Forcing("ramp-time", dt_ramp=1000.0, f_min=0.0, f_max=10.0)
    out = forcing.tabulate(p, times(spark, d).select(F.col("t").alias("time")).distinct(), 0.0)
    return out.select("time", rounded("f_mean", 9).alias("f_mean"), rounded("df_dt", 9).alias("df_dt"))


_H = "e as (select user_id as key, event_id as id, epoch(ts)::double as time, value as dv_dt from events)"


@query(f"with {_H} select key, id, round(avg(dv_dt) over (partition by key order by time range between 86400 preceding and current row), 6) as dv_dt_ave from e")
def history_mean(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.col("value").alias("dv_dt"))
    return forcing.sliding_mean(rows, 86400.0).select("key", "id", rounded("dv_dt_ave").alias("dv_dt_ave"))


_DAILY = """m as (select event_type as k, date_diff('day', date '2024-01-01', ts::date)::double as t, avg(value) as v from events group by 1, 2), s as (select k, dense_rank() over (order by k) as c, t, v from m)"""


@query(f"""with {_DAILY}, p as (select i / 2.0 - 1 as time from range(0, 70) r(i)), n as (select distinct c from s),
b as (select p.time, n.c, (select max_by(struct_pack(t := t, v := v), t) from s where s.c = n.c and s.t <= p.time) as lo, (select min_by(struct_pack(t := t, v := v), t) from s where s.c = n.c and s.t > p.time) as hi from p, n)
select time, round(avg(case when lo is null then hi.v when hi is null then lo.v else lo.v + (hi.v - lo.v) * (time - lo.t) / (hi.t - lo.t) end), 6) as f_mean from b group by 1""")
def forcing_series(spark, d):
    """A forcing that follows a series of five channels, clamped at its ends."""
    from pyspark.sql import Window

    e = table(spark, d, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double").alias("time")).agg(F.avg("value").alias("value"))
    kinds = e.select("event_type").distinct().withColumn("channel", F.dense_rank().over(Window.orderBy("event_type")))  # five kinds
    series = e.join(F.broadcast(kinds), "event_type").select("time", "channel", "value")
    at = spark.range(70).select((F.col("id") / 2 - 1).alias("time"))
    return forcing.from_series(series, at, width=4.0).select("time", rounded("f_mean").alias("f_mean"))


def _responses(spark, d):
    """A response for each kind of event: its rate falls off as exp(-t / 1000)."""
    kinds = table(spark, d, "events").select(F.col("event_type").alias("key")).distinct()
    t = spark.range(300).select((F.col("id") * 50.0).alias("time"))
    return kinds.join(F.broadcast(t)).select("key", "time", (500 * F.exp(-F.col("time") / 1000)).alias("var"), (-0.5 * F.exp(-F.col("time") / 1000)).alias("dv_dt"))


def _feedback_sql(method: str) -> str:
    """The recurrence over the 300 steps: past errors e0..e2 and rates s0..s2, newest first."""
    if method == "exp":
        rate = "1e-9 + exp(-least(abs(ave) / 0.1, 10)) * (0.01 - 1e-9)"
    else:
        powers = {"PI42": ((0.3, -0.1, 0), (0, 0)), "H312b": ((0.0625, 0.125, 0.0625), (-0.375, -0.125)), "H312PID": ((0.01, 0.02, 0.01), (0, 0)), "H321PID": ((0.15, 0.025, -0.125), (1, 0)), "PID1": ((0.26, -0.095, 0.01), (0, 0))}
        e, s = powers[method]
        parts = [f"pow(0.1 / e{k}, {x})" for k, x in enumerate(e)] + [f"pow(s{k} / s{k + 1}, {x})" for k, x in enumerate(s)]
        rate = f"least(greatest({' * '.join(parts)} * s0, 1e-9), 0.01)"
    return f"""with recursive a as (select i as n, i * 50.0 as time, avg(-0.5 * exp(-i * 50.0 / 1000)) over (order by i rows between 4 preceding and current row) as ave from range(0, 300) t(i)),
r as (select 0::bigint as n, 0.0::double as f, 1e-3::double as e0, 1e-3::double as e1, 1e-3::double as e2, 1e-9::double as s0, 1e-9::double as s1, 1e-9::double as s2
  union all select n + 1, least(greatest(f + 50 * case when go and x >= 1e-8 then x else 0 end, 0), 10), case when go then greatest(abs(ave), 1e-3) else e0 end, case when go then e0 else e1 end, case when go then e1 else e2 end,
    case when go then x else s0 end, case when go then s0 else s1 end, case when go then s1 else s2 end
  from (select r.*, a.ave, a.n >= 4 as go, {rate} as x from r join a on a.n = r.n + 1)),
k as (select distinct event_type as key from events)
select key, time, round(f, 6) + 0.0 as f, round(ave, 6) + 0.0 as dv_dt_ave, false as kill from k, r join a using (n)"""


def _feedback(method: str):
    def f(spark, d):
        p = Forcing(method, dt_ave=200.0, df_sign=1.0, tol=0.1, df_dt_max=0.01, f_min=0.0, f_max=10.0)
        out = forcing.run_batch(_responses(spark, d), p)
        return out.select("key", "time", rounded("f").alias("f"), rounded("dv_dt_ave").alias("dv_dt_ave"), "kill")

    f.__name__ = f"tsgen_{method.lower()}"
    return query(_feedback_sql(method))(f)


for _method in forcing.FEEDBACK:
    _feedback(_method)


@query("""with k as (select distinct event_type as key from events), t as (select i * 50.0 as time from range(0, 300) r(i))
select key, time, round(least(time / 100, 10), 6) as f, time >= 1000 as kill from k, t""")
def tsgen_kill(spark, d):
    p = Forcing("ramp-time", with_kill=True, dt_ave=100.0, dt_ramp=1000.0, tol=1e-3, f_min=0.0, f_max=10.0)
    flat = _responses(spark, d).withColumn("dv_dt", F.lit(0.0))
    return forcing.run_batch(flat, p).select("key", "time", rounded("f").alias("f"), "kill")
