"""Forcing generators: closed forms as columns, feedback control as keyed state.

Closed forms depend on elapsed time only. Feedback methods hold a sliding mean of the response's
rate over dt_ave (the last MEMORY rows), and a controller that scales the rate of change by past
errors and rates. The same step function runs over a key's rows in time order (batch) and over
micro-batches with state (streaming); the state carries on exactly where it stopped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.model import DIVIDE_TOLERANCE
from gridwake.operators.series import series_lookup

MEMORY = 2000
#: Least rate of change, and least newest error.
LEAST_RATE, LEAST_ERROR = 1e-9, 1e-3
OPEN = ("const", "ramp-slope", "ramp-time", "ramp-time-step", "sin")
FEEDBACK = ("exp", "PI42", "H312b", "H312PID", "H321PID", "PID1")


@dataclass
class Forcing:
    method: str = "const"
    with_kill: bool = False
    dt_ave: float = 0.0
    dt_init: float = 0.0
    dt_ramp: float = 0.0
    dt_conv: float = 0.0
    df_sign: float = 1.0
    tol: float = 1e-4
    df_dt_max: float = 0.0
    sigma: float = 0.0
    f_min: float = 0.0
    f_max: float = 1.0
    f_conv: float = 0.0

    @classmethod
    def from_namelist(cls, nl, group: str = "tsgen") -> Forcing:
        """The generator of a namelist group: the method is read first, then what it needs."""
        method, sigma = nl.get(group, "method"), nl.get(group, "sigma", float)
        if method == "series":
            return cls(method, sigma=sigma, dt_ave=1.0, dt_ramp=1.0, dt_conv=1.0, tol=1.0, f_max=0.0)
        if method not in (*OPEN, *FEEDBACK):
            raise ValueError(f"unknown method {method!r}")
        names = [f.name for f in fields(cls) if f.name not in ("method", "sigma", "with_kill")]
        numbers = {k: nl.get(group, k, float) for k in names}
        numbers["df_sign"] = 1.0 if numbers["df_sign"] >= 0 else -1.0
        return cls(method, nl.get(group, "with_kill", bool), sigma=sigma, **numbers)

    @property
    def start(self) -> float:
        return self.f_min if self.df_sign > 0 else self.f_max

    @property
    def far(self) -> float:
        return self.f_max if self.df_sign > 0 else self.f_min


def closed_form(p: Forcing, elapsed: Column) -> Column:
    """The forcing of an open method as a column of elapsed time; feedback methods give their start."""
    tau = F.greatest(F.lit(0.0), elapsed - p.dt_init)
    low, high = F.lit(float(p.f_min)), F.lit(float(p.f_max))
    if p.method in ("const", "ramp-slope", "ramp-time"):
        rate = p.df_dt_max if p.method != "ramp-time" else abs(p.f_max - p.f_min) / p.dt_ramp
        return F.least(F.greatest(F.lit(float(p.start)) + p.df_sign * rate * tau, low), high)
    if p.method == "ramp-time-step":
        up = p.start + (p.far - p.start) * tau / p.dt_ramp
        back = p.far + (p.f_conv - p.far) * (tau - p.dt_ramp) / p.dt_conv
        return F.when(tau <= p.dt_ramp, up).when(tau <= p.dt_ramp + p.dt_conv, back).otherwise(F.lit(float(p.f_conv)))
    if p.method == "sin":
        t = F.when(elapsed <= p.dt_init, F.lit(0.0)).otherwise(elapsed)
        return (p.f_max - p.f_min) / 2 * F.sin(2 * math.pi * t / p.dt_ramp) + (p.f_max + p.f_min) / 2
    return F.lit(float(p.start))


def tabulate(p: Forcing, times: DataFrame, t0: float, seed: int = 0) -> DataFrame:
    """times with f_mean, f (with noise) and df_dt by central differences, one-sided at the ends."""
    from pyspark.sql import Window

    if p.method in FEEDBACK:
        raise ValueError("feedback methods have no table: they need a response")
    w = Window.orderBy("time")
    out = times.withColumn("f_mean", closed_form(p, F.col("time") - t0))
    before, after = (F.coalesce(f("f_mean").over(w), F.col("f_mean")) for f in (F.lag, F.lead))
    span = F.coalesce(F.lead("time").over(w), F.col("time")) - F.coalesce(F.lag("time").over(w), F.col("time"))
    out = out.withColumn("df_dt", F.when(span > 0, (after - before) / span).otherwise(0.0))
    noise = F.randn(seed) * p.sigma if p.sigma > 0 else F.lit(0.0)
    return out.withColumn("f", F.col("f_mean") + noise)


def from_series(series: DataFrame, times: DataFrame, sigma: float = 0.0, seed: int = 0, width: float = 1.0, channels: bool = False) -> DataFrame:
    """(time, f_mean, f): a series (time, channel, value[, sigma]) at the times, clamped, as the mean of its channels; with
    channels=True a row for each of them.

    Noise has the series' own deviation, or sigma where it has none; the first time has none.
    """
    every = times.select("time").distinct().join(F.broadcast(series.select("channel").distinct()))  # a series has few channels
    at = series_lookup(series, every.select("channel", "time"), ["channel"], width)
    spread = F.when(F.coalesce("sigma", F.lit(0.0)) > 0, F.col("sigma")).otherwise(F.lit(float(sigma)))
    first = F.broadcast(times.agg(F.min("time").alias("_first")))  # one row
    noise = F.when(F.col("time") > F.col("_first"), spread * F.randn(seed)).otherwise(0.0)
    at = at.join(first).select("time", "channel", F.col("value").alias("f_mean"), (F.col("value") + noise).alias("f"))
    return at if channels else at.groupBy("time").agg(F.avg("f_mean").alias("f_mean"), F.avg("f").alias("f"))


def channel_mean(series: DataFrame) -> DataFrame:
    """(time, value): the mean over a series' channels."""
    return series.groupBy("time").agg(F.avg("value").alias("value"))


def write_steps(df: DataFrame, path: str, label: str = "") -> DataFrame:
    """Generator rows (time, f, df_dt, dv_dt_ave) added to a Parquet series by time, columns named after the label; rows
    of equal time are replaced. Returns the series as written, in a new folder under path."""
    from gridwake.operators.schedule import match_time

    spark = df.sparkSession
    pre = f"{label}_" if label else ""
    new = df.select("time", *[F.col(c).alias(f"{pre}{n}") for c, n in (("f", "f"), ("df_dt", "df_dt"), ("dv_dt_ave", "dv_dt")) if c in df.columns])
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(s.getPath().getName() for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []
    done = [d for d in done if d.startswith("v")]
    whole = match_time(spark.read.parquet(f"{path}/{done[-1]}"), new) if done else new
    at = f"{path}/v{len(done):06d}"
    whole.write.parquet(at)
    return spark.read.parquet(at)


def sliding_mean(df: DataFrame, dt_ave: float, key: str = "key", time: str = "time", value: str = "dv_dt") -> DataFrame:
    """df with the plain mean of value over [time - dt_ave, time] of its key.

    A range frame over a double needs SQL text; history beyond MEMORY rows is a matter of the stateful form.
    """
    mean = F.expr(f"avg({value}) over (partition by {key} order by {time} range between {float(dt_ave)!r}D preceding and current row)")
    return df.withColumn(f"{value}_ave", mean)


@dataclass
class State:
    """What a key carries from row to row."""

    time_init: float | None = None
    time_prev: float | None = None
    var_prev: float = 0.0
    f_mean: float | None = None
    df_dt: float = 0.0
    ave: float = 0.0
    kill: bool = False
    times: list = field(default_factory=list)
    rates: list = field(default_factory=list)
    errors: list = field(default_factory=lambda: [LEAST_ERROR] * 3)
    steps: list = field(default_factory=lambda: [LEAST_RATE] * 3)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> State:
        data = json.loads(text)
        return cls(**{f.name: data[f.name] for f in fields(cls)})


#: Exponents of tol / error (now, before, before that) and of the two last ratios of rates, for second-order steps.
def _exponents(method: str) -> tuple[tuple[float, float, float], tuple[float, float]]:
    k = 2.0
    if method == "PI42":
        i, p = 2 / (5 * k), 1 / (5 * k)
        return (i + p, -p, 0.0), (0.0, 0.0)
    if method == "H312b":
        b = 8.0
        return (1 / (k * b), 2 / (k * b), 1 / (k * b)), (-3 / b, -1 / b)
    if method == "H312PID":
        i = 0.08 / k
        return (i / 4, i / 2, i / 4), (0.0, 0.0)
    if method == "H321PID":
        i, p = 0.1 / k, 0.45 / k
        return (0.75 * i + 0.5 * p, 0.5 * i, -(0.25 * i + 0.5 * p)), (1.0, 0.0)
    if method == "PID1":
        i, p, d = 0.175, 0.075, 0.01
        # (tol/e0)^i (e1/e0)^p (e1^2/(e0 e2))^d, with every error over tol
        return (i + p + d, -(p + 2 * d), d), (0.0, 0.0)
    raise ValueError(f"unknown controller {method!r}")


def controlled_rate(p: Forcing, errors: list[float], steps: list[float]) -> float:
    """The next rate of change from past errors and rates, newest first."""
    e, r = _exponents(p.method)
    now = [max(s, LEAST_RATE) for s in steps]
    ratio = math.prod((p.tol / x) ** k for x, k in zip(errors, e, strict=True) if k)
    ratio *= math.prod(x**k for x, k in zip((now[0] / now[1], now[1] / now[2]), r, strict=True) if k)
    return min(max(ratio * now[0], LEAST_RATE), p.df_dt_max)


def open_value(p: Forcing, elapsed: float) -> float:
    """closed_form() for one number."""
    tau = max(0.0, elapsed - p.dt_init)
    if p.method in ("const", "ramp-slope", "ramp-time"):
        rate = p.df_dt_max if p.method != "ramp-time" else abs(p.f_max - p.f_min) / p.dt_ramp
        return min(max(p.start + p.df_sign * rate * tau, p.f_min), p.f_max)
    if p.method == "ramp-time-step":
        if tau <= p.dt_ramp:
            return p.start + (p.far - p.start) * tau / p.dt_ramp
        return p.far + (p.f_conv - p.far) * (tau - p.dt_ramp) / p.dt_conv if tau <= p.dt_ramp + p.dt_conv else p.f_conv
    if p.method == "sin":
        return (p.f_max - p.f_min) / 2 * math.sin(2 * math.pi * (0 if elapsed <= p.dt_init else elapsed) / p.dt_ramp) + (p.f_max + p.f_min) / 2
    return p.start


def advance(p: Forcing, s: State, time: float, var: float, dv_dt: float | None = None, noise: float = 0.0) -> float:
    """One step: history, rate, integration within bounds, noise, kill switch. Returns the forcing."""
    if s.time_init is None:
        s.time_init, s.f_mean = time, p.start
    dt = 0.0 if s.time_prev is None else time - s.time_prev
    before = s.f_mean
    feedback = p.method in FEEDBACK
    if feedback or p.with_kill:
        rate = dv_dt if dv_dt is not None else (var - s.var_prev) / dt if dt > 0 else 0.0
        s.times, s.rates = [*s.times, time][-MEMORY:], [*s.rates, rate][-MEMORY:]
        first = next(k for k, t in enumerate(s.times) if t >= time - p.dt_ave)
        s.ave = float(np.mean(s.rates[first:]))
    elapsed = time - s.time_init
    if feedback:
        s.df_dt = 0.0
        if elapsed > p.dt_init and s.times[-1] - s.times[0] >= p.dt_ave:
            if p.method == "exp":
                s.df_dt = LEAST_RATE + math.exp(-min(abs(s.ave) / p.tol, 10.0)) * (p.df_dt_max - LEAST_RATE)
            else:
                new = controlled_rate(p, s.errors, s.steps)
                s.errors = [max(abs(s.ave), LEAST_ERROR), *s.errors[:2]]
                s.steps = [abs(new), *s.steps[:2]]
                s.df_dt = s.steps[0]
            s.df_dt *= p.df_sign
            if abs(s.df_dt) < DIVIDE_TOLERANCE:
                s.df_dt = 0.0
        if dt > 0:
            s.f_mean = min(max(s.f_mean + s.df_dt * dt, p.f_min), p.f_max)
    else:
        s.f_mean = open_value(p, elapsed)
        s.df_dt = (s.f_mean - before) / dt if dt > 0 else 0.0
    if p.with_kill and abs(s.ave) < p.tol and ((p.df_sign > 0 and s.f_mean >= p.f_max) or (p.df_sign < 0 and s.f_mean <= p.f_min)):
        s.kill = True
    s.time_prev, s.var_prev = time, var
    return s.f_mean + (noise * p.sigma if dt > 0 and p.sigma > 0 else 0.0)


_OUT = "key string, time double, f double, f_mean double, df_dt double, dv_dt_ave double, kill boolean"


def _steps(p: Forcing, s: State, key: str, f: pd.DataFrame, seed: int) -> pd.DataFrame:
    rows = []
    for r in f.sort_values("time").itertuples(index=False):
        given = getattr(r, "dv_dt", None)
        given = None if given is None or math.isnan(given) else float(given)
        noise = np.random.default_rng([seed, abs(hash(round(float(r.time), 9))) % 2**32]).normal() if p.sigma > 0 else 0.0
        value = advance(p, s, float(r.time), float(r.var), given, noise)
        rows.append((key, float(r.time), value, s.f_mean, s.df_dt, s.ave, s.kill))
    return pd.DataFrame(rows, columns=["key", "time", "f", "f_mean", "df_dt", "dv_dt_ave", "kill"])


def run_batch(df: DataFrame, p: Forcing, seed: int = 0, restart: DataFrame | None = None) -> DataFrame:
    """(key, time, var[, dv_dt]) in time order through each key's generator. A key's steps depend on each other.

    restart: (key, state) of final_states() of the rows before, from which each key goes on.
    """
    if restart is None:
        return df.groupBy("key").applyInPandas(lambda k, f: _steps(p, State(), k[0], f, seed), _OUT)

    def resumed(k, f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return _steps(p, State.loads(s["state"].iloc[0]) if len(s) else State(), k[0], f, seed)

    return df.groupBy("key").cogroup(restart.groupBy("key")).applyInPandas(resumed, _OUT)


def final_states(df: DataFrame, p: Forcing, seed: int = 0, restart: DataFrame | None = None) -> DataFrame:
    """(key, state): what each key's generator holds after its rows, to be stored and given to run_batch() as restart."""

    def last(k, f: pd.DataFrame, s: pd.DataFrame | None = None) -> pd.DataFrame:
        state = State.loads(s["state"].iloc[0]) if s is not None and len(s) else State()
        if len(f):
            _steps(p, state, k[0], f, seed)
        return pd.DataFrame({"key": [k[0]], "state": [state.dumps()]})

    if restart is None:
        return df.groupBy("key").applyInPandas(lambda k, f: last(k, f), "key string, state string")
    return df.groupBy("key").cogroup(restart.groupBy("key")).applyInPandas(last, "key string, state string")


def run_stream(df: DataFrame, p: Forcing, seed: int = 0) -> DataFrame:
    """As run_batch() over a stream; rows of a micro-batch are taken in time order, the state is checkpointed by Spark."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = State.loads(state.get[0]) if state.exists else State()
        yield _steps(p, s, key[0], pd.concat(list(frames)), seed)
        state.update((s.dumps(),))

    return df.groupBy("key").applyInPandasWithState(step, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)
