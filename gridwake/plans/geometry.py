"""Geometry functions over the driver tables: customers and suppliers placed on the globe."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridwake.functions import geo
from gridwake.functions.roots import newton, secant
from gridwake.model import planet
from gridwake.plans.registry import query, rounded, table

_P = "p as (select c_custkey as id, (c_custkey * 37 % 360 - 180)::double as lon, (c_custkey * 13 % 170 - 85)::double as lat from customer)"
_LONN, _LATN = "(id * 11 % 360 - 180)::double", "(id * 7 % 170 - 85)::double"


def placed(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("lon"), (k * 13 % 170 - 85).cast("double").alias("lat"))
    return p.withColumns({"lonn": (F.col("id") * 11 % 360 - 180).cast("double"), "latn": (F.col("id") * 7 % 170 - 85).cast("double")})


@query(f"with {_P} select id, round(sqrt(({_LONN} - lon) ** 2 + ({_LATN} - lat) ** 2), 6) as dist from p")
def cartesian_dist(spark, d):
    return placed(spark, d).select("id", rounded(geo.cartesian_distance(F.col("lon"), F.col("lat"), F.col("lonn"), F.col("latn"))).alias("dist"))


@query(f"""with {_P} select id, round(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians({_LATN})) + cos(radians(lat)) * cos(radians({_LATN})) * cos(radians(lon - {_LONN}))))) * 6378137.0, 1) as dist from p""")
def spherical_dist(spark, d):
    return placed(spark, d).select("id", rounded(geo.spherical_distance(F.col("lon"), F.col("lat"), F.col("lonn"), F.col("latn")), 1).alias("dist"))


@query(f"with {_P} select id, round(cos(radians(lat)) * cos(radians(lon)), 9) + 0.0 as x, round(cos(radians(lat)) * sin(radians(lon)), 9) + 0.0 as y, round(sin(radians(lat)), 9) + 0.0 as z from p")
def sphere_embed(spark, d):
    x, y, z = geo.sphere_embed(F.col("lon"), F.col("lat"))
    return placed(spark, d).select("id", rounded(x, 9).alias("x"), rounded(y, 9).alias("y"), rounded(z, 9).alias("z"))


@query(f"""with {_P}, q as (select id, lat, {_LATN} as latn, (({_LONN} - lon + 180) % 360 + 360) % 360 - 180 as d from p)
select id, (case when d > 0 and latn > lat then 1 when d <= 0 and latn > lat then 2 when d <= 0 and latn <= lat then 3 else 4 end)::integer as quadrant from q""")
def quadrant_latlon(spark, d):
    return placed(spark, d).select("id", geo.quadrant_latlon(F.col("lon"), F.col("lat"), F.col("lonn"), F.col("latn")).alias("quadrant"))


#: Whole-degree places all over the globe: a centre between whole degrees has no place at its antipode.
@query(f"""with {_P}, t as (select id, lat, radians(lon + 40.5) as l, radians(lat) as p from p), k as (select id, l, p, (1 + cos(radians(10.0))) / (1 + cos(p) * cos(radians(71.5)) * cos(l) + sin(p) * sin(radians(71.5))) as t from t)
select id, round(6371.0 * cos(p) * sin(l) * t, 1) + 0.0 as x, round(6371.0 * (sin(p) * cos(radians(71.5)) - cos(p) * sin(radians(71.5)) * cos(l)) * t, 1) + 0.0 as y from k""")
def project_stereographic(spark, d):
    x, y = geo.stereographic(F.col("lon"), F.col("lat"), -40.5, 71.5, 10.0, 6371000.0)
    return placed(spark, d).select("id", rounded(x / 1000, 1).alias("x"), rounded(y / 1000, 1).alias("y"))


@query(f"with {_P} select id, round(case when lon >= 180 then lon - 360 else lon end, 6) + 0.0 as lon, round(lat, 6) + 0.0 as lat from p")
def inverse_stereographic(spark, d):
    x, y = geo.stereographic(F.col("lon"), F.col("lat"), -40.5, 71.5, 10.0, 6371000.0)
    p = placed(spark, d).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.inverse_stereographic(F.col("x"), F.col("y"), -40.5, 71.5, 10.0, 6371000.0)
    lon = F.when(F.round(lon, 6) >= 180, lon - 360).otherwise(lon)
    return p.select("id", rounded(lon).alias("lon"), rounded(lat).alias("lat"))


@query(f"with {_P} select id, round(case when lon >= 180 then lon - 360 else lon end, 6) + 0.0 as lon, round(lat, 6) + 0.0 as lat from p")
def equal_area_round_trip(spark, d):
    x, y = geo.equal_area(F.col("lon"), F.col("lat"), 10.5, 52.5, 6371000.0)
    p = placed(spark, d).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.inverse_equal_area(F.col("x"), F.col("y"), 10.5, 52.5, 6371000.0)
    lon = F.when(F.round(lon, 6) >= 180, lon - 360).otherwise(lon)
    return p.select("id", rounded(lon).alias("lon"), rounded(lat).alias("lat"))


@query(f"with {_P} select id, round(lat, 6) + 0.0 as lat, round(cos(radians(lon)), 6) + 0.0 as coslon from p")
def rotated_pole_round_trip(spark, d):
    lon, lat = geo.rotate_pole(F.col("lon"), F.col("lat"), 150.0, 30.0)
    p = placed(spark, d).select("id", lon.alias("a"), lat.alias("b"))
    lon, lat = geo.unrotate_pole(F.col("a"), F.col("b"), 150.0, 30.0)
    return p.select("id", rounded(lat).alias("lat"), rounded(F.cos(F.radians(lon))).alias("coslon"))


def _round_trip(kind: str, lon0: float, lat0: float, alpha: float):
    def f(spark, d):
        def run(frames):
            for p in frames:
                x, y = geo.ellipsoid_project(kind, p["lon"], p["lat"], lon0, lat0, alpha)
                lon, lat = geo.ellipsoid_project(kind, x, y, lon0, lat0, alpha, inverse=True)
                yield pd.DataFrame({"id": p["id"], "lat": lat, "coslon": np.cos(np.radians(lon))})

        out = placed(spark, d).select("id", "lon", "lat").mapInPandas(run, "id long, lat double, coslon double")
        return out.select("id", rounded("lat").alias("lat"), rounded("coslon").alias("coslon"))

    f.__name__ = f"ellipsoid_{kind}"
    return f


for _kind, _lat0, _alpha in (("stereographic", 71.5, 10.0), ("polar_stereographic", 90.0, 19.0), ("equal_area", 52.5, 0.0)):
    query(f"with {_P} select id, round(lat, 6) + 0.0 as lat, round(cos(radians(lon)), 6) + 0.0 as coslon from p")(_round_trip(_kind, -40.5, _lat0, _alpha))


#: Vincenty's inverse formulas, 100 rounds for every pair; no pair of the whole-degree places is too near an antipode for it.
_F, _B = 1 / 298.257223563, 6378137.0 * (1 - 1 / 298.257223563)
_INVERSE = f"""with recursive {_P}, q as (select id, radians((({_LONN} - lon) + 540) % 360 - 180) as l, atan({1 - _F!r} * tan(radians(lat))) as u, atan({1 - _F!r} * tan(radians({_LATN}))) as v from p),
r as (select id, 0 as k, l as lam from q union all
  select id, k + 1, l + (1 - c) * {_F!r} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))) from (
    select *, {_F!r} / 16 * (1 - sa * sa) * (4 + {_F!r} * (4 - 3 * (1 - sa * sa))) as c, case when 1 - sa * sa > 1e-14 then cs - 2 * sin(u) * sin(v) / (1 - sa * sa) else 0 end as cm, atan2(ss, cs) as sg from (
      select *, case when ss = 0 then 0 else cos(u) * cos(v) * sin(lam) / ss end as sa from (
        select r.id, r.k, r.lam, q.l, q.u, q.v, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) as ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) as cs from r join q using (id) where r.k < 100)))),
e as (select id, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) as ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) as cs, u, v, lam from r join q using (id) where k = 100),
f as (select *, atan2(ss, cs) as sg, case when ss = 0 then 0 else cos(u) * cos(v) * sin(lam) / ss end as sa from e),
g as (select *, (1 - sa * sa) * {(6378137.0**2 - _B**2) / _B**2!r} as w, case when 1 - sa * sa > 1e-14 then cs - 2 * sin(u) * sin(v) / (1 - sa * sa) else 0 end as cm from f),
h as (select *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) as aa, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) as bb from g)
select id, round({_B!r} * aa * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) + 0.0 as dist from h"""


@query(_INVERSE)
def planet_distance(spark, d):
    return placed(spark, d).select("id", rounded(geo.planet_distance(planet())("lon", "lat", "lonn", "latn"), 3).alias("dist"))


_POLY = [(0.0, 0.0), (40.0, -10.0), (60.0, 30.0), (20.0, 20.0), (-10.0, 40.0)]


_SIDES = ", ".join(f"({a!r}, {b!r}, {c!r}, {e!r})" for (a, b), (c, e) in zip(_POLY, _POLY[1:] + _POLY[:1], strict=True))


@query(f"select n_nationkey, round((select abs(sum(x1 * y2 - x2 * y1)) / 2 from (values {_SIDES}) s(x1, y1, x2, y2)) * n_nationkey * n_nationkey, 6) as area from nation")
def polygon_area(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", *[F.array(*[F.lit(p[c]) * F.col("n_nationkey") for p in _POLY]).alias("xy"[c]) for c in (0, 1)])
    return n.select("n_nationkey", rounded(geo.polygon_area("x", "y")).alias("area"))


@query(f"""with {_P}, s as (select * from (values {_SIDES}) s(x1, y1, x2, y2)) select id, sum(case when (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1 as inside from p, s group by id""")
def point_in_polygon(spark, d):
    p = placed(spark, d).select("id", "lon", "lat", *[F.array(*[F.lit(v[c]) for v in _POLY]).alias(f"p{'xy'[c]}") for c in (0, 1)])
    return p.select("id", geo.point_in_polygon("lon", "lat", "px", "py").alias("inside"))


@query(f"with {_P} select id, round(greatest(0, least(lon + 20, 30) - greatest(lon, 0)) * greatest(0, least(lat + 20, 25) - greatest(lat, 5)), 6) as area from p")
def polygon_clip(spark, d):
    window = np.array([(0.0, 5.0), (30.0, 5.0), (30.0, 25.0), (0.0, 25.0)])

    @F.pandas_udf("double")
    def shared(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([geo.plane_area(geo.clip(np.array([(x, y), (x + 20, y), (x + 20, y + 20), (x, y + 20)]), window)) for x, y in zip(lon, lat, strict=True)])

    return placed(spark, d).select("id", rounded(shared("lon", "lat")).alias("area"))


@query("""with t(i, lat, weight) as (values (1, 59.4444, 0.347855), (2, 19.8757, 0.652145), (3, -19.8757, 0.652145), (4, -59.4444, 0.347855))
select i, lat::double as lat, weight::double as weight, round(avg(p_retailprice), 6) as value from t join part on i = p_partkey % 4 + 1 group by all""")
def gaussian_latitudes(spark, d):
    lat, weight = geo.gaussian_latitudes(4)
    t = spark.createDataFrame([(i + 1, float(v), float(w)) for i, (v, w) in enumerate(zip(lat, weight, strict=True))], "i int, lat double, weight double")
    rows = table(spark, d, "part").groupBy((F.col("p_partkey") % 4 + 1).cast("int").alias("i")).agg(rounded(F.avg("p_retailprice")).alias("value"))
    return t.join(rows, "i").select("i", rounded("lat", 4).alias("lat"), rounded("weight").alias("weight"), "value")


@query("select p_partkey, round(sqrt(p_retailprice), 6) as root from part")
def newton_roots(spark, d):
    @F.pandas_udf("double")
    def root(v: pd.Series) -> pd.Series:
        return pd.Series([newton(lambda x, a=a: x * x - a, lambda x: 2 * x, a / 2 + 0.5)[0] for a in v])

    return table(spark, d, "part").select("p_partkey", rounded(root("p_retailprice")).alias("root"))


@query("select p_partkey, round(ln(p_retailprice), 6) as root from part")
def secant_roots(spark, d):
    @F.pandas_udf("double")
    def root(v: pd.Series) -> pd.Series:
        return pd.Series([secant(lambda x, a=a: math.exp(x) - a, 6.0, 7.0, tolerance=1e-7)[0] for a in v])

    return table(spark, d, "part").select("p_partkey", rounded(root("p_retailprice")).alias("root"))
