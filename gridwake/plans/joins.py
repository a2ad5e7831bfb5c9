"""Regridding, spatial joins and overlaps over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridwake.model import Axis, CoordSystem, Grid, planet
from gridwake.operators import grids, links, neighbours, remap, solvers, spherical
from gridwake.plans.registry import query, rounded, table

#: Links from parts (sources) to suppliers (targets) weighted by quantity; the field is the retail price, missing for every 7th part.
_LINKS = "l as (select l_suppkey as dst, l_partkey as src, sum(l_quantity) as w from lineitem group by 1, 2)"
_FIELD = "f as (select p_partkey as src, case when p_partkey % 7 <> 0 then p_retailprice end as v, p_size as c from part)"


def part_links(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("src")).agg(F.sum("l_quantity").alias("w"))


def part_field(spark, d, value="p_retailprice"):
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.when(F.col("p_partkey") % 7 != 0, F.col(value)).alias("value"))


@query(f"with {_LINKS}, {_FIELD} select dst, round(sum(w * v) / sum(w), 6) as value from l join f using (src) where v is not null group by 1")
def regrid_mean(spark, d):
    return links.apply(part_links(spark, d), part_field(spark, d)).select("dst", rounded("value").alias("value"))


@query(f"""with {_LINKS}, {_FIELD}, t as (select dst, c, sum(w) as t, min(src) as p from l join f using (src) where src % 7 <> 0 group by 1, 2)
select dst, c as value from (select *, row_number() over (partition by dst order by t desc, p) as r from t) where r = 1""")
def regrid_mode(spark, d):
    return links.apply(part_links(spark, d), part_field(spark, d, "p_size"), "count").select("dst", "value")


@query(f"""with {_LINKS}, {_FIELD}, j as (select dst, w, v from l join f using (src) where v is not null), m as (select dst, sum(w * v) / sum(w) as m from j group by 1)
select dst, round(sqrt(sum(w * (v - m) * (v - m)) / sum(w)), 6) as value from j join m using (dst) group by 1""")
def regrid_stdev(spark, d):
    return links.apply(part_links(spark, d), part_field(spark, d), "stdev").select("dst", rounded("value").alias("value"))


@query(f"with {_LINKS}, {_FIELD}, r as (select dst, sum(w * v) / sum(w) as v from l join f using (src) where v is not null and dst % 3 <> 0 group by 1) select s_suppkey as dst, round(coalesce(v, s_acctbal), 6) as value from supplier left join r on dst = s_suppkey")
def regrid_missing(spark, d):
    got = links.apply(part_links(spark, d).where("dst % 3 <> 0"), part_field(spark, d))
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_acctbal").alias("old"))
    return links.on_targets(got, targets, old="old").select("dst", rounded("value").alias("value"))


@query("""with l as (select l_suppkey as dst, l_partkey as src, sum(l_quantity) as w from lineitem group by 1, 2), f as (select p_partkey as src, k, p_retailprice * k as v from part, range(1, 4) r(k))
select dst, k::integer as k, round(sum(w * v) / sum(w), 6) as value from l join f using (src) group by 1, 2""")
def regrid_levels(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "p_retailprice")
    f = f.select("src", "k", (F.col("p_retailprice") * F.col("k")).alias("value"))
    return links.apply(part_links(spark, d), f, keys=["k"]).select("dst", "k", rounded("value").alias("value"))


@query(f"with {_LINKS} select dst, src, round(w, 6) as w from (select *, sum(w) over (partition by dst) as t from l) where w >= 0.002 * t")
def link_prune(spark, d):
    return links.prune(part_links(spark, d), 0.002).select("dst", "src", rounded("w").alias("w"))


#: Targets: all suppliers at (balance, key); sources: all customers likewise, in thousands.
_POINTS = """t as (select s_suppkey as dst, s_acctbal / 1000.0 as x, (s_suppkey % 10)::double as y from supplier),
s as (select c_custkey as src, c_acctbal / 1000.0 as xn, (c_custkey % 10 + 0.5)::double as yn, c_acctbal as v from customer)"""
_DIST = "sqrt((x - xn) * (x - xn) + (y - yn) * (y - yn))"


def points(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), (F.col("s_acctbal") / 1000.0).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") % 10 + 0.5).cast("double").alias("y"), F.col("c_acctbal").alias("value"))
    return t, s


_KNN = f"k as (select * from (select dst, x, y, src, xn, yn, v, {_DIST} as dist, row_number() over (partition by dst order by {_DIST}, src) as r from t, s) where r <= 6)"


def near(spark, d, k=6):
    t, s = points(spark, d)
    return links.nearest(t, s.select("src", "x", "y"), k), t, s


@query(f"with {_POINTS}, {_KNN} select dst, src, round(dist, 9) as dist, r::integer as rank from k")
def knn_join(spark, d):
    return near(spark, d)[0].select("dst", "src", rounded("dist", 9).alias("dist"), "rank")


_UNIT = "cos(radians(lat)) * cos(radians(lon)) as x{0}, cos(radians(lat)) * sin(radians(lon)) as y{0}, sin(radians(lat)) as z{0}"
_SPHERE = f"""t as (select s_suppkey as dst, {_UNIT.format('t')} from (select *, ((s_suppkey * 37) % 360 - 180)::double as lon, greatest(-90.0, least(90.0, s_acctbal / 50.0 - 90.0)) as lat from supplier)),
s as (select c_custkey as src, {_UNIT.format('s')} from (select *, ((c_custkey * 11) % 360 - 180)::double + (c_custkey % 7) / 10.0 as lon, greatest(-90.0, least(90.0, c_acctbal / 50.0 - 90.0)) as lat from customer)),
p as (select dst, src, sqrt((xs - xt) * (xs - xt) + (ys - yt) * (ys - yt) + (zs - zt) * (zs - zt)) as chord from t, s)"""


@query(f"with {_SPHERE}, r as (select *, row_number() over (partition by dst order by round(chord, 9), src) as n from p) select dst, n::integer as rank, round(chord, 9) as chord from r where n <= 4")
def knn_sphere(spark, d):
    lat = lambda c: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c) / 50.0 - 90.0)).alias("lat")
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), ((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"), lat("s_acctbal"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (((F.col("c_custkey") * 11) % 360 - 180).cast("double") + (F.col("c_custkey") % 7) / 10.0).alias("lon"), lat("c_acctbal"))
    return neighbours.nearest_on_sphere(t, s, 4).select("dst", "rank", rounded("chord", 9).alias("chord"))


@query(f"with {_POINTS} select dst, src, round({_DIST}, 9) as dist from t, s where {_DIST} <= 1.25")
def radius_join(spark, d):
    t, s = points(spark, d)
    return links.radius_pairs(t, s.select("src", "x", "y"), 1.25, digits=9)


@query(f"with {_POINTS}, {_KNN} select dst, src, round(dist, 9) as dist from k where r = 1")
def which_nearest(spark, d):
    return near(spark, d, 1)[0].select("dst", "src", rounded("dist", 9).alias("dist"))


def _distance_links(spark, d):
    n, t, s = near(spark, d)
    full = n.join(t, "dst").join(s.select("src", F.col("x").alias("xn"), F.col("y").alias("yn")), "src")
    return full.withColumn("quadrant", links.quadrant(F.col("x"), F.col("y"), F.col("xn"), F.col("yn"))), s.select("src", "value")


_Q = "case when xn > x and yn >= y then 1 when xn <= x and yn > y then 2 when xn < x and yn <= y then 3 else 4 end"


@query(f"with {_POINTS}, {_KNN} select dst, round(min_by(v, dist), 6) as value from k group by 1")
def kernel_nn(spark, d):
    l, f = _distance_links(spark, d)
    return links.apply(l, f, "nn").select("dst", rounded("value").alias("value"))


@query(f"with {_POINTS}, {_KNN} select dst, round(sum(v / pow(greatest(dist, 1e-12), 2)) / sum(1 / pow(greatest(dist, 1e-12), 2)), 6) as value from k group by 1")
def kernel_shepard(spark, d):
    l, f = _distance_links(spark, d)
    return links.apply(l, f, "shepard").select("dst", rounded("value").alias("value"))


@query(f"""with {_POINTS}, {_KNN}, q as (select *, row_number() over (partition by dst, {_Q} order by dist, src) as n from k)
select dst, round(sum(v / pow(greatest(dist, 1e-12), 2)) / sum(1 / pow(greatest(dist, 1e-12), 2)), 6) as value from q where n = 1 group by 1""")
def kernel_quadrant(spark, d):
    l, f = _distance_links(spark, d)
    return links.apply(l, f, "quadrant").select("dst", rounded("value").alias("value"))


@query(f"""with {_POINTS}, {_KNN}, q as (select *, {_Q} as q, row_number() over (partition by dst, {_Q} order by dist, src) as n from k),
p as (select dst, any_value(x) as x, any_value(y) as y, count(*) as c, {", ".join(f"max(xn) filter (q = {i}) as x{i}, max(yn) filter (q = {i}) as y{i}, max(v) filter (q = {i}) as v{i}" for i in (1, 2, 3, 4))},
  sum(v / pow(greatest(dist, 1e-12), 2)) / sum(1 / pow(greatest(dist, 1e-12), 2)) as s from q where n = 1 group by 1),
m as (select *, (y2 + y1) / 2 as t, (y3 + y4) / 2 as l from p),
a as (select *, sqrt((x - x2) ** 2 + (t - y2) ** 2) / nullif(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), 0) as a1, sqrt((x - x3) ** 2 + (l - y3) ** 2) / nullif(sqrt((x4 - x3) ** 2 + (y4 - y3) ** 2), 0) as a2, abs(y - l) / nullif(abs(t - l), 0) as a3 from m)
select dst, round(case when c = 4 then (v3 + coalesce(a2, 0) * (v4 - v3)) + coalesce(a3, 0) * ((v2 + coalesce(a1, 0) * (v1 - v2)) - (v3 + coalesce(a2, 0) * (v4 - v3))) else s end, 6) as value from a""")
def kernel_bilinear(spark, d):
    l, f = _distance_links(spark, d)
    return links.apply(l, f, "bilinear").select("dst", rounded("value").alias("value"))


@query(f"with {_POINTS}, {_KNN}, w as (select dst, src, 1 / pow(greatest(dist, 1e-12), 2) as w from k) select dst, src, round(w / sum(w) over (partition by dst), 9) as w from w")
def bake_weights(spark, d):
    l, _ = _distance_links(spark, d)
    return links.bake(l).select("dst", "src", rounded("w", 9).alias("w"))


_AXES = "a as (select p_partkey as dst, (p_partkey - 1) * 100.0 as lo, p_partkey * 100.0 as hi from part), b as (select c_custkey as src, (c_custkey - 1) * 37.5 - 20 as lo, c_custkey * 37.5 - 20 as hi from customer)"


@query(f"with {_AXES} select dst, src, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 9) as w from a join b on a.lo < b.hi and b.lo < a.hi")
def conservative_1d(spark, d):
    """Intervals of 100 numbered by parts against intervals of 37.5 numbered by customers."""
    side = lambda name, key, out, size, first: table(spark, d, name).select(F.col(key).alias(out), ((F.col(key) - 1) * size + first).alias("lo"), (F.col(key) * size + first).alias("hi"))
    return grids.overlap_pairs(side("part", "p_partkey", "dst", 100.0, 0.0), side("customer", "c_custkey", "src", 37.5, -20.0), 100.0).select("dst", "src", rounded("w", 9).alias("w"))


@query("""with n as (select max(p_partkey) // 20 + 1 as nj from part), p as (select p_partkey % 20 + 1 as i, p_partkey // 20 + 1 as j, p_retailprice as v from part),
r as (select unnest(range(1, nj + 1)) as si, nj from n), q as (select unnest(range(1, ceil(nj * 2.5)::bigint + 1)) as i from n),
y as (select q.i, r.si, least(q.i * 40.0, r.si * 100.0) - greatest((q.i - 1) * 40.0, (r.si - 1) * 100.0) as w from q join r on q.i * 40.0 > (r.si - 1) * 100.0 and (q.i - 1) * 40.0 < r.si * 100.0),
x as (select a.i, b.i as si, least(a.i * 40.0, b.i * 100.0) - greatest((a.i - 1) * 40.0, (b.i - 1) * 100.0) as w from range(1, 51) a(i) join range(1, 21) b(i) on a.i * 40.0 > (b.i - 1) * 100.0 and (a.i - 1) * 40.0 < b.i * 100.0)
select ((y.i - 1) * 50 + x.i)::bigint as dst, round(sum(case when v is not null then x.w * y.w * v end) / sum(case when v is not null then x.w * y.w end), 6) as value, round(sum(x.w * y.w), 6) as area
from x cross join y left join p on p.i = x.si and p.j = y.si group by 1""")
def conservative_planar(spark, d):
    """The parts' prices as a field of cells of 100 km, on cells of 40 km."""
    flat, rows = CoordSystem("cartesian", "km"), table(spark, d, "part").agg(F.floor(F.max("p_partkey") / 20) + 1).first()[0]
    source, target = Grid("coarse", Axis(50.0, 100.0, 20), Axis(50.0, 100.0, rows), flat), Grid("fine", Axis(20.0, 40.0, 50), Axis(20.0, 40.0, math.ceil(rows * 2.5)), flat)
    l = grids.conservative_links(spark, source, target)
    out = l.groupBy("dst").agg(F.sum("w").alias("area")).join(links.apply(l, table(spark, d, "part").select((F.col("p_partkey") + 1).alias("src"), F.col("p_retailprice").alias("value"))), "dst", "left")
    return out.select("dst", rounded("value").alias("value"), rounded("area").alias("area"))


@query("""with x as (select a.i, b.i as si, max(least(a.i * 5.0, b.i * 10.0 + k) - greatest((a.i - 1) * 5.0, (b.i - 1) * 10.0 + k)) as w from range(1, 73) a(i), range(1, 37) b(i), (values (-360), (0), (360)) t(k)
  where a.i * 5.0 > (b.i - 1) * 10.0 + k and (a.i - 1) * 5.0 < b.i * 10.0 + k group by 1, 2),
y as (select a.i, b.i as si, sin(radians(least(-90 + a.i * 5.0, -90 + b.i * 10.0))) - sin(radians(greatest(-90 + (a.i - 1) * 5.0, -90 + (b.i - 1) * 10.0))) as w from range(1, 37) a(i), range(1, 19) b(i)
  where -90 + a.i * 5.0 > -90 + (b.i - 1) * 10.0 and -90 + (a.i - 1) * 5.0 < -90 + b.i * 10.0),
f as (select c_custkey % 648 + 1 as src, c_custkey // 648 as k, c_acctbal as v from customer)
select ((y.i - 1) * 72 + x.i)::bigint as dst, k, round(sum(x.w * y.w * v) / sum(x.w * y.w), 6) as value from x, y, f where y.w > 1e-12 and src = (y.si - 1) * 36 + x.si group by 1, 2""")
def conservative_latlon(spark, d):
    """The customers' balances as slices of fields of 10 degrees, on cells of 5 degrees."""
    source = Grid("10", Axis(5.0, 10.0, 36), Axis(-85.0, 10.0, 18))
    target = Grid("5", Axis(2.5, 5.0, 72), Axis(-87.5, 5.0, 36))
    field = table(spark, d, "customer").select((F.col("c_custkey") % 648 + 1).alias("src"), F.floor(F.col("c_custkey") / 648).alias("k"), F.col("c_acctbal").alias("value"))
    return links.apply(grids.conservative_links(spark, source, target).where("w > 1e-12"), field, keys=["k"]).select("dst", "k", rounded("value").alias("value"))


@query("""with t as (select c_custkey as dst, c_acctbal * 0.09 as x, (c_custkey % 100)::double as y from customer),
a as (select dst, x, y, case when x <= 0 then 1 when x >= 900 then 10 else floor(x / 100) + 1 end as i0, case when x <= 0 then 1 when x >= 900 then 10 else floor(x / 100) + 2 end as i1, case when x <= 0 or x >= 900 then 0 else x / 100 - floor(x / 100) end as u,
  case when y <= 0 then 1 when y >= 90 then 10 else floor(y / 10) + 1 end as j0, case when y <= 0 then 1 when y >= 90 then 10 else floor(y / 10) + 2 end as j1, case when y <= 0 or y >= 90 then 0 else y / 10 - floor(y / 10) end as v from t where x between -100 and 1000 and y between -10 and 100),
f as (select i, j, 3.0 * i + 2.0 * j as v from range(1, 11) r(i), range(1, 11) s(j))
select dst, round((1 - u) * (1 - a.v) * (3 * i0 + 2 * j0) + u * (1 - a.v) * (3 * i1 + 2 * j0) + (1 - u) * a.v * (3 * i0 + 2 * j1) + u * a.v * (3 * i1 + 2 * j1), 6) as value from a""")
def structured_locate_bilinear(spark, d):
    g = Grid("source", Axis(0.0, 100.0, 10), Axis(0.0, 10.0, 10), CoordSystem("cartesian", "km"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_acctbal") * 0.09).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    field = grids.cells(spark, g).select(F.col("cell").alias("src"), (3.0 * F.col("i") + 2.0 * F.col("j")).alias("value"))
    return links.apply(grids.bilinear_links(t, g), field).select("dst", rounded("value").alias("value"))


@query("""with g as (select ((j - 1) * 12 + i)::bigint as cell, i::bigint as i, j::bigint as j, (i - 1) * 30.0 as x, 75.0 - (j - 1) * 25 as y, (case when j in (1, 7) then 1 else 0 end)::integer as border, case when (i - 1) * 30 > 180 then (i - 1) * 30.0 - 360 else (i - 1) * 30.0 end as lon from range(1, 13) r(i), range(1, 8) s(j))
select c_custkey as id, g.* from customer join g on cell = c_custkey % 84 + 1""")
def grid_cells(spark, d):
    """Each customer with a cell of a grid of the world."""
    g = Grid("world", Axis(0.0, 30.0, 12), Axis(75.0, -25.0, 7))
    cells = grids.cells(spark, g).select("cell", "i", "j", "x", "y", "border", grids.lon180(F.col("x")).alias("lon"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 84 + 1).alias("cell")).join(cells, "cell")


@query("select c_nationkey, round(sum(case when c_acctbal > 0 then c_custkey * c_acctbal end) / sum(case when c_acctbal > 0 then c_custkey end), 6) as value from customer group by 1")
def weighted_ave(spark, d):
    return links.masked_average(table(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal"), F.col("c_custkey"), F.col("c_acctbal") > 0).select("c_nationkey", rounded("value").alias("value"))


@query("""with t as (select c_nationkey, c_mktsegment, sum(c_acctbal) as t, min(c_custkey) as p from customer group by 1, 2) select c_nationkey, c_mktsegment as value from (select *, row_number() over (partition by c_nationkey order by t desc, p) as r from t) where r = 1""")
def maxcount(spark, d):
    return links.most_frequent(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "c_custkey").select("c_nationkey", F.col("c_mktsegment").alias("value"))


@query("select c_custkey as pt, round(c_acctbal, 6) as value from customer where c_acctbal > 5000")
def points_pack(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), rounded("c_acctbal").alias("value"))
    return grids.to_points(c, F.col("value") > 5000)


@query("with a as (select l_suppkey as i, l_partkey as j, sum(l_quantity) as a from lineitem group by 1, 2) select i, round(sum(a * p_retailprice), 2) as v from a join part on j = p_partkey group by 1")
def sparse_product(spark, d):
    a = part_links(spark, d).withColumnsRenamed({"dst": "i", "src": "j", "w": "a"})
    x = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    return solvers.product(a, x).select("i", rounded("v", 2).alias("v"))


def _hundreds(spark, d):
    """The parts' prices as slices of a field of 10 x 10 cells."""
    return table(spark, d, "part").select((F.col("p_partkey") % 100 + 1).alias("src"), F.floor(F.col("p_partkey") / 100).alias("k"), F.col("p_retailprice").alias("value"))


@query("""with x as (select a.i, b.i as si, least(a.i * 70.0, b.i * 100.0) - greatest((a.i - 1) * 70.0, (b.i - 1) * 100.0) as w from range(1, 15) a(i) join range(1, 11) b(i) on a.i * 70.0 > (b.i - 1) * 100.0 and (a.i - 1) * 70.0 < b.i * 100.0),
f as (select p_partkey % 100 + 1 as src, p_partkey // 100 as k, p_retailprice as v from part)
select ((y.i - 1) * 14 + x.i)::bigint as dst, k, round(sum(x.w * y.w * v) / sum(x.w * y.w), 6) as value from x, x y, f where src = (y.si - 1) * 10 + x.si group by 1, 2""")
def conservative_clipped(spark, d):
    flat = CoordSystem("cartesian", "km")
    source, target = Grid("a", Axis(50.0, 100.0, 10), Axis(50.0, 100.0, 10), flat), Grid("b", Axis(35.0, 70.0, 14), Axis(35.0, 70.0, 14), flat)
    s, t = (remap.rectangles(grids.cells(spark, g), g.x.dx, g.y.dx, k) for g, k in ((source, "src"), (target, "dst")))
    return links.apply(remap.clipped_links(t, s, 100.0).where("w > 1e-9"), _hundreds(spark, d), keys=["k"]).select("dst", "k", rounded("value").alias("value"))


def _triangle(a: int, b: int, c: int) -> str:
    """SQL of a spherical triangle's area from corners x, y, z by number."""
    dot = lambda p, q: f"(x{p} * x{q} + y{p} * y{q} + z{p} * z{q})"
    det = f"(x{a} * (y{b} * z{c} - z{b} * y{c}) + y{a} * (z{b} * x{c} - x{b} * z{c}) + z{a} * (x{b} * y{c} - y{b} * x{c}))"
    return f"2 * atan2({det}, 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"


_CORNERS = ", ".join(f"cos(radians(lat {v} b)) * cos(radians(lon {u} a)) as x{k}, cos(radians(lat {v} b)) * sin(radians(lon {u} a)) as y{k}, sin(radians(lat {v} b)) as z{k}" for k, (u, v) in enumerate((("-", "-"), ("+", "-"), ("+", "+"), ("-", "+")), 1))


@query(f"""with c as (select c_custkey as dst, ((c_custkey * 11) % 360 - 180)::double as lon, greatest(-85.0, least(85.0, c_acctbal / 60.0 - 75.0)) as lat, 2.0 + c_custkey % 5 as a, 1.0 + c_custkey % 3 as b from customer),
p as (select dst, {_CORNERS} from c) select dst, round({_triangle(1, 2, 3)} + {_triangle(1, 3, 4)}, 9) as area from p""")
def sphere_overlap(spark, d):
    """What cells about customers share with the nations' 50 triangles between meridians, equator and poles, which tile the sphere."""
    lon, lat, a, b = ((F.col("c_custkey") * 11) % 360 - 180).cast("double"), F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("c_acctbal") / 60.0 - 75.0)), 2.0 + F.col("c_custkey") % 5, 1.0 + F.col("c_custkey") % 3
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("dst"), F.array(lon - a, lon + a, lon + a, lon - a).alias("lons"), F.array(lat - b, lat - b, lat + b, lat + b).alias("lats"))
    west = F.col("n_nationkey") * 14.4 - 180
    s = table(spark, d, "nation").withColumn("pole", F.explode(F.array(F.lit(90.0), F.lit(-90.0))))
    s = s.select(F.concat_ws(":", "n_nationkey", "pole").alias("src"), F.array(west, west + 14.4, west + 7.2).alias("lons"), F.array(F.lit(0.0), F.lit(0.0), F.col("pole")).alias("lats"))
    return spherical.overlaps(t, s).groupBy("dst").agg(rounded(F.sum("w"), 9).alias("area"))


#: A 2 degree grid of the world to 20 km cells of a stereographic plane over Greenland, on the sphere.
_R = 6370.997
_SEEN = f"""c as (select i, j, ((j - 1) * 180 + i)::bigint as src, (i - 1) * 2.0 as lon, -90 + (j - 1) * 2.0 as lat from range(1, 181) a(i), range(1, 92) b(j)),
o as (select c.*, k, radians(lon - 1 + 2 * case k // 8 when 0 then (k % 8) / 8 when 1 then 1 when 2 then 1 - (k % 8) / 8 else 0 end + 40) as l,
  radians(greatest(-90, least(90, lat - 1 + 2 * case k // 8 when 0 then 0 when 1 then (k % 8) / 8 when 2 then 1 else 1 - (k % 8) / 8 end))) as p from c, range(0, 32) r(k)
  where lat > 40),
v as (select *, {_R} * (1 + cos(radians(7.5))) / (1 + cos(p) * cos(radians(72)) * cos(l) + sin(p) * sin(radians(72))) as s from o),
w as (select src, k, s * cos(p) * sin(l) as x, s * (sin(p) * cos(radians(72)) - cos(p) * sin(radians(72)) * cos(l)) as y from v),
e as (select a.src, a.x, a.y, b.x as u, b.y as v, min(a.x) over s as lx, max(a.x) over s as hx, min(a.y) over s as ly, max(a.y) over s as hy from w a join w b on a.src = b.src and b.k = (a.k + 1) % 32 window s as (partition by a.src)),
t as (select ((j - 1) * 76 + i)::bigint as dst, -750.0 + (i - 1) * 20 - 10 as x0, -750.0 + (i - 1) * 20 + 10 as x1, -1500.0 + (j - 1) * 20 - 10 as y0, -1500.0 + (j - 1) * 20 + 10 as y1 from range(1, 77) a(i), range(1, 152) b(j)),
m as (select *, greatest(x0, least(x1, x)) as a, greatest(x0, least(x1, u)) as b from t join e on lx < x1 and hx > x0 and ly < y1 and hy > y0 where x <> u),
n as (select *, y + (v - y) * (a - x) / (u - x) as p, y + (v - y) * (b - x) / (u - x) as q from m where a <> b),
g as (select *, pow(greatest(y0, least(y1, p)) - y0, 2) / 2 + 20 * greatest(p - y1, 0) as gp, pow(greatest(y0, least(y1, q)) - y0, 2) / 2 + 20 * greatest(q - y1, 0) as gq from n),
k as (select dst, src, abs(sum((b - a) * case when abs(q - p) < 2e-8 then greatest(y0, least(y1, (p + q) / 2)) - y0 else (gq - gp) / (q - p) end)) as w from g group by 1, 2)"""


def _greenland(dx: float = 20.0, nx: int = 76, ny: int = 151):
    plane = CoordSystem("stereographic", "km", planet("Spherical Earth"), -40.0, 72.0, 7.5)
    return Grid("2deg", Axis(0.0, 2.0, 180), Axis(-90.0, 2.0, 91)), Grid("plane", Axis(-750.0, dx, nx), Axis(-1500.0, dx, ny), plane)


@query(f"with {_SEEN} select dst, round(sum(w), 4) as area, round(sum(w * (src % 180)) / sum(w), 4) as value from k where w > 1e-6 group by 1")
def conservative_cross(spark, d):
    """Weights from a lat-lon grid to a projected one, applied."""
    source, target = _greenland()
    l = remap.conservative_links(spark, source, target).where("w > 1e-6")
    field = grids.cells(spark, source).select(F.col("cell").alias("src"), (F.col("cell") % 180).cast("double").alias("value"))
    return links.apply(l, field).join(l.groupBy("dst").agg(F.sum("w").alias("area")), "dst").select("dst", rounded("area", 4).alias("area"), rounded("value", 4).alias("value"))


_PLACES = "t as (select c_custkey as dst, c_acctbal * 0.09 as x, (c_custkey % 100)::double as y from customer)"


def _places(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_acctbal") * 0.09).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))


def _tenths(spark):
    g = Grid("source", Axis(0.0, 100.0, 10), Axis(0.0, 10.0, 10), CoordSystem("cartesian", "km"))
    return g, grids.cells(spark, g).select(F.col("cell").alias("src"), F.when(F.col("cell") % 9 != 0, 3.0 * F.col("i") + 2.0 * F.col("j")).alias("value"))


@query(f"with {_PLACES} select dst, round(3 * least(greatest(x, 0), 810) + 2 * least(greatest(y, 0), 90), 6) as value from t where x between -170 and 980 and y between -10 and 100")
def locate_any_axis(spark, d):
    """A linear field on an axis of growing steps comes back at its places."""
    g = Grid("source", Axis.of([10.0 * k * k for k in range(10)]), Axis(0.0, 10.0, 10), CoordSystem("cartesian", "km"))
    field = grids.cells(spark, g).select(F.col("cell").alias("src"), (3 * F.col("x") + 2 * F.col("y")).alias("value"))
    return links.apply(grids.bilinear_links(_places(spark, d), g), field).select("dst", rounded("value").alias("value"))


@query("""with e as (select k, case when k = 0 then -5.0 when k = 10 then 895.0 else (10 * k * k + 10 * (k - 1) * (k - 1)) / 2.0 end as x from range(0, 11) r(k)),
s as (select a.k + 1 as si, a.x as lo, b.x as hi from e a join e b on b.k = a.k + 1), x as (select i, si, least(i * 60.0, hi) - greatest((i - 1) * 60.0, lo) as w from range(1, 16) r(i) join s on i * 60.0 > lo and (i - 1) * 60.0 < hi),
y as (select j, sj, least(j * 15.0, sj * 10.0) - greatest((j - 1) * 15.0, (sj - 1) * 10.0) as w from range(1, 7) r(j) join range(1, 11) t(sj) on j * 15.0 > (sj - 1) * 10.0 and (j - 1) * 15.0 < sj * 10.0)
select ((j - 1) * 15 + i)::bigint as dst, p_partkey // 100 as k, round(sum(x.w * y.w * p_retailprice) / sum(x.w * y.w), 6) as value from x, y, part where p_partkey % 100 + 1 = (sj - 1) * 10 + si group by 1, 2""")
def conservative_any_axis(spark, d):
    flat = CoordSystem("cartesian", "km")
    source = Grid("source", Axis.of([10.0 * k * k for k in range(10)]), Axis(5.0, 10.0, 10), flat)
    target = Grid("target", Axis(30.0, 60.0, 15), Axis(7.5, 15.0, 6), flat)
    return links.apply(grids.conservative_links(spark, source, target), _hundreds(spark, d), keys=["k"]).select("dst", "k", rounded("value").alias("value"))


@query(f"""with {_PLACES}, c as (select i, j, ((j - 1) * 10 + i)::bigint as cell, case when (i + j) % 3 = 0 then (3 * i + 2 * j)::double end as v from range(1, 11) r(i), range(1, 11) s(j)),
n as (select t.*, greatest(1, least(10, round(x / 100) + 1)) as ci, greatest(1, least(10, round(y / 10) + 1)) as cj from t),
p as (select dst, v, row_number() over (partition by dst order by sqrt(pow((i - 1) * 100 - x, 2) + pow((j - 1) * 10 - y, 2)), cell) as r from n join c on abs(i - ci) <= 2 and abs(j - cj) <= 2 where v is not null)
select t.dst, v as value from t left join (select * from p where r = 1) using (dst)""")
def interp_nearest_valid(spark, d):
    g, _ = _tenths(spark)
    f = grids.cells(spark, g).select(F.col("cell").alias("src"), F.when((F.col("i") + F.col("j")) % 3 == 0, (3 * F.col("i") + 2 * F.col("j")).cast("double")).alias("value"))
    return remap.nearest_valid(f, g, _places(spark, d), 2).select("dst", "value")


@query(f"""with {_PLACES}, a as (select *, floor(x / 100)::bigint as i, floor(y / 10)::bigint as j, x / 100 - floor(x / 100) as u, y / 10 - floor(y / 10) as v from t),
b as (select *, case when x > 0 and x < 900 and y > 0 and y < 90 and (j * 10 + i + 1) % 9 <> 0 and (j * 10 + i + 2) % 9 <> 0 and (j * 10 + i + 11) % 9 <> 0 and (j * 10 + i + 12) % 9 <> 0 then 3 * (i + 1 + u) + 2 * (j + 1 + v) end as value from a)
select dst, round(value, 6) as value from b""")
def interp_bilinear(spark, d):
    g, f = _tenths(spark)
    return remap.strict_bilinear(f, g, _places(spark, d)).select("dst", rounded("value").alias("value"))


@query(f"""with {_PLACES}, a as (select *, greatest(1, least(10, ceil(x / 100 - 0.5) + 1)) as i, greatest(1, least(10, ceil(y / 10 - 0.5) + 1)) as j from t)
select dst, case when abs(x - (i - 1) * 100) <= 100 and abs(y - (j - 1) * 10) <= 10 and ((j - 1) * 10 + i)::bigint % 9 <> 0 then (3 * i + 2 * j)::double end as value from a""")
def interp_nearest(spark, d):
    g, f = _tenths(spark)
    return remap.nearest_cells(f, g, _places(spark, d)).select("dst", "value")


@query("""with recursive s as (select 0 as step, [0.0::double for k in range(0, 25)] as v union all
  select step + 1, list_transform(range(0, 25), lambda i: (i + 1.0 + case when i > 0 then v[i] else 0 end + case when i < 24 then v[i + 2] else 0 end) / 8) from s where step < 40)
select n_nationkey::bigint as i, round(v[n_nationkey + 1], 4) as v from nation, s where step = 40""")
def solve_jacobi(spark, d):
    """A diagonally dominant system over the nations, coupled to their neighbours by number."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    a = n.select("i", F.col("i").alias("j"), F.lit(8.0).alias("a")).unionByName(n.select("i", (F.col("i") + 1).alias("j"), F.lit(-1.0).alias("a"))).unionByName(n.select("i", (F.col("i") - 1).alias("j"), F.lit(-1.0).alias("a"))).where("j between 0 and 24")
    x, _, _ = solvers.jacobi(a, n.select("i", (F.col("i") + 1.0).alias("v")), tol=1e-9)
    return x.select("i", rounded("v", 4).alias("v"))
