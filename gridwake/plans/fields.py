"""Time slices, reductions and stencils over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.operators import grids, nodes, relax, slices, spectral, stencil
from gridwake.plans.registry import query, rounded, table

#: Monthly mean price by priority: steps 1.. from January 1995, time in years at mid-month.
_MONTHLY = """f as (select o_orderpriority as pri, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::bigint as t,
  1995 + ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 0.5) / 12.0 as time, avg(o_totalprice) as v from orders group by 1, 2, 3)"""


def monthly(spark, d):
    step = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("long")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("pri"), step.alias("t_idx"), "o_totalprice")
    rows = rows.groupBy("pri", "t_idx").agg(F.avg("o_totalprice").alias("value"))
    return rows.select("pri", "t_idx", (1995 + (F.col("t_idx") - 0.5) / 12.0).alias("time"), "value")


@query(f"with {_MONTHLY} select pri, t as t_idx, round(v, 4) as value from f where abs(t - 24) <= 1e-8")
def slice_exact(spark, d):
    f = monthly(spark, d).select("pri", "t_idx", F.col("t_idx").cast("double").alias("time"), "value")
    return slices.steps(f, 24.0).select("pri", "t_idx", rounded("value", 4).alias("value"))


@query(f"with {_MONTHLY} select pri, t as t_idx, round(v, 4) as value from f where t between 13 and 24")
def slice_range(spark, d):
    f = monthly(spark, d).select("pri", "t_idx", F.col("t_idx").cast("double").alias("time"), "value")
    return slices.steps(f, 13.0, 24.0).select("pri", "t_idx", rounded("value", 4).alias("value"))


@query(f"with {_MONTHLY} select distinct pri, cast(null as double) as value from f")
def slice_range_off_axis(spark, d):
    f = monthly(spark, d).select("pri", F.col("t_idx").cast("double").alias("time"), "value")
    return slices.steps(f, 13.0, 2400.0).select("pri", "value")


_BRACKET = f"""with {_MONTHLY}, b as (select pri, max_by(t, t) filter (t <= {{t}} + 1e-8) as t0, max_by(v, t) filter (t <= {{t}} + 1e-8) as v0,
  min_by(t, t) filter (t > {{t}} + 1e-8) as t1, min_by(v, t) filter (t > {{t}} + 1e-8) as v1 from f group by pri)
select pri, round({{value}}, 4) as value from b"""


@query(_BRACKET.format(t=30.25, value="v0 * (1 - (30.25 - t0) / (t1 - t0)) + v1 * (30.25 - t0) / (t1 - t0)"))
def slice_interp(spark, d):
    f = monthly(spark, d).select("pri", F.col("t_idx").cast("double").alias("time"), "value")
    return slices.interpolate(f, 30.25, ["pri"]).select("pri", rounded("value", 4).alias("value"))


@query(_BRACKET.format(t=500, value="coalesce(v0, v1)"))
def slice_extrap(spark, d):
    f = monthly(spark, d).select("pri", F.col("t_idx").cast("double").alias("time"), "value")
    return slices.interpolate(f, 500.0, ["pri"], extrapolate=True).select("pri", rounded("value", 4).alias("value"))


_REDUCE = f"with {_MONTHLY} select pri, round({{agg}}, 3) as value from f where floor(time) between 1996 and 1999 group by pri"
_SD = "case when count(v) < 2 then null when count(v) = 2 then sqrt(2 * var_pop(v)) else stddev_pop(v) end"


def _reduce(method):
    def f(spark, d):
        m = monthly(spark, d).withColumn("time", F.floor("time").cast("double"))
        return slices.range_reduce(m, method, 1996.0, 1999.0, ["pri"]).select("pri", rounded("value", 3).alias("value"))

    f.__name__ = f"range_{method}"
    return f


for _method, _agg in {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "sd": _SD}.items():
    query(_REDUCE.format(agg=_agg))(_reduce(_method))


@query(f"with {_MONTHLY} select pri, ((t - 1) % 12)::integer as slot, round(avg(v), 6) as value from f where floor(time) between 1995 and 2000 group by 1, 2")
def slice_range_mean(spark, d):
    """The flagship: a climatology by month over whole years."""
    out = slices.range_reduce(monthly(spark, d), "mean", 1995.0, 2000.0, ["pri"], rep=12)
    return out.select("pri", "slot", rounded("value").alias("value"))


@query("""with f as (select l_returnflag as flag, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) as t, avg(l_quantity) as v from lineitem group by 1, 2)
select flag, ((t - 1) % 12)::integer as slot, round(avg(v), 6) as value from f where 1995 + (t - 1) // 12 between 1995 and 2000 group by 1, 2""")
def range_mean_rep12(spark, d):
    step = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("long")
    f = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), step.alias("t_idx"), "l_quantity").groupBy("flag", "t_idx").agg(F.avg("l_quantity").alias("value"))
    f = f.withColumn("time", 1995 + (F.col("t_idx") - 0.5) / 12)
    return slices.range_reduce(f, "mean", 1995.0, 2000.0, ["flag"], rep=12, axis=(1995.0, 2001.9)).select("flag", "slot", rounded("value").alias("value"))


@query("select event_id, case when event_id % 7 = 0 then null when abs(value * (case when event_id % 11 = 0 then 1e12 else 1 end)) < 1e10 then round(value * 2 + 5, 6) end as value from events")
def crazy_guard_scale(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value") * F.when(F.col("event_id") % 11 == 0, 1e12).otherwise(1.0))
    return table(spark, d, "events").select("event_id", rounded(slices.scaled(v, 2.0, 5.0)).alias("value"))


@query("select count(*) as n, round(min(value), 6) as least, round(max(value), 6) as most, round(avg(value), 6) as mean from events")
def value_range(spark, d):
    e = table(spark, d, "events")
    n = e.agg(F.count("*").alias("n"))
    return n.join(slices.summary(e)).select("n", rounded("least").alias("least"), rounded("most").alias("most"), rounded("mean").alias("mean"))


@query("""with y as (select min(year(l_shipdate)) as a, max(year(l_shipdate)) as b from lineitem), r as (select a, unnest(range(1, 4 * (b - a + 1) + 1)) as t from y)
select t as t_idx, round(a + (t - 1) // 4 + ((t - 1) % 4 + 0.5) / 4, 9) as time from r""")
def time_axis_subannual(spark, d):
    """Middles of the quarters of the years that items were shipped in."""
    a, b = table(spark, d, "lineitem").agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    return slices.time_axis(spark, float(a), float(b), 1.0, 4).select("t_idx", rounded("time", 9).alias("time"))


# --- stencils on all parts reshaped to a grid 20 wide; the last row may be short --------------------------------

_NX = 20
_GRID = f"""g as (select (p_partkey % {_NX} + 1)::bigint as i, (p_partkey // {_NX} + 1)::bigint as j, p_retailprice as v from part)"""


def part_grid(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % _NX + 1).alias("i"), (F.floor(k / _NX) + 1).alias("j"), F.col("p_retailprice").alias("value"), "p_size")


def part_rows(spark, d) -> int:
    return table(spark, d, "part").agg(F.floor(F.max("p_partkey") / _NX) + 1).first()[0]


_CENTRED = f"""with {_GRID}, w as (select i, j, v, lag(v) over x as b, lead(v) over x as a, lag(v, 2) over x as b2, lead(v, 2) over x as a2, lag(1) over x as hb, lead(1) over x as ha
  from g window x as (partition by j order by i))"""


@query(f"{_CENTRED} select i, j, round(case when hb is null then (-3 * v + 4 * a - a2) / 4.0 when ha is null then (b2 - 4 * b + 3 * v) / 4.0 else (a - b) / 4.0 end, 6) + 0.0 as slope from w")
def deriv_centered(spark, d):
    g = part_grid(spark, d)
    return stencil.derivative(g, "i", 2.0).select("i", "j", rounded("slope").alias("slope"))


@query(f"{_CENTRED}, e as (select j, max_by(v, i) as l, min_by(v, i) as f from g group by j) select i, w.j as j, round((coalesce(a, f) - coalesce(b, l)) / 4.0, 6) + 0.0 as slope from w join e using (j)")
def deriv_periodic(spark, d):
    g = part_grid(spark, d)
    return stencil.derivative(g, "i", 2.0, periodic=True).select("i", "j", rounded("slope").alias("slope"))


_EDGE = "case when lag(1) over {w} is null then lead({d}) over {w} when lead(1) over {w} is null then lag({d}) over {w} else {d} end"


@query(f"""with {_GRID}, a as (select i, j, (lead(v) over x - lag(v) over x) / 2.0 as dx, (lead(v) over y - lag(v) over y) / 2.0 as dy from g window x as (partition by j order by i), y as (partition by i order by j)),
b as (select i, j, {_EDGE.format(w='x', d='dx')} as dx, {_EDGE.format(w='y', d='dy')} as dy from a window x as (partition by j order by i), y as (partition by i order by j))
select i, j, round(sqrt(dx * dx + dy * dy), 6) as gradient from b""")
def gradient(spark, d):
    g = part_grid(spark, d)
    return stencil.gradient(g, 1.0, 1.0).select("i", "j", rounded("gradient").alias("gradient"))


@query(f"""with {_GRID} select i, j, round(coalesce(v + 0.1 * (lag(v) over x + lead(v) over x + lag(v) over y + lead(v) over y - 4 * v), v), 6) as value from g
window x as (partition by j order by i), y as (partition by i order by j)""")
def laplacian(spark, d):
    g = part_grid(spark, d)
    return stencil.laplacian_step(g, 1.0, 0.1).select("i", "j", rounded("value").alias("value"))


_K3 = [(-1, 0.25), (0, 0.5), (1, 0.25)]


@query(f"""with {_GRID}, s as (select max(j) as ny from g), o as (select * from (values (-1, 0.25), (0, 0.5), (1, 0.25)) o(k, w)),
t as (select g.i, g.j, a.k as a, b.k as b, a.w * b.w as w, case when g.i + a.k < 1 then 1 - g.i - a.k when g.i + a.k > {_NX} then {2 * _NX + 1} - g.i - a.k else g.i + a.k end as si,
  case when g.j + b.k < 1 then 1 - g.j - b.k when g.j + b.k > ny then 2 * ny + 1 - g.j - b.k else g.j + b.k end as sj from g, s, o a, o b)
select t.i, t.j, round(sum(t.w * g.v), 6) as value from t join g on g.i = si and g.j = sj group by 1, 2""")
def convolve_reflect(spark, d):
    g, ny = part_grid(spark, d), part_rows(spark, d)
    kernel = [(a, b, x * y) for a, x in _K3 for b, y in _K3]
    return stencil.convolve(g, kernel, _NX, ny).select("i", "j", rounded("value").alias("value"))


@query(f"""with {_GRID}, s as (select max(j) as ny from g), o as (select k, exp(-0.5 * k * k / 0.25) w0 from range(-3, 4) r(k)), n as (select k, w0 / (select sum(w0) from o) as w from o),
t as (select g.i, g.j, a.w * b.w as w, case when g.i + a.k < 1 then 1 - g.i - a.k when g.i + a.k > {_NX} then {2 * _NX + 1} - g.i - a.k else g.i + a.k end as si,
  case when g.j + b.k < 1 then 1 - g.j - b.k when g.j + b.k > ny then 2 * ny + 1 - g.j - b.k else g.j + b.k end as sj from g, s, n a, n b)
select t.i, t.j, round(sum(t.w * g.v), 6) as value from t join g on g.i = si and g.j = sj group by 1, 2""")
def convolve_gauss(spark, d):
    g, ny = part_grid(spark, d), part_rows(spark, d)
    return stencil.gauss_smooth(g, 0.5, _NX, ny).select("i", "j", rounded("value").alias("value"))


#: Every cell with its eight neighbours, wrapping: v and the steps along i and j (m before, p after).
_BEFORE, _AFTER = (lambda c, p, o, f=f, g=g: f"coalesce({f}({c}) over (partition by {p} order by {o}), {g}({c}) over (partition by {p} order by {o} rows between unbounded preceding and unbounded following))" for f, g in (("lag", "last_value"), ("lead", "first_value")))
_AROUND = f"""{_GRID}, n as (select max(i) as ni, max(j) as nj from g),
x as (select *, {_BEFORE('v', 'j', 'i')} as vm0, {_AFTER('v', 'j', 'i')} as vp0 from g),
a as (select x.*, ni, nj, {", ".join(f"{_BEFORE(c, 'i', 'j')} as v{k}m, {_AFTER(c, 'i', 'j')} as v{k}p" for c, k in (("v", "0"), ("vm0", "m"), ("vp0", "p")))} from x, n)"""


@query(f"with {_AROUND} select i, j, round((v + vp0 + v0p + vpp) / 4, 6) as aa_ab, round((v + vm0 + v0m + vmm) / 4, 6) as ab_aa from a")
def stagger_nodes(spark, d):
    g = part_grid(spark, d)
    both = nodes.stagger(nodes.stagger(g, "aa_ab", out="aa_ab"), "ab_aa", out="ab_aa")
    return both.select("i", "j", rounded("aa_ab").alias("aa_ab"), rounded("ab_aa").alias("ab_aa"))


_SIDE_KINDS = {"aa_acx": ("i < ni", "vp0"), "aa_acy": ("j < nj", "v0p"), "acx_aa": ("i > 1", "vm0"), "acy_aa": ("j > 1", "v0m"), "ab_acx": ("j > 1", "v0m"), "ab_acy": ("i > 1", "vm0")}


@query(f"with {_AROUND} select i, j, {', '.join(f'round(case when {c} then (v + {o}) / 2 else 0 end, 6) as {k}' for k, (c, o) in _SIDE_KINDS.items())} from a")
def stagger_sides(spark, d):
    g = part_grid(spark, d)
    for kind in _SIDE_KINDS:
        g = nodes.stagger(g, kind, out=kind)
    return g.select("i", "j", *[rounded(k).alias(k) for k in _SIDE_KINDS])


_COVER = "case when (i + 2 * j) % 3 = 0 then 0.0 else 1.0 end"


@query(f"""with {_AROUND}, c as (select *, case when (i + 2 * j) % 3 = 0 then 1 else 0 end as f, case when (i % ni + 1 + 2 * j) % 3 = 0 then 1 else 0 end as fp0,
  case when (i + 2 * (j % nj + 1)) % 3 = 0 then 1 else 0 end as f0p, case when (i % ni + 1 + 2 * (j % nj + 1)) % 3 = 0 then 1 else 0 end as fpp from a)
select i, j, round(case when f + fp0 + f0p + fpp > 0 then (f * v + fp0 * vp0 + f0p * v0p + fpp * vpp) / (f + fp0 + f0p + fpp) else (v + vp0 + v0p + vpp) / 4 end, 6) as bare,
  round(case when f = 0 then sqrt(pow((vm0 + v) / 2, 2) + pow((v0m + v) / 4, 2)) else 0 end, 6) as magnitude from c""")
def stagger_covered(spark, d):
    g = part_grid(spark, d)
    g = g.withColumns({"cover": F.expr(_COVER), "u": F.col("value"), "v": F.col("value") / 2})
    out = nodes.magnitude(nodes.centres_to_corners_bare(g, out="bare"))
    return out.select("i", "j", rounded("bare").alias("bare"), rounded("magnitude").alias("magnitude"))


def _quadrature_sql(corners: str) -> str:
    return f"""with {_AROUND}, c as (select i, j, {corners} from a), q as (select * from (values (1, {-(1 / 3**0.5)!r}, {-(1 / 3**0.5)!r}), (2, {1 / 3**0.5!r}, {-(1 / 3**0.5)!r}), (3, {-(1 / 3**0.5)!r}, {1 / 3**0.5!r}), (4, {1 / 3**0.5!r}, {1 / 3**0.5!r})) q(node, x, y))
select i, j, node, round(((1 - x) * (1 - y) * c1 + (1 + x) * (1 - y) * c2 + (1 - x) * (1 + y) * c3 + (1 + x) * (1 + y) * c4) / 4, 6) as at_node from c, q"""


def _quadrature(kind: str, corners: str):
    def run(spark, d):
        g = part_grid(spark, d)
        return nodes.to_quadrature(g, kind).select("i", "j", "node", rounded("at_node").alias("at_node"))

    run.__name__ = f"quadrature_{kind}"
    return query(_quadrature_sql(corners))(run)


_quadrature("aa", "(vmm + v0m + vm0 + v) / 4 as c1, (v0m + vpm + v + vp0) / 4 as c2, (vm0 + v + vmp + v0p) / 4 as c3, (v + vp0 + v0p + vpp) / 4 as c4")
_quadrature("ab", "vmm as c1, v0m as c2, vm0 as c3, v as c4")
_quadrature("acx", "(vmm + vm0) / 2 as c1, (v0m + v) / 2 as c2, (vm0 + vmp) / 2 as c3, (v + v0p) / 2 as c4")
_quadrature("acy", "(vmm + v0m) / 2 as c1, (v0m + vpm) / 2 as c2, (vm0 + v) / 2 as c3, (v + vp0) / 2 as c4")


@query(f"""with {_GRID}, s as (select max(j) as ny from g), m as (select * from g where (i * j) % 4 <> 0), o as (select k from range(-2, 3) r(k)),
t as (select g.i, g.j, exp(-(a.k * a.k + b.k * b.k) / 2.88) as w, case when g.i + a.k < 1 then 1 - g.i - a.k when g.i + a.k > {_NX} then {2 * _NX + 1} - g.i - a.k else g.i + a.k end as si,
  case when g.j + b.k < 1 then 1 - g.j - b.k when g.j + b.k > ny then 2 * ny + 1 - g.j - b.k else g.j + b.k end as sj from g, s, o a, o b where g.i + a.k between 1 and {_NX} or g.j + b.k between 1 and ny),
f as (select t.i, t.j, sum(t.w * m.v) / sum(t.w) as n from t join m on m.i = si and m.j = sj group by 1, 2)
select i, j, round(coalesce(n, v), 6) as value from g left join f using (i, j)""")
def gauss_masked(spark, d):
    g, ny = part_grid(spark, d), part_rows(spark, d)
    g = g.withColumn("use", F.expr("(i * j) % 4 <> 0"))
    return stencil.gauss_masked(g, 1.2, 1.0, _NX, ny, "use").select("i", "j", rounded("value").alias("value"))


@query(f"with {_GRID} select i, j, round(coalesce((v + lead(v) over (partition by j order by i)) / 2, v), 6) as staggered from g")
def stagger_x(spark, d):
    g = part_grid(spark, d)
    return stencil.stagger(g, "i").select("i", "j", rounded("staggered").alias("staggered"))


@query(f"""with {_GRID}, p as (select i, j, v + coalesce(lead(v) over (partition by j order by i), v) as p from g)
select i, j, round((p + coalesce(lead(p) over (partition by i order by j), p)) / 4, 6) as corner from p""")
def stagger_corners(spark, d):
    g = part_grid(spark, d)
    return stencil.to_corners(g).select("i", "j", rounded("corner").alias("corner"))


@query(f"""with {_GRID}, a as (select i, j, v, coalesce(lag(v) over x, v) as w, coalesce(lead(v) over x, v) as e from g window x as (partition by j order by i)),
b as (select i, j, (v + w + coalesce(lag(v) over y, v) + coalesce(lag(w) over y, w)) / 4 as sw, (v + e + coalesce(lag(v) over y, v) + coalesce(lag(e) over y, e)) / 4 as se,
  (v + w + coalesce(lead(v) over y, v) + coalesce(lead(w) over y, w)) / 4 as nw, (v + e + coalesce(lead(v) over y, v) + coalesce(lead(e) over y, e)) / 4 as ne from a window y as (partition by i order by j))
select i, j, a::integer as a, b::integer as b, round((1 - (a - 1) / 2) * (1 - (b - 1) / 2) * sw + (a - 1) / 2 * (1 - (b - 1) / 2) * se + (1 - (a - 1) / 2) * (b - 1) / 2 * nw + (a - 1) / 2 * (b - 1) / 2 * ne, 6) as sample
from b, range(1, 4) r(a), range(1, 4) s(b)""")
def subgrid_samples(spark, d):
    g = part_grid(spark, d)
    return stencil.subgrid(g, 3).select("i", "j", "a", "b", rounded("sample").alias("sample"))


_GQ = 1 / 3**0.5


@query(f"""with {_GRID}, c as (select i, j, v as c1, coalesce(lead(v) over (partition by j order by i), v) as c2 from g),
e as (select i, j, c1, c2, coalesce(lead(c1) over (partition by i order by j), c1) as c3, coalesce(lead(c2) over (partition by i order by j), c2) as c4 from c),
q as (select * from (values (1, {-_GQ!r}, {-_GQ!r}), (2, {_GQ!r}, {-_GQ!r}), (3, {-_GQ!r}, {_GQ!r}), (4, {_GQ!r}, {_GQ!r})) q(node, x, y))
select i, j, node, round(((1 - x) * (1 - y) * c1 + (1 + x) * (1 - y) * c2 + (1 - x) * (1 + y) * c3 + (1 + x) * (1 + y) * c4) / 4, 6) as at_node from e, q""")
def quadrature_2d(spark, d):
    from pyspark.sql import Window

    g = part_grid(spark, d)
    g = g.select("i", "j", F.col("value").alias("c1"), F.coalesce(F.lead("value").over(Window.partitionBy("j").orderBy("i")), "value").alias("c2"))
    up = Window.partitionBy("i").orderBy("j")
    g = g.select("*", F.coalesce(F.lead("c1").over(up), "c1").alias("c3"), F.coalesce(F.lead("c2").over(up), "c2").alias("c4"))
    return stencil.quadrature_nodes(g, ["c1", "c2", "c3", "c4"]).select("i", "j", "node", rounded("at_node").alias("at_node"))


def _holes(spark, d):
    g = part_grid(spark, d)
    return g.withColumn("value", F.when((F.col("i") * 7 + F.col("j") * 3) % 5 != 0, F.col("value")))


_HOLES = f"with {_GRID}, z as (select i, j, case when (i * 7 + j * 3) % 5 <> 0 then v end as v from g), n as (select max(i) as ni, max(j) as nj from g)"
#: Of the boxes over a hole the last one counts, by its centre; none of them is empty.
_BOX_MEANS = f"""{_HOLES}, m as (select a.i, a.j, avg(b.v) as m from z a, n join z b on b.i between greatest(least(a.i + 1, ni - 1), 2) - 1 and greatest(least(a.i + 1, ni - 1), 2) + 1
  and b.j between greatest(least(a.j + 1, nj - 1), 2) - 1 and greatest(least(a.j + 1, nj - 1), 2) + 1 where a.v is null group by 1, 2)
select i, j, round(coalesce(z.v, m), 6) as value from z left join m using (i, j)"""


def _diffused(table: str) -> str:
    """One round: box means inside, on the sides the mean with the inner neighbour, those along i last."""
    pair = lambda o: f"case when a.v is null then {o} when {o} is null then a.v else (a.v + {o}) / 2 end"
    at = lambda di, dj: f"(select b.v from {table} b where b.i = a.i + ({di}) and b.j = a.j + ({dj}))"
    return f"""select a.i, a.j, case when a.i = 1 then {pair(at(1, 0))} when a.i = ni then {pair(at(-1, 0))} when a.j = 1 then {pair(at(0, 1))} when a.j = nj then {pair(at(0, -1))}
  else (select avg(b.v) from {table} b where b.i between a.i - 1 and a.i + 1 and b.j between a.j - 1 and a.j + 1) end as v from {table} a, n"""


def _field_query(name, f, sql=None):
    def run(spark, d):
        return f(_holes(spark, d)).select("i", "j", rounded("value").alias("value"))

    run.__name__ = name
    return query(sql)(run)


#: The whole field, cells without a part too (x), and its inside: two cells from the sides.
_FULL = f"""{_HOLES}, c as (select i, unnest(range(1, nj + 1)) as j from (select unnest(range(1, ni + 1)) as i, nj from n)), x as (select c.i, c.j, z.v from c left join z using (i, j)),
inner_holes as (select x.i, x.j from x, n where v is null and x.i between 3 and ni - 2 and x.j between 3 and nj - 2),
box as (select h.i, h.j, b.v, b.i - h.i as a, b.j - h.j as b from inner_holes h join x b on b.i between h.i - 2 and h.i + 2 and b.j between h.j - 2 and h.j + 2 where b.v is not null)"""
#: Border cells from the next ones inwards, along i, then along j; the fields of the queries have no hole inside after one sweep.
_RIM = f"""filled as (select x.i, x.j, coalesce(x.v, f.v) as v from x left join once f using (i, j)),
across as (select a.i, a.j, coalesce(a.v, b.v, c.v, e.v) as v from filled a, n
  left join filled b on b.j = a.j and b.i = case when a.i <= 3 then a.i + 1 when a.i >= ni - 2 then a.i - 1 end
  left join filled c on c.j = a.j and c.i = case when a.i <= 2 then a.i + 2 when a.i >= ni - 1 then a.i - 2 end
  left join filled e on e.j = a.j and e.i = case when a.i <= 1 then a.i + 3 when a.i >= ni then a.i - 3 end),
up as (select a.i, a.j, coalesce(a.v, b.v, c.v, e.v) as v from across a, n
  left join across b on b.i = a.i and b.j = case when a.j <= 3 then a.j + 1 when a.j >= nj - 2 then a.j - 1 end
  left join across c on c.i = a.i and c.j = case when a.j <= 2 then a.j + 2 when a.j >= nj - 1 then a.j - 2 end
  left join across e on e.i = a.i and e.j = case when a.j <= 1 then a.j + 3 when a.j >= nj then a.j - 3 end)
select i, j, round(up.v, 6) as value from up semi join g using (i, j)"""
_WEIGHTED = f"""{_FULL}, once as (select i, j, sum(v / greatest(0.1, sqrt(a * a + b * b))) / sum(1 / greatest(0.1, sqrt(a * a + b * b))) as v from box group by i, j
  having count(distinct case when a >= 0 then 2 else 0 end + case when b >= 0 then 1 else 0 end) = 4), {_RIM}"""
_NEAREST = f"{_FULL}, once as (select i, j, arg_min(v, (a * a + b * b, b, a)) as v from box group by i, j), {_RIM}"
fill_weighted = _field_query("fill_weighted", lambda f: relax.fill_weighted(f, 2), _WEIGHTED)
fill_nearest = _field_query("fill_nearest", lambda f: relax.fill_nearest(f, 2), _NEAREST)
fill_mean = _field_query("fill_mean", relax.fill_mean, _BOX_MEANS)
fill_poisson = _field_query("fill_poisson", relax.fill_poisson)
diffuse = _field_query("diffuse", lambda f: relax.diffuse(f, 2), f"{_HOLES}, d as ({_diffused('z')}), e as ({_diffused('d')}) select i, j, round(v, 6) as value from e")


def _limited(before: str) -> str:
    """One round: towards the steepest of the neighbours i - 1, i + 1, j - 1, j + 1, the first of equal ones; sides stay."""
    return f"""select i, j, case when i > 1 and i < ni and j > 1 and j < nj and steep is not null and abs(steep) > 20 then near - sign(steep) * 16 else v end as v from (
  select a.i, a.j, any_value(a.v) as v, any_value(ni) as ni, any_value(nj) as nj, arg_min(b.v - a.v, (-abs(b.v - a.v), o.k)) as steep, arg_min(b.v, (-abs(b.v - a.v), o.k)) as near
  from {before} a cross join n cross join (values (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1)) o(k, di, dj) left join {before} b on b.i = a.i + di and b.j = a.j + dj and b.v is not null and a.v is not null group by a.i, a.j)"""


@query(f"with {_GRID}, n as (select max(i) as ni, max(j) as nj from g), r1 as ({_limited('g')}), r2 as ({_limited('r1')}), r3 as ({_limited('r2')}) select i, j, round(v, 6) as value from r3")
def limit_gradient(spark, d):
    return relax.limit_gradient(part_grid(spark, d), 1.0, 1.0, 20.0, 3).select("i", "j", rounded("value").alias("value"))


@query(f"""with s as (select (p_partkey % {_NX} + 1)::bigint as i, (p_partkey // {_NX} + 1)::bigint as j, case when p_size > 45 then -1 when p_size <= 3 then 0 else 1 end as mask from part),
o as (select i, j from s where mask = 0),
p as (select s.i, s.j, any_value(mask) as mask, min(greatest(abs(s.i - o.i), abs(s.j - o.j)) + (sqrt(2) - 1) * least(abs(s.i - o.i), abs(s.j - o.j))) as d from s, o group by s.i, s.j)
select i, j, round(case when mask < 0 then -d else d end, 6) as distance from p""")
def distance_to_mask(spark, d):
    g = part_grid(spark, d).withColumn("mask", F.when(F.col("p_size") > 45, -1).when(F.col("p_size") <= 3, 0).otherwise(1))
    return stencil.distances(g, "mask").select("i", "j", rounded("distance").alias("distance"))


@query(f"""with s as (select (p_partkey % {_NX} + 1)::bigint as i, (p_partkey // {_NX} + 1)::bigint as j, case when p_size > 45 then -1 when p_size <= 3 then 0 else 1 end as mask from part),
n as (select max(j) as nj from s), o as (select i, j from s where mask = 0),
t as (select s.i, s.j, mask, least(abs(s.i - o.i), {_NX} - abs(s.i - o.i)) as a, least(abs(s.j - o.j), nj - abs(s.j - o.j)) as b from s, o, n),
p as (select i, j, any_value(mask) as mask, min(greatest(a, b) + (sqrt(2) - 1) * least(a, b)) as d from t group by i, j)
select i, j, round(case when mask < 0 then -d else d end, 6) as distance from p""")
def distance_to_mask_periodic(spark, d):
    g = part_grid(spark, d).withColumn("mask", F.when(F.col("p_size") > 45, -1).when(F.col("p_size") <= 3, 0).otherwise(1))
    return stencil.distances(g, "mask", periodic_x=True, periodic_y=True, shape=(_NX, part_rows(spark, d))).select("i", "j", rounded("distance").alias("distance"))


@query("select coalesce(string_agg(event_id::varchar, ',' order by event_id), '-1') as at from events where value > 485")
def which_idx(spark, d):
    return grids.which(table(spark, d, "events"), F.col("value") > 485, "event_id").select(F.array_join(F.col("at").cast("array<string>"), ",").alias("at"))


@query("select event_id from events where value > 200")
def which_places(spark, d):
    return grids.places(table(spark, d, "events"), F.col("value") > 200, "event_id")


@query("select round(avg(p_size), 6) as mean, count(*) as n from part")
def grid_mean(spark, d):
    return table(spark, d, "part").agg(rounded(F.avg("p_size")).alias("mean"), F.count("*").alias("n"))


@query(f"with {_GRID} select j, round(avg(v), 6) as value from g group by j")
def zonal_mean(spark, d):
    g = part_grid(spark, d)
    return g.groupBy("j").agg(rounded(F.avg("value")).alias("value"))


@query("select distinct p_size::double as v from part")
def unique_values(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("v"), "p_partkey")
    return grids.unique(p, "v", "p_partkey")


@query("""with f as (select p_retailprice as v, min(p_partkey) as o from part group by 1),
r as (select list_reduce(list([v] order by o, v), lambda a, b: case when len(list_filter(a, lambda u: abs(u - b[1]) <= 0.35)) > 0 then a else list_concat(a, b) end) as kept from f)
select unnest(kept) as v from r""")
def unique_tolerant(spark, d):
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("v"), "p_partkey")
    return grids.unique(p, "v", "p_partkey", 0.35)


@query(f"""with {_GRID} select j, k::bigint as k, round(sum(v * cos(2 * pi() * k * (i - 1) / {_NX})), 4) + 0.0 as re, round(-sum(v * sin(2 * pi() * k * (i - 1) / {_NX})), 4) + 0.0 as im from g, range(0, {_NX // 2 + 1}) r(k) group by 1, 2""")
def fourier_rows(spark, d):
    g = part_grid(spark, d)
    return spectral.fourier(g, ["j"], "i").select("j", "k", rounded("re", 4).alias("re"), rounded("im", 4).alias("im"))


@query()
def harmonics(spark, d):
    g, rows = part_grid(spark, d), part_rows(spark, d)
    return spectral.harmonics(g, [], min(_NX // 2 - 1, rows - 1)).select("l", "m", rounded("re").alias("re"), rounded("im").alias("im"))
