"""Registered queries: spatial means, variability, tests, fits, histograms, smoothing and convolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.kernels import lowpass_coefficients
from gridspark.functions.statistics import ttest_pvalue
from gridspark.operators import signal, spatial, stats
from gridspark.plans import adapters as A
from gridspark.plans.registry import query, r, rounded
from gridspark.schema import literal_table
from gridspark.scratch import settle


# -- spatial -----------------------------------------------------------------------------------

@query("area_weighted_mean", f"""
select variable, experiment, member, year, {r('sum(v * w) / sum(case when v is not null then w end)')} as value from (
  select a.*, case when value > 20 then value end as v, cos(radians(lat)) as w from a_annual a join a_cells using (cell_id)) x
group by variable, experiment, member, year""")
def area_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = A.annual(spark, sf_dir).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return rounded(stats.area_weighted_mean(some, A.cells(spark, sf_dir), ["variable", "experiment", "member", "year"]), "value")


@query("regional_aggregate", f"""
with x as (select a.*, cos(radians(lat)) as w from a_annual a join a_cells using (cell_id))
select 'mean' as op, variable, year, {r('sum(value * w) / sum(w)')} as value from x group by variable, year
union all select 'sum', variable, year, {r('sum(value)')} from x group by variable, year
union all select 'max', variable, year, {r('max(value)')} from x group by variable, year
union all select 'min', variable, year, {r('min(value)')} from x group by variable, year""")
def regional_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual, cells = A.annual(spark, sf_dir), A.cells(spark, sf_dir)
    parts = [stats.regional_aggregate(annual, cells, ["variable", "year"], op, weighted=op != "sum").withColumn("op", F.lit(op))
             for op in ("mean", "sum", "max", "min")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, "value")


@query("natural_variability", f"""
with m as (select variable, experiment, member, year, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) as y
           from a_annual join a_cells using (cell_id) where year between 1996 and 2001 group by all),
  d as (select variable, experiment, y - (regr_slope(y, year) over w * year + regr_intercept(y, year) over w) as e
        from m window w as (partition by variable, experiment, member))
select variable, experiment, {r('stddev_pop(e)')} as value from d group by variable, experiment""")
def natural_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.natural_variability(A.annual(spark, sf_dir), A.cells(spark, sf_dir), ["variable", "experiment"], window=(1996, 2001))
    return rounded(out, "value")


_REGIONAL = """
select variable, experiment, cell_id, stddev_pop(e) as value from (
  select *, value - coalesce(regr_slope(value, year) over w * (year - regr_avgx(value, year) over w), 0) - avg(value) over w as e
  from a_annual where year between 1996 and 2001 window w as (partition by variable, experiment, member, cell_id)) x
where year between 1997 and 1999 group by variable, experiment, cell_id"""


@query("regional_variability", f"select variable, experiment, cell_id, {r('value', 5)} as value from h_regional", h_regional=_REGIONAL)
def regional_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.regional_variability(A.annual(spark, sf_dir), ["variable", "experiment", "cell_id"], fit=(1996, 2001), window=(1997, 1999))
    return rounded(out, "value", digits=5)


@query("population_variability", f"""
select variable, experiment, year, member, cell_id, {r('value * (select sum(persons) from a_population join a_land using (cell_id)) / 1000000', 4)} as value
from a_annual""")
def population_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = spatial.land_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))
    rows = A.annual(spark, sf_dir).select("variable", "experiment", "member", "year", "cell_id", "value")
    return rounded(stats.population_variability(rows, A.population(spark, sf_dir), land), "value", digits=4)


# -- tests -------------------------------------------------------------------------------------

# two-sided p for 124 degrees of freedom: 1 - sin * sum_k C(2k, k) / 4^k * cos^2k, over k < 62
_P = """case when sd = 0 then (case when m1 = m2 then 1 else 0 end) else greatest(0, 1 - sqrt(r2 / (1 + r2)) * list_sum(list_transform(range(0, 62),
  lambda k: exp(lgamma(2e0 * k + 1) - 2 * lgamma(k + 1e0) - 2e0 * k * ln(2e0) - k * ln(1 + r2))))) end"""


@query("ttest_pvalue", f"""
select variable, experiment, member, year, cell_id, {r(_P)} as p_value from (
  select *, pow((m1 - m2) / (nullif(sd, 0) * sqrt(2e0 / 63)), 2) / 124 as r2 from (
    select variable, experiment, member, year, cell_id, value as m1, 25e0 as m2, case when cell_id % 10 = 3 then 0e0 else 20 + cell_id end as sd from a_annual) y) x""")
def ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    sd = F.when(F.col("cell_id") % 10 == 3, F.lit(0.0)).otherwise((20 + F.col("cell_id")).cast("double"))
    out = ttest_pvalue(annual, F.col("value"), F.lit(25.0), sd, 63)
    return rounded(out.select("variable", "experiment", "member", "year", "cell_id", "p_value"), "p_value")


@query("regional_pvalues", f"""
select variable, experiment, cell_id, decade_end, {r(_P, 5)} as p_value from (
  select *, pow((m1 - m2) / (nullif(sd, 0) * sqrt(2e0 / 63)), 2) / 124 as r2 from (
    select d.*, f.m1, s.value as sd from (
      select variable, experiment, cell_id, cast(ceil((year - 1995) / 3e0) * 3 + 1995 as int) as decade_end, avg(value) as m2
      from a_annual where year between 1996 and 2001 and cell_id in (select cell_id from a_land) group by all) d
    join (select variable, experiment, cell_id, avg(value) as m1 from a_annual where year = 1995 group by all) f using (variable, experiment, cell_id)
    join h_regional s using (variable, experiment, cell_id)) y) x where sd is not null""", h_regional=_REGIONAL)
def regional_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    keys = ["variable", "experiment"]
    std = stats.regional_variability(annual, [*keys, "cell_id"], fit=(1996, 2001), window=(1997, 1999))
    ref = annual.filter("year = 1995").groupBy(*keys, "cell_id").agg(F.avg("value").alias("value"))
    land = spatial.land_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))
    out = stats.regional_pvalues(annual, ref, std.filter("value is not null"), land, keys, origin=1995, decades=2, width=3)
    return rounded(out, "p_value", digits=5)


# -- fits --------------------------------------------------------------------------------------

_MAPS = """
select variable, member as model, case experiment when 'O' then '1-URGENT' else '5-LOW' end as scenario, year, cell_id, value from a_annual"""


def scenario_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_maps(A.annual(spark, sf_dir))


def label_maps(annual: DataFrame) -> DataFrame:
    """Annual maps labelled like the global series: one scenario per experiment, one model per member."""
    label = F.when(F.col("experiment") == "O", F.lit("1-URGENT")).otherwise(F.lit("5-LOW"))
    return annual.select("variable", F.col("member").alias("model"), label.alias("scenario"), "year", "cell_id", "value")


@query("has_missing", """
select model, scenario, count(*) as n_missing from h_maps where cell_id % 7 = 3 and model <> 'N' group by model, scenario""", h_maps=_MAPS)
def has_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.col("cell_id") % 7 == 3) & (F.col("model") != "N")
    some = scenario_maps(spark, sf_dir).withColumn("value", F.when(~gap, F.col("value")))
    return stats.has_missing(some)


_DRAWS = """
select cast(p.rep as int) as replicate, y.scenario, y.year, count(*) as w
from (select scenario, count(*) as n from a_global_annual group by scenario) s
cross join range(0, 20) p(rep) cross join lateral (select unnest(range(0, s.n)) as i) d
join (select *, row_number() over (partition by scenario order by year) - 1 as pos from a_global_annual) y
  on y.scenario = s.scenario and y.pos = cast(('0x' || substr(md5('b' || cast(p.rep as varchar) || '-' || s.scenario || '-' || cast(d.i as varchar)), 1, 8)) as bigint) % s.n
group by p.rep, y.scenario, y.year"""


@query("bootstrap_ols", f"""
select variable, model, cell_id, replicate, {r('b', 4)} as slope, {r('(sy - b * sx) / sw', 4)} as intercept from (
  select *, case when abs(sw * sxx - sx * sx) <= 1e-13 * sw * sxx then 0 else (sw * sxy - sx * sy) / (sw * sxx - sx * sx) end as b from (
    select variable, model, cell_id, replicate, sum(w) as sw, sum(w * driver) as sx, sum(w * value) as sy, sum(w * driver * driver) as sxx, sum(w * driver * value) as sxy
    from h_maps m join a_global_annual g using (scenario, year) join h_draws d using (scenario, year)
    where (variable, model, scenario) not in (('tas', 'A', '5-LOW'), ('pr', 'N', '1-URGENT')) group by variable, model, cell_id, replicate) x) y""", h_maps=_MAPS, h_draws=_DRAWS)
def bootstrap_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each variable misses values in another scenario, and only its own fits go without it
    missing = (F.col("year") == 1998) & (((F.col("variable") == "tas") & (F.col("model") == "A") & (F.col("scenario") == "5-LOW"))
                                         | ((F.col("variable") == "pr") & (F.col("model") == "N") & (F.col("scenario") == "1-URGENT")))
    # the fits read maps and series several times
    maps = settle(scenario_maps(spark, sf_dir).withColumn("value", F.when(~missing, F.col("value"))), "maps")
    out = stats.bootstrap_ols(maps, settle(A.global_annual(spark, sf_dir), "series"), replicates=20, per_block=8)
    return rounded(out, "slope", "intercept", digits=4)


@query("slope_through_origin", f"""
select variable, cell_id, {r('sum(value * driver) / sum(driver * driver)')} as slope
from h_maps join a_global_annual using (scenario, year) group by variable, cell_id""", h_maps=_MAPS)
def slope_through_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.slope_through_origin(scenario_maps(spark, sf_dir), A.global_annual(spark, sf_dir), on=["scenario", "year"]), "slope")


# -- histograms --------------------------------------------------------------------------------

@query("histogram_equal", f"""
with s as (select variable, experiment, min(value) as a, max(value) as b from a_annual group by all),
  e as (select s.*, cast(i as int) as bin, a + i * ((b - a) / 150) as lo, case when i = 149 then b else a + (i + 1) * ((b - a) / 150) end as hi from s, range(0, 150) t(i)),
  c as (select e.variable, e.experiment, e.bin, e.lo, e.hi, count(v.value) as n from e left join a_annual v
        on v.variable = e.variable and v.experiment = e.experiment and v.value >= e.lo and (v.value < e.hi or (e.bin = 149 and v.value = e.hi)) group by all)
select variable, experiment, bin, {r('lo')} as lo, {r('hi')} as hi, {r('n / sum(n) over (partition by variable, experiment)')} as frac from c""")
def histogram_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram_equal(A.annual(spark, sf_dir), ["variable", "experiment"]), "lo", "hi", "frac")


@query("histogram_edges", f"""
with n as (select experiment, member, cell_id, year(date) as y, count(*) filter (tas > 300) as value from a_daily group by all),
  e as (select * from (values (0, 1e0, 2e0), (1, 2e0, 4e0), (2, 4e0, 8e0), (3, 8e0, 50e0), (4, 50e0, null)) x(bin, lo, hi)),
  g as (select distinct experiment from n)
select g.experiment, e.bin, e.lo, e.hi, {r('count(n.value) / nullif(sum(count(n.value)) over (partition by g.experiment), 0)')} as frac
from g cross join e left join n on n.experiment = g.experiment and n.value >= e.lo and (n.value < e.hi or e.hi is null)
group by g.experiment, e.bin, e.lo, e.hi""")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.daily(spark, sf_dir, "tas").groupBy("experiment", "member", "cell_id", F.year("date")) \
        .agg(F.count_if(F.col("value") > 300).cast("double").alias("value"))
    return rounded(stats.histogram_edges(days, ["experiment"], [1, 2, 4, 8, 50]), "frac")


# -- series ------------------------------------------------------------------------------------

@query("pad_series", f"""
with n as (select scenario, min(k) as t0, max(k) - min(k) + 1 as n, avg(value) as mean from a_global_monthly group by scenario),
  p as (select n.*, unnest(range(-10, n + 10)) as i from n)
select 'min_norm' as kind, p.scenario, cast(t0 + i as int) as k, {r('coalesce(v.value, mean)')} as value
from p left join a_global_monthly v on v.scenario = p.scenario and v.k = t0 + i
union all select 'min_slope', p.scenario, cast(t0 + i as int), {r('v.value')}
from p join a_global_monthly v on v.scenario = p.scenario and v.k = t0 + case when i < 0 then -i when i >= n then 2 * n - 2 - i else i end
union all select 'min_roughness', p.scenario, cast(t0 + i as int), {r('v.value')}
from p join a_global_monthly v on v.scenario = p.scenario and v.k = t0 + case when i < 0 then -i - 1 when i >= n then 2 * n - 1 - i else i end""")
def pad_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.global_monthly(spark, sf_dir)
    parts = [signal.pad_series(g, ["scenario"], kind, t="k").withColumn("kind", F.lit(kind)) for kind in signal.PAD_KINDS]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


_B, _A, _Z = ([f"({float(x)!r}::double)" for x in part] for part in lowpass_coefficients())


def _pass(name: str, source: str, position: str) -> str:
    """One direction of the recursive filter over (id, ``position``, v)."""
    y = f"(f.z1 + {_B[0]} * s.v)"
    steps = [f"f.z{i + 1} + {_B[i]} * s.v - {_A[i]} * {y}" for i in (1, 2)] + [f"{_B[3]} * s.v - {_A[3]} * {y}"]
    return f"""{name} as (
  select id, cast(0 as bigint) as p, 0e0 as y, {_Z[0]} * v as z1, {_Z[1]} * v as z2, {_Z[2]} * v as z3 from {source} where {position} = 1
  union all select s.id, f.p + 1, {y}, {", ".join(steps)} from {name} f join {source} s on s.id = f.id and s.{position} = f.p + 1)"""


def smooth_sql(source: str, id_: str, t: str, value: str) -> str:
    """Common tables ending in ``smoothed`` (id, t, value): symmetric padding, odd extension, both filter passes."""
    return f"""
  s0 as (select {id_} as id, {t} as t, {value} as v from {source}),
  n as (select id, min(t) as t0, max(t) - min(t) + 1 as n from s0 group by id),
  x as (select n.id, n.t0, n.n + 20 as m, n.i + 10 as j, s0.v from (select *, unnest(range(-10, n + 10)) as i from n) n
        join s0 on s0.id = n.id and s0.t - n.t0 = least((n.i + 40 * n.n) % (2 * n.n), 2 * n.n - 1 - (n.i + 40 * n.n) % (2 * n.n))),
  e as (select id, t0, m, j, v from x
        union all select x.id, x.t0, x.m, -x.j, 2 * z.v - x.v from x join x z on z.id = x.id and z.j = 0 where x.j between 1 and 12
        union all select x.id, x.t0, x.m, 2 * x.m - 2 - x.j, 2 * z.v - x.v from x join x z on z.id = x.id and z.j = x.m - 1 where x.j between x.m - 13 and x.m - 2),
  ahead as (select id, t0, j, m, j + 13 as p, v from e),
  {_pass("fwd", "ahead", "p")},
  back as (select f.id, a.t0, a.m, a.m + 25 - f.p as q, f.y as v from fwd f join ahead a on a.id = f.id and a.p = f.p),
  {_pass("bwd", "back", "q")},
  smoothed as (select b.id, c.t0 + (c.m + 24 - b.p + 1 - 13) - 10 as t, b.y as value from bwd b join (select distinct id, t0, m from back) c on b.id = c.id
        where b.p > 0 and c.m + 24 - b.p + 1 - 13 between 10 and c.m - 11)"""


_SMOOTH = f"with recursive {smooth_sql('a_global_monthly', 'scenario', 'k', 'value')} select id as scenario, cast(t as int) as k, {r('value')} as value from smoothed"


@query("smooth_lowpass", _SMOOTH)
def smooth_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.smooth_lowpass(A.global_monthly(spark, sf_dir), ["scenario"], t="k"), "value")


def band_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response parameters of every band that the data have, from the length of its name."""
    bands = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("band")).distinct()
    n = F.length("band").cast("double")
    return bands.select("band", (n / 200).alias("beta"), (n / 150).alias("alpha"), (n / 25).alias("gamma"), (10 + n * 3).alias("tau"), (0.3 + n / 20).alias("mu"))


BAND_PARAMS = """
select band, n / 200 as beta, n / 150 as alpha, n / 25 as gamma, 10 + n * 3 as tau, 0.3e0 + n / 20 as mu
from (select distinct event_type as band, cast(length(event_type) as double) as n from events) x"""

AOD = """
select a.band, a.k, coalesce(sum(beta * m.value * exp(-(alpha + gamma * m.value) * (a.k - m.k + 1))), 0) as value
from a_injection a join h_params using (band) left join a_injection m on m.band = a.band and m.k <= a.k group by a.band, a.k"""


@query("convolve_decay", f"select band, k, {r('value', 8)} as value from h_aod", h_params=BAND_PARAMS, h_aod=AOD)
def convolve_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.convolve_decay(A.injection(spark, sf_dir), band_params(spark, sf_dir), block=7), "value", digits=8)


# exp(u) erfc(sqrt(u)) = exp(u) - 2/sqrt(pi) * sum_n 2^n x^(2n+1) / (2n+1)!!, x = sqrt(u); all terms are positive
KERNEL = """
select p.band, cast(l as int) as lag, mu * (1 / sqrt(pi() * l / tau) - (exp(l / tau) - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90),
  lambda n: exp(n * ln(2e0) + (2 * n + 1) * ln(sqrt(l / tau)) - (lgamma(2e0 * n + 2) - n * ln(2e0) - lgamma(n + 1e0))))))) as h
from h_params p, (select unnest(range(1, (select cast(max(k) - min(k) as bigint) + 2 from a_injection))) as l) t"""


@query("convolve_kernel", f"""
select a.band, a.k, {r('sum(h * m.value)')} as value from a_injection a join a_injection m on m.band = a.band and m.k <= a.k
join h_kernel k on k.band = a.band and k.lag = a.k - m.k + 1 group by a.band, a.k""", h_params=BAND_PARAMS, h_kernel=KERNEL)
def convolve_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.convolve_kernel(A.injection(spark, sf_dir), band_params(spark, sf_dir), block=7), "value")
