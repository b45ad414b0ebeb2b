"""Registered queries: selecting, aligning, masking, calendar and ordered-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import columns as C
from gridspark.operators import align, spatial, timeops
from gridspark.operators.scenario import unpivot_years
from gridspark.plans import adapters as A
from gridspark.plans.registry import query, r, rounded
from gridspark.schema import DAILY_THRESHOLDS

_SERIES = ["variable", "experiment", "member"]


# -- projections and filters -------------------------------------------------------------------

@query("time_slice", f"select variable, experiment, member, year, cell_id, {r('value')} as value from a_annual where year between 1996 and 1999")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.time_slice(A.annual(spark, sf_dir), 1996, 1999), "value")


@query("select_label", f"select member, year, cell_id, {r('value')} as value from a_annual where variable = 'tas' and experiment = 'O'")
def select_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.select_label(A.annual(spark, sf_dir), variable="tas", experiment="O"), "value")


@query("convert_flux_units", f"""
select 'pr' as variable, experiment, member, date, cell_id, {r('pr * 1000 * 86400')} as value from a_daily
union all select 'p-e', experiment, member, date, cell_id, {r('pr * 86400', 9)} from a_daily
union all select 'tas', experiment, member, date, cell_id, {r('tas')} from a_daily""")
def convert_flux_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr, tas = A.daily(spark, sf_dir, "pr"), A.daily(spark, sf_dir, "tas")
    both = align.stack_dim({"pr": pr, "p-e": pr, "tas": tas}, "variable")
    out = both.withColumn("value", C.flux_to_mm_day("variable", "value"))
    tiny = F.col("variable") == "p-e"
    return rounded(out.filter(~tiny), "value").unionByName(rounded(out.filter(tiny), "value", digits=9))


@query("floor_zero", f"""
select variable, experiment, member, year, cell_id, {r("case when value - 25 > 0 then value - 25 else 0 end")} as value
from (select * replace (case when value < 15 then null else value end as value) from a_annual) x""")
def floor_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = A.annual(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 15, F.col("value")))
    return rounded(some.withColumn("value", C.floor_zero(F.col("value") - 25)), "value")


@query("mask_cells", f"""
select variable, experiment, member, year, a.cell_id, case when l.cell_id is not null then {r('value')} end as value
from a_annual a left join a_land l on a.cell_id = l.cell_id""")
def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = spatial.land_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))
    return rounded(align.mask_cells(A.annual(spark, sf_dir), land), "value")


@query("drop_degenerate_days", """
select experiment, member, date, cell_id, v as value from (
  select *, case when (day(date) + length(member)) % 5 = 0 then 0e0 else tas end as v from a_obs_daily) x
where (day(date) + 1) % 5 <> 0""")
def drop_degenerate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = (F.day("date") + F.length("member")) % 5 == 0
    obs = A.obs_daily(spark, sf_dir).withColumn("value", F.when(empty, F.lit(0.0)).otherwise(F.col("tas"))).drop("tas", "pr")
    return align.drop_degenerate_days(obs, ["experiment", "member"])


@query("shift_lon", """
select cell_id, case when lon > 180 then lon - 360 else lon end as lon_180, (lon + 180) % 360 as lon_population,
       (lon + 180) % 360 - 180 as lon_country from a_cells""")
def shift_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    return cells.select("cell_id", C.lon_to_180("lon").alias("lon_180"), C.population_lon("lon").alias("lon_population"),
                        C.lon_wrap_180("lon").alias("lon_country"))


@query("tag_dims", f"select 'ssp245' as scenario, 'M' as model, variable, year, cell_id, {r('value')} as amount from a_annual")
def tag_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = rounded(A.annual(spark, sf_dir), "value")
    return align.tag_dims(annual, {"scenario": "ssp245", "model": "M"}, {"value": "amount"}, ["experiment", "member"],
                          ["scenario", "model", "variable", "year", "cell_id", "amount"])


# -- joins -------------------------------------------------------------------------------------

@query("align_binary", f"""
select variable, experiment, member, year, a.cell_id, {r('a.value * p.persons / 1013', 5)} as value
from a_annual a join a_population p on a.cell_id = p.cell_id""")
def align_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    people = A.population(spark, sf_dir).withColumn("value", F.col("persons") / 1013).drop("persons")
    return rounded(align.align_binary(annual, people, "*"), "value", digits=5)


@query("sum_components", f"""
select experiment, member, date, cell_id, {r('pr + tas')} as value from a_obs_daily where tas > 10 and pr > 20000""")
def sum_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.obs_daily(spark, sf_dir)
    keys = ["experiment", "member", "date", "cell_id"]
    convective = obs.filter("tas > 10").select(*keys, F.col("tas").alias("value"))
    large_scale = obs.filter("pr > 20000").select(*keys, F.col("pr").alias("value"))
    return rounded(align.sum_components(convective, large_scale, keys), "value")


@query("unpaired_components", """
select experiment, member, date, cell_id from a_obs_daily where (tas > 10) <> (pr > 20000)""")
def unpaired_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.obs_daily(spark, sf_dir)
    return align.unpaired_components(obs.filter("tas > 10"), obs.filter("pr > 20000"), ["experiment", "member", "date", "cell_id"])


@query("precip_minus_evap", f"select experiment, member, year, cell_id, {r('pr - tas')} as value from a_annual_wide")
def precip_minus_evap(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    pr, evap = (annual.filter(F.col("variable") == v).drop("variable") for v in ("pr", "tas"))
    return rounded(align.precip_minus_evap(pr, evap, ["experiment", "member", "year", "cell_id"]), "value")


@query("population_exposure", f"""
select variable, experiment, member, year, a.cell_id, {r('value * persons / 1000000')} as value
from a_annual a join a_population p on a.cell_id = p.cell_id""")
def population_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.population_exposure(A.annual(spark, sf_dir), A.population(spark, sf_dir)), "value")


@query("outer_scale", f"""
select c.cell_id, g.scenario, g.year, {r('c.lat * g.driver')} as value from a_cells c cross join a_global_annual g""")
def outer_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = A.cells(spark, sf_dir).select("cell_id", F.col("lat").alias("slope"))
    return rounded(align.outer_scale(pattern, A.global_annual(spark, sf_dir)), "value")


@query("point_in_polygon", "select region_id, region, cell_id from a_inside")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.point_in_polygon(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))


@query("land_mask", "select cell_id from a_land")
def land_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.land_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))


@query("clip_to_land", f"select variable, experiment, member, year, cell_id, {r('value')} as value from a_annual where cell_id in (select cell_id from a_land)")
def clip_to_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = spatial.land_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))
    return rounded(spatial.clip_to_land(A.annual(spark, sf_dir), land), "value")


@query("region_mask", f"""
select variable, experiment, member, year, cell_id, {r('value')} as value from a_annual
where cell_id in (select cell_id from a_inside where region = 'AFRICA')""")
def region_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = spatial.region_mask(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir), "AFRICA")
    return rounded(align.mask_cells(A.annual(spark, sf_dir), mask, drop=True), "value")


_COUNTRY = """
select c.cell_id, coalesce(h.country, 0) as country from a_cells c left join (
  select cell_id, cast(min(region_id) + 1 as int) as country from (
    select e.region_id, e.part_id, c.cell_id from (select cell_id, lat, (lon + 180) % 360 - 180 as x from a_cells) c
    join a_region_edges e on (e.y1 > c.lat) <> (e.y2 > c.lat) and c.x < e.x1 + (c.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
    group by all having count(*) % 2 = 1) p group by cell_id) h on c.cell_id = h.cell_id"""


@query("assign_country", "select cell_id, country from h_country", h_country=_COUNTRY)
def assign_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.assign_country(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))


@query("country_totals", f"""
select variable, experiment, member, year, a.cell_id, c.country,
  case when c.country = 0 then 0 else {r('sum(value) over (partition by variable, experiment, member, year, c.country)')} end as value
from a_annual a join h_country c on a.cell_id = c.cell_id""", h_country=_COUNTRY)
def country_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = spatial.assign_country(A.cells(spark, sf_dir), A.region_edges(spark, sf_dir))
    return rounded(spatial.country_totals(A.annual(spark, sf_dir), countries, [*_SERIES, "year"]), "value")


@query("match_time", f"""
select variable, experiment, member, year, cell_id, {r('value')} as value from a_annual
where year in (select year from a_global_annual where driver > 2)""")
def match_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.match_time(A.annual(spark, sf_dir), A.global_annual(spark, sf_dir).filter("driver > 2")), "value")


@query("sweep_grid", """
select s.scenario, v.variable, cast(t.t as int) as target_tenths, printf('%.1f', t.t / 10e0) as target_key, cast(y.y as int) as start_year
from (select distinct scenario from a_global_annual) s, (values ('tas'), ('pr'), ('exposure_above_35')) v(variable),
  range(5, 26) t(t), range(2035, 2091) y(y)""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sweep_grid(spark, A.global_annual(spark, sf_dir), ["tas", "pr", "exposure_above_35"])


@query("common_scenarios", "select distinct o_orderpriority as scenario from orders where o_totalprice > 250000 intersect select o_orderpriority from orders where o_orderstatus = 'P'")
def common_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "scenario")
    return align.common_scenarios(orders.filter("o_totalprice > 250000"), orders.filter("o_orderstatus = 'P'"))


@query("overlay_override", f"""
select s.scenario, s.specie, s.config, s.t, {r("case when s.specie = 'Brand#1' and s.t >= 1998 then 0 else coalesce(-0.28 * o.co2, s.emissions) end")} as value
from a_scenario_series s left join (select cast(t as int) as t, co2 from a_three_gas where scenario = '1-URGENT' and t between 1998 and 2000) o
on s.t = o.t and s.specie = 'Brand#2'""")
def overlay_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = A.scenario_series(spark, sf_dir).withColumnRenamed("emissions", "value").drop("concentration")
    path = A.three_gas(spark, sf_dir).filter("scenario = '1-URGENT' and t between 1998 and 2000") \
        .select(F.lit("Brand#2").alias("specie"), "t", F.col("co2").alias("value"))
    zero = (F.col("specie") == "Brand#1") & (F.col("t") >= 1998)
    return rounded(align.overlay_override(series, path, ["specie", "t"], zero=zero, factor=-0.28), "value")


@query("overlay_override_by_scenario", f"""
select p.path, s.scenario, s.specie, s.config, s.t, {r("case when s.specie = 'Brand#1' and s.t >= 1998 then 0 else coalesce(-0.28 * o.co2, s.emissions) end")} as value
from a_scenario_series s cross join (select distinct scenario as path from a_three_gas) p
left join (select scenario as path, cast(t as int) as t, co2 from a_three_gas where t between 1998 and 2000) o
on p.path = o.path and s.t = o.t and s.specie = 'Brand#2'""")
def overlay_override_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    gas = A.three_gas(spark, sf_dir).withColumnRenamed("scenario", "path")
    series = A.scenario_series(spark, sf_dir).withColumnRenamed("emissions", "value").drop("concentration")
    series = align.blocked_product(series, gas.select("path").distinct(), "specie")
    paths = gas.filter("t between 1998 and 2000").select("path", F.lit("Brand#2").alias("specie"), "t", F.col("co2").alias("value"))
    zero = (F.col("specie") == "Brand#1") & (F.col("t") >= 1998)
    return rounded(align.overlay_override(series, paths, ["path", "specie", "t"], zero=zero, factor=-0.28), "value")


@query("splice_before", f"""
with w as (select experiment, member, year, cell_id, value from a_annual where variable = 'tas'),
     n as (select experiment, member, year, cell_id, value from a_annual where variable = 'pr'),
     f as (select member, min(year) as first from (select member, year, sum(value) as s from w group by all) where s > 0 and year > 1996 group by member)
select w.experiment, w.member, w.year, w.cell_id, {r("case when w.year < case when w.member = 'A' then 9999 else f.first end and n.value is not null then n.value else w.value end")} as value
from w left join n using (experiment, member, year, cell_id) join f on w.member = f.member""")
def splice_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    with_, without = (annual.filter(F.col("variable") == v).drop("variable") for v in ("tas", "pr"))
    starts = align.first_nonzero_year(with_.filter("year > 1996"), ["member"])
    starts = starts.withColumn("first_year", F.when(F.col("member") != "A", F.col("first_year")))
    return rounded(align.splice_before(with_, without, ["experiment", "member", "cell_id"], starts=starts), "value")


@query("append_history", f"""
select variable, 'O' as experiment, member, year, cell_id, {r('value')} as value from a_annual where experiment = 'F' and year <= 1997
union all select variable, experiment, member, year, cell_id, {r('value')} from a_annual where experiment = 'O' and year > 1997""")
def append_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.annual(spark, sf_dir)
    out = align.append_history(annual.filter("experiment = 'F'"), annual.filter("experiment = 'O' and year > 1997"), 1997, "O")
    return rounded(out, "value")


@query("join_series", """
select 'before' as part, scenario, year, driver from a_global_annual where year <= 1999
union all select 'after', scenario, year, driver from a_global_annual where year >= 1999""")
def join_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.global_annual(spark, sf_dir)
    whole = align.join_series(g.filter("year < 1997"), g.filter("year between 1997 and 1998"), g.filter("year > 1998"))
    before, after = align.split_series(whole, 1998)
    return align.stack_dim({"before": before, "after": after}, "part")


@query("stack_dim", """
select 'gas' as sample, scenario, cast(t as int) as year, co2 as driver from a_three_gas union all select 'global', scenario, year, driver from a_global_annual""")
def stack_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    gas = A.three_gas(spark, sf_dir).select("scenario", F.col("t").alias("year"), F.col("co2").alias("driver"))
    return align.stack_dim({"gas": gas, "global": A.global_annual(spark, sf_dir)}, "sample")


@query("sort_axis", "select scenario, year, driver from a_global_annual order by scenario, year")
def sort_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sort_axis(A.global_annual(spark, sf_dir), "scenario", "year")


@query("bilinear_regrid", f"""
with rows as (select distinct lat_idx, lat from a_cells), cols as (select distinct lon_idx, lon from a_cells),
  t as (select row_number() over (order by la.lat, lo.lon) - 1 as cell, la.lat as tlat, lo.lon as tlon
        from (select distinct lat + 4.5 as lat from rows) la, (select distinct lon + 9e0 as lon from cols) lo),
  la as (select tlat, max(s.lat) as l0 from (select distinct tlat from t) x join rows s on s.lat <= tlat group by tlat),
  lb as (select tlat, min(s.lat) as l1 from (select distinct tlat from t) x join rows s on s.lat >= tlat group by tlat),
  ring as (select lon from cols union all select min(lon) + 360 from cols union all select max(lon) - 360 from cols),
  oa as (select tlon, max(s.lon) as o0 from (select distinct tlon from t) x join ring s on s.lon <= tlon group by tlon),
  ob as (select tlon, min(s.lon) as o1 from (select distinct tlon from t) x join ring s on s.lon >= tlon group by tlon),
  w as (select t.tlat, t.tlon, la.l0, lb.l1, oa.o0, ob.o1, (t.tlat - la.l0) / (lb.l1 - la.l0) as fy, (t.tlon - oa.o0) / (ob.o1 - oa.o0) as fx
        from t left join la using (tlat) left join lb using (tlat) left join oa using (tlon) left join ob using (tlon)),
  v as (select variable, experiment, member, year, lat, lon, value from a_annual join a_cells using (cell_id)),
  k as (select distinct variable, experiment, member, year from v),
  q as (select k.*, w.*, g00.value as v00, g01.value as v01, g10.value as v10, g11.value as v11 from k cross join w
    left join v g00 on (g00.variable, g00.experiment, g00.member, g00.year) = (k.variable, k.experiment, k.member, k.year) and g00.lat = w.l0 and g00.lon = (w.o0 + 360) % 360
    left join v g01 on (g01.variable, g01.experiment, g01.member, g01.year) = (k.variable, k.experiment, k.member, k.year) and g01.lat = w.l0 and g01.lon = w.o1 % 360
    left join v g10 on (g10.variable, g10.experiment, g10.member, g10.year) = (k.variable, k.experiment, k.member, k.year) and g10.lat = w.l1 and g10.lon = (w.o0 + 360) % 360
    left join v g11 on (g11.variable, g11.experiment, g11.member, g11.year) = (k.variable, k.experiment, k.member, k.year) and g11.lat = w.l1 and g11.lon = w.o1 % 360)
select variable, experiment, member, year, tlat as lat, tlon as lon,
  {r('(1 - fy) * ((1 - fx) * v00 + fx * v01) + fy * ((1 - fx) * v10 + fx * v11)')} as value
from q""")
def bilinear_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    # the target grid lies a quarter of a row up and a quarter of a column east; its top row has no source above
    target = cells.select((F.col("cell_id") + 1000).alias("cell_id"), "lat_idx", "lon_idx",
                          (F.col("lat") + 4.5).alias("lat"), (F.col("lon") + 9).alias("lon"))
    out = spatial.bilinear_regrid(A.annual(spark, sf_dir), cells, target, ["variable", "experiment", "member", "year"])
    out = out.join(target.select("cell_id", "lat", "lon"), "cell_id").drop("cell_id")
    return rounded(out, "value")


# -- calendar ----------------------------------------------------------------------------------

def _daily_tas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily(spark, sf_dir, "tas")


_KEYS = ["experiment", "member", "cell_id"]


@query("daily_to_monthly_max", "select experiment, member, cell_id, cast(year(date) as int) as year, cast(month(date) as int) as month, max(tas) as value from a_daily group by all")
def daily_to_monthly_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeops.daily_to_monthly_max(_daily_tas(spark, sf_dir), _KEYS)


@query("daily_to_monthly_min", "select experiment, member, cell_id, cast(year(date) as int) as year, cast(month(date) as int) as month, min(tas) as value from a_daily group by all")
def daily_to_monthly_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeops.daily_to_monthly_min(_daily_tas(spark, sf_dir), _KEYS)


@query("daily_exceedance_days", """
select experiment, member, cell_id, cast(year(date) as int) as year, cast(month(date) as int) as month,
  count(*) filter (tas > 313.15e0) as tas_above_40, count(*) filter (tas > 308.15e0) as tas_above_35, count(*) filter (tas < 273.15e0) as tas_below_0
from a_daily group by all""")
def daily_exceedance_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeops.daily_exceedance_days(_daily_tas(spark, sf_dir), _KEYS, DAILY_THRESHOLDS["tas"])


@query("monthly_to_annual", f"""
select v.variable, experiment, member, cell_id, year, {r("case v.variable when 'tasmin' then min(value) when 'tasmax' then max(value) when 'tas_above_35' then sum(value) else avg(value) end")} as value
from a_monthly, (values ('tas'), ('tasmin'), ('tasmax'), ('tas_above_35')) v(variable) group by v.variable, experiment, member, cell_id, year""")
def monthly_to_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.monthly(spark, sf_dir)
    several = m.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in ("tas", "tasmin", "tasmax", "tas_above_35")])))
    return rounded(timeops.monthly_to_annual(several, ["variable", *_KEYS]), "value")


@query("ensemble_mean", f"select variable, experiment, year, cell_id, {r('avg(value)')} as value from a_annual group by all")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.ensemble_mean(A.annual(spark, sf_dir), ["member"]), "value")


@query("climatology", f"""
select variable, experiment, cell_id, w.name as "window", {r('avg(value)')} as value
from a_annual join (values ('early', 1995, 1998), ('late', 1998, 2001)) w(name, a, b) on year between a and b
group by variable, experiment, cell_id, w.name""")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeops.climatology(A.annual(spark, sf_dir), ["variable", "experiment", "cell_id"], {"early": (1995, 1998), "late": (1998, 2001)})
    return rounded(out, "value")


@query("rebase", f"""
select a.variable, a.experiment, a.member, a.year, a.cell_id, {r('value - base')} as value from a_annual a left join (
  select variable, experiment, member, cell_id, avg(value) as base from a_annual where year between 1995 and 1996 group by all) b
using (variable, experiment, member, cell_id)""")
def rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.rebase(A.annual(spark, sf_dir), [*_SERIES, "cell_id"], (1995, 1996)), "value")


@query("decadal_means", f"""
select variable, experiment, cell_id, cast(ceil((year - 1994) / 2e0) * 2 + 1994 as int) as decade_end, {r('avg(value)')} as value
from a_annual where year between 1995 and 2000 group by all""")
def decadal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeops.decadal_means(A.annual(spark, sf_dir), ["variable", "experiment", "cell_id"], origin=1994, decades=3, width=2)
    return rounded(out, "value")


@query("band_total", f"select k, {r('sum(value)')} as value from a_injection group by k")
def band_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.band_total(A.injection(spark, sf_dir), ["k"]), "value")


@query("detrend_linear", f"""
select variable, experiment, member, year, cell_id, {r('value - coalesce(regr_slope(value, year) over w * (year - regr_avgx(value, year) over w), 0) - avg(value) over w')} as value
from a_annual window w as (partition by variable, experiment, member, cell_id)""")
def detrend_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.detrend_linear(A.annual(spark, sf_dir), [*_SERIES, "cell_id"]), "value")


@query("assert_monthly_contiguous", """
select experiment, member, cell_id, cast(m // 12 as int) as year, cast(m % 12 + 1 as int) as month, cast(m - p as int) as gap_months from (
  select *, lag(m) over (partition by experiment, member, cell_id order by m) as p from (
    select distinct experiment, member, cell_id, year * 12 + month - 1 as m from a_monthly)) x where m - p <> 1""")
def assert_monthly_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeops.assert_monthly_contiguous(A.monthly(spark, sf_dir), _KEYS)


@query("assign_noleap_dates", """
with d as (select *, row_number() over (partition by experiment, member order by date) - 1 as i from (select distinct experiment, member, date from a_obs_daily))
select o.experiment, o.member, o.date, o.cell_id, o.tas, make_date(2015 + cast(d.i // 365 as bigint),
  cast(month(date '2001-01-01' + cast(d.i % 365 as int)) as bigint), cast(day(date '2001-01-01' + cast(d.i % 365 as int)) as bigint)) as noleap_date
from a_obs_daily o join d on (o.experiment, o.member, o.date) = (d.experiment, d.member, d.date) where d.i < 1800""")
def assign_noleap_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeops.assign_noleap_dates(A.obs_daily(spark, sf_dir).drop("pr"), ["experiment", "member"], 2015, 1800)


# -- ordered series ----------------------------------------------------------------------------

@query("gate_and_ramp", f"""
with g as (select scenario, year, 2.5 - driver as diff, driver as value from a_global_annual),
  f as (select scenario, min(year) as first from g where not diff > 0 group by scenario)
select g.scenario, g.year, diff as temp_diff, {r('''case when diff > 0 then 0 else value end * case when g.year - first + 1 between 1 and least(3, 2001 - first)
  then (g.year - first + 1) / cast(least(3, 2001 - first) as double) else 1 end''')} as value
from (select scenario, year, round(diff, 6) as diff, value from g) g left join f on g.scenario = f.scenario""")
def gate_and_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.global_annual(spark, sf_dir).select("scenario", "year", F.round(F.lit(2.5) - F.col("driver"), 6).alias("temp_diff"), F.col("driver").alias("value"))
    return rounded(timeops.gate_and_ramp(g, ["scenario"], 3, last_year=2001), "value")


@query("first_nonzero_year", """
select band, min(case when s > 0 then k end) as first_year from (
  select band, k, sum(case when k < 4 + length(band) then 0 else value end) as s from a_injection group by band, k) x group by band""")
def first_nonzero_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("k") < 4 + F.length("band"), F.lit(0.0)).otherwise(F.col("value"))
    return align.first_nonzero_year(A.injection(spark, sf_dir).withColumn("value", late), ["band"], year="k")


@query("cumulative", f"""
select scenario, config, specie, t, case when max(cast(v is null as int)) over w = 0 then {r('sum(v) over w * 0.5 + 10')} end as cumulative
from (select *, case when emissions > 40 or t < 1998 then emissions end as v from a_scenario_series) x
window w as (partition by scenario, config, specie order by t rows unbounded preceding)""")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.scenario_series(spark, sf_dir).withColumn("value", F.when((F.col("emissions") > 40) | (F.col("t") < 1998), F.col("emissions")))
    out = timeops.cumulative(s, ["scenario", "config", "specie"], step=0.5, initial=10.0, block=3)
    return rounded(out.select("scenario", "config", "specie", "t", "cumulative"), "cumulative")


_KNOWN = """
select x.*, (select max_by(y.value, y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t <= x.t and y.value is not null) as v0,
  (select max(y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t <= x.t and y.value is not null) as t0,
  (select min_by(y.value, y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t >= x.t and y.value is not null) as v1,
  (select min(y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t >= x.t and y.value is not null) as t1
from a_scenario_long x"""


@query("interpolate_gaps", f"""
select scenario, variable, t, {r('case when value is not null then value when t1 is null then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end', 8)} as value from h_known""",
       h_known=_KNOWN)
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["scenario", "region", "variable", "unit"]
    long = unpivot_years(A.scenario_wide(spark, sf_dir), keys, "y")
    return rounded(timeops.interpolate_gaps(long, keys, block=3).select("scenario", "variable", "t", "value"), "value", digits=8)


@query("resample_axis", f"""
with p as (select scenario, variable, t + 0.5 as t, value from a_scenario_long where value is not null),
  s as (select scenario, variable, t as ta, value as va, lead(t) over w as tb, lead(value) over w as vb,
          row_number() over w as i, count(*) over (partition by scenario, variable) as n from p window w as (partition by scenario, variable order by t)),
  axis as (select 1993 + i * 0.5 as x from range(0, 23) r(i))
select scenario, variable, cast(x as double) as t,
  case when x between 1994 and 2003 then {r('va + (vb - va) * (x - ta) / (tb - ta)', 8)} end as value
from s join axis on tb is not null and (x >= ta or i = 1) and (x < tb or i = n - 1)""")
def resample_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = unpivot_years(A.scenario_wide(spark, sf_dir), ["scenario", "region", "variable", "unit"], "y")
    points = long.withColumn("t", F.col("t") + 0.5)
    out = timeops.resample_axis(points, ["scenario", "variable"], 1993.0, 2004.0, 0.5, valid=(1994, 2003), block=2)
    return rounded(out, "value", digits=8)


@query("monthly_expand", f"""
select scenario, year, {r('driver / 12', 9)} as value, cast(m as int) as month from a_global_annual, range(1, 13) r(m)""")
def monthly_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.global_annual(spark, sf_dir).withColumnRenamed("driver", "value")
    return rounded(timeops.monthly_expand(g), "value", digits=9)


@query("annual_mean_12", f"select scenario, cast(k // 12 + 1995 as int) as year, {r('avg(value)')} as value from a_global_monthly group by all")
def annual_mean_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.annual_mean_12(A.global_monthly(spark, sf_dir), ["scenario"], start_year=1995), "value")


# -- scalar functions --------------------------------------------------------------------------

@query("math", f"""
select cell_id, {r('cos(radians(lat))')} as weight, {r('exp(-lat / 90)')} as e, {r('ln(lon + 1)')} as l, {r('sqrt(lon)')} as s,
  abs(lat) as a, {r('pow(lon / 360, 2)')} as p, lon % 100 as m, {r('0.1 + lat_idx * 0.1')} as ramp from a_cells""")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lat, lon = A.cells(spark, sf_dir), F.col("lat"), F.col("lon")
    out = c.select("cell_id", C.lat_weight("lat").alias("weight"), F.exp(-lat / 90).alias("e"), F.ln(lon + 1).alias("l"),
                   F.sqrt(lon).alias("s"), F.abs(lat).alias("a"), F.pow(lon / 360, F.lit(2)).alias("p"), F.pmod(lon, F.lit(100.0)).alias("m"),
                   F.element_at(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i / 10), F.col("lat_idx") + 1).alias("ramp"))
    return rounded(out, "weight", "e", "l", "s", "p", "ramp")


@query("strings", """
select p_partkey, string_split(p_type || '.' || p_name, '.')[1] as head, ends_with(p_brand, '7') as ends, replace(p_brand, '#', '') as clean,
  contains(p_name, 'red') as has, printf('%.1f', p_size / 10e0) as key from part""")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.split(F.concat_ws(".", "p_type", "p_name"), r"\."), 1).alias("head"), F.endswith("p_brand", F.lit("7")).alias("ends"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("clean"), F.contains("p_name", F.lit("red")).alias("has"), C.target_key("p_size").alias("key"))


@query("dates", """
select strftime(date, '%Y%m') as ym, cast(year(date) as int) as year, cast(date_trunc('month', date) as date) as month_start,
  make_date(year(date), 12, 31) as year_end, count(*) as n from a_obs_daily group by all""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.obs_daily(spark, sf_dir)
    return d.groupBy(C.year_month_key("date").alias("ym"), F.year("date").alias("year"), F.trunc("date", "month").alias("month_start"),
                     F.make_date(F.year("date"), F.lit(12), F.lit(31)).alias("year_end")).agg(F.count("*").alias("n"))
