"""Registered queries: batch jobs, maps, deltas, injections, summaries and the sweep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import spatial, stats, timeops
from gridspark.operators.align import blocked_product
from gridspark.plans import adapters as A
from gridspark.plans import products as P
from gridspark.plans import vectors as V
from gridspark.plans.queries_fields import _COUNTRY
from gridspark.plans.queries_statistics import _DRAWS, _MAPS, BAND_PARAMS, KERNEL, band_params, label_maps, smooth_sql
from gridspark.plans.registry import query, r, rounded
from gridspark.scratch import scratch_path, settle
from gridspark.sources import grid

VARIABLES = ["tas", "pr", "tas_above_35", "exposure_above_35"]

# -- stand-in inputs ---------------------------------------------------------------------------

_FIELD = """
select variable, experiment, member, year, cell_id, value from a_annual
union all select 'tas_above_35', experiment, member, cast(year(date) as int), cell_id, cast(count(*) filter (tas > 35) as double) from a_obs_daily group by all"""
_PMAP = """
select variable, 'baseline' as experiment, year, cell_id, avg(value) as value from h_field where experiment = 'F' group by all
union all select variable, 'cmip_historical', year, cell_id, value from h_field where experiment = 'F' and member = 'A'
union all select variable, case member when 'A' then '1.5' when 'N' then '1.0' else '0.5' end, year, cell_id, value from h_field where experiment = 'O'"""
_COEF = """
select variable, cell_id, avg(b) as slope, avg(a) as intercept from (
  select variable, member, cell_id, coalesce(regr_slope(value, year - 1995), 0) as b, coalesce(regr_intercept(value, year - 1995), avg(value)) as a
  from h_field where experiment = 'F' group by variable, member, cell_id) x group by variable, cell_id"""
# maps of all wanted variables: day counts floored, land only, exposures weighted
_SHAPE = """
select {keys}, v.variable, x.year, x.cell_id, case when v.people then y.value * p.persons / 1000000 else y.value end as value
from {source} x
join (values ('tas', 'tas', false, false, false), ('pr', 'pr', false, true, false), ('tas_above_35', 'tas_above_35', true, true, false),
  ('exposure_above_35', 'tas_above_35', true, true, true)) v(variable, source, floored, land, people) on v.source = x.variable
join lateral (select case when v.floored and {floor} then greatest(x.value, 0) else x.value end as value) y on true
left join a_population p on p.cell_id = x.cell_id
where (not v.land or x.cell_id in (select cell_id from a_land)) and (not v.people or p.persons is not null)"""
_HISTORY = _SHAPE.format(keys="1 as one", floor="true", source="""(select * from h_pmap where year <= 1998
  and experiment = case when variable in ('tas', 'pr') then 'baseline' else 'cmip_historical' end)""")
_BASE = "select variable, cell_id, avg(value) as value from h_history where year between 1995 and 1996 group by variable, cell_id"
_RAWMAP = _SHAPE.format(keys="x.scenario", floor="true", source="""(
  select c.variable, g.scenario, g.year, c.cell_id, c.slope * g.driver / 0.97e0 + c.intercept as value from h_coef c cross join a_global_annual g where g.year >= 1996)""")
_MAP = """
select m.variable, m.scenario, m.year, m.cell_id, case when m.variable in ('tas', 'pr') then m.value - b.value else m.value end as value
from h_rawmap m left join h_base b using (variable, cell_id)"""
_GAP = """
select scenario, cast(t as int) as target_tenths, year, round(t / 10e0 - mean, 9) as temp_diff from (
  select scenario, year, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) as mean from h_map join a_cells using (cell_id)
  where variable = 'tas' group by scenario, year) x, (values (-20), (0), (25)) v(t)"""
_SLOPES = """
select variable, cell_id, sum(driver * value) / sum(driver * driver) as slope from h_change join h_x using (target) group by variable, cell_id"""
_CHANGE = """
select e.variable, e.target, e.cell_id, e.m - b.m as value from (
  select variable, experiment as target, cell_id, avg(value) as m from h_pmap where experiment in ('1.5', '1.0', '0.5') and year between 1997 and 2000 group by all) e
join (select variable, cell_id, avg(value) as m from h_pmap where experiment = 'baseline' and year between 1997 and 2000 group by all) b using (variable, cell_id)"""
_X = """
select target, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) as driver from h_change join a_cells using (cell_id) where variable = 'tas' group by target"""
# gate and ramp from 1997 on, three ramp years, axis ending in 2001
_RAMPED = """
select g.scenario, g.target_tenths, g.year, case when temp_diff > 0 then 0 else temp_diff end
  * case when g.year - first + 1 between 1 and least(3, 2001 - first) then (g.year - first + 1) / cast(least(3, 2001 - first) as double) else 1 end as driver
from h_gap g left join (select scenario, target_tenths, min(year) filter (not temp_diff > 0) as first from h_gap where year >= 1997 group by all) f using (scenario, target_tenths)
where g.year >= 1997"""
_DELTA = _SHAPE.format(keys="x.scenario, x.target_tenths", floor="false", source="""(
  select s.variable, d.scenario, d.target_tenths, d.year, s.cell_id, s.slope * d.driver as value from h_slopes s cross join h_ramped d)""")
H = dict(h_field=_FIELD, h_pmap=_PMAP, h_coef=_COEF, h_history=_HISTORY, h_base=_BASE, h_rawmap=_RAWMAP, h_map=_MAP, h_gap=_GAP,
         h_slopes=_SLOPES, h_change=_CHANGE, h_x=_X, h_ramped=_RAMPED, h_delta=_DELTA)


class Inputs:
    """Stand-in inputs of the products, reduced from the driver tables; built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._field: DataFrame | None = None
        self._coef: DataFrame | None = None
        # the products read each of these several times
        self.cells, self.population = settle(A.cells(spark, sf_dir), "cells"), settle(A.population(spark, sf_dir), "population")
        self.land = settle(spatial.land_mask(self.cells, A.region_edges(spark, sf_dir)), "land")
        self.series = settle(A.global_annual(spark, sf_dir).withColumn("driver", F.col("driver") / F.lit(0.97)), "series")

    def field(self) -> DataFrame:
        """Members' annual fields; written once, as the products read them from tables."""
        if self._field is None:
            self._field = settle(self._reduce(), "field")
        return self._field

    def _reduce(self) -> DataFrame:
        obs = A.obs_daily(self.spark, self.sf_dir)
        wide = obs.groupBy("experiment", "member", F.year("date").alias("year"), "cell_id").agg(
            (F.avg("tas") / F.lit(0.97)).alias("tas"), (F.avg("pr") / 1013).alias("pr"),
            F.count_if(F.col("tas") > 35).cast("double").alias("tas_above_35"))
        return wide.unpivot(["experiment", "member", "year", "cell_id"], ["tas", "pr", "tas_above_35"], "variable", "value")

    def annual(self) -> DataFrame:
        f = self.field()
        e = F.when(F.col("member") == "A", "1.5").when(F.col("member") == "N", "1.0").otherwise("0.5")
        keys = ["variable", "experiment", "year", "cell_id", "value"]
        past = f.filter("experiment = 'F'")
        mean = past.groupBy("variable", "year", "cell_id").agg(F.avg("value").alias("value")).withColumn("experiment", F.lit("baseline"))
        one = past.filter("member = 'A'").withColumn("experiment", F.lit("cmip_historical"))
        runs = f.filter("experiment = 'O'").withColumn("experiment", e)
        return mean.select(*keys).unionByName(one.select(*keys)).unionByName(runs.select(*keys))

    def coef(self) -> DataFrame:
        if self._coef is None:
            rows = self.field().filter("experiment = 'F'").withColumn("x", F.col("year") - 1995)
            fits = timeops.linear_fit(rows, ["variable", "member", "cell_id"], "x").withColumnRenamed("member", "replicate")
            self._coef = settle(fits.withColumn("model", F.lit("M")), "coef")
        return self._coef

    def history(self) -> DataFrame:
        return P.historical_map(self.annual(), VARIABLES, self.land, self.population, 1998)

    def base(self) -> DataFrame:
        return settle(P.baseline_map(self.history(), (1995, 1996)), "baseline")

    def maps(self, base: DataFrame | None = None) -> DataFrame:
        return P.predict_map(self.coef(), self.series, VARIABLES, self.land, self.population, base or self.base(), first_year=1996)

    def gap(self, base: DataFrame | None = None) -> DataFrame:
        gap = P.pattern_gap(self.coef(), self.series, self.cells, [-20, 0, 25], base or self.base(), first_year=1996)
        return gap.withColumn("temp_diff", F.round("temp_diff", 9))

    def slopes(self) -> DataFrame:
        return P.fit_delta(self.annual(), self.cells, window=(1997, 2000))[0]

    def delta(self) -> DataFrame:
        return P.regional_delta(self.slopes(), settle(self.gap(), "gap"), VARIABLES, self.land, self.population, 1997, 3, last_year=2001)


# -- jobs --------------------------------------------------------------------------------------

_MONTHLY = """
select experiment, member, cell_id, cast(year(date) as int) as year, cast(month(date) as int) as month, {0} as variable, cast({1} as double) as value from a_daily group by all"""


@query("process_daily", " union all ".join(_MONTHLY.format(repr(v), x) for v, x in [
    ("tasmax", "max(tas)"), ("tasmin", "min(tas)"), ("tas_above_40", "count(*) filter (tas > 313.15e0)"), ("tas_above_35", "count(*) filter (tas > 308.15e0)"),
    ("tas_below_0", "count(*) filter (tas < 273.15e0)"), ("pr_above_10", "count(*) filter (pr * 1000 * 86400 > 10)"), ("pr_above_20", "count(*) filter (pr * 1000 * 86400 > 20)")]))
def process_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    tas, pr = A.daily(spark, sf_dir, "tas"), A.daily(spark, sf_dir, "pr")
    return P.process_daily(tas, "tas").unionByName(P.process_daily(pr, "pr"))


_MONTHS = """
select m.*, v.variable, v.f * m.value as x from (
  select experiment, member, cell_id, cast(year(date) as int) as year, cast(month(date) as int) as month, avg(tas) / 0.97e0 as value from a_obs_daily group by all) m,
  (values ('tas', 1e0), ('tasmax', 1.5e0), ('tas_above_35', 2e0), ('pr', 1e-9), ('p-e', 2e-7)) v(variable, f)"""
_ANNUAL = """
select variable, case experiment when 'O' then 'baseline' when 'F' then 'historical' end as experiment, member, cell_id, year,
  case when variable = 'tasmax' then max(x) when variable = 'tas_above_35' then sum(x) when variable = 'pr' then avg(x * 86400000) when variable = 'p-e' then avg(x * 86400) else avg(x) end as value
from h_months group by variable, experiment, member, cell_id, year"""
_ENSEMBLE = """
select variable, year, cell_id, avg(value) as value from h_annual where (experiment = 'historical' and year <= 1997) or (experiment = 'baseline' and year > 1997) group by all"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("tas", 1.0), ("tasmax", 1.5), ("tas_above_35", 2.0), ("pr", 1e-9), ("p-e", 2e-7)]
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), (F.lit(f) * F.col("value")).alias("value")) for v, f in parts])
    experiment = F.when(F.col("experiment") == "O", "baseline").otherwise("historical")
    rows = A.monthly(spark, sf_dir).select(experiment.alias("experiment"), "member", "cell_id", "year", "month", F.inline(cells))
    return rows.filter("experiment = 'historical' or year > 1997")


@query("process_monthly", f"""
select a.variable, 'baseline' as experiment, a.year, a.cell_id, {r("case when a.variable = 'p-e' then p.value - a.value else a.value end")} as value
from h_ensemble a left join (select year, cell_id, value from h_ensemble where variable = 'pr') p using (year, cell_id)""",
       h_months=_MONTHS, h_annual=_ANNUAL, h_ensemble=_ENSEMBLE)
def process_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.process_monthly(_months(spark, sf_dir), A.cells(spark, sf_dir), fit=(1998, 2001), window=(1998, 2000), last_historical=1997)
    return rounded(out.annual, "value")


@query("process_monthly_variability", f"""
with m as (select variable, member, year, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) as y
           from h_annual join a_cells using (cell_id) where experiment = 'baseline' and year between 1998 and 2001 group by all),
  d as (select variable, y - (regr_slope(y, year) over w * year + regr_intercept(y, year) over w) as e from m window w as (partition by variable, member))
select variable, {r('stddev_pop(e)')} as value from d group by variable""", h_months=_MONTHS, h_annual=_ANNUAL)
def process_monthly_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.process_monthly(_months(spark, sf_dir), A.cells(spark, sf_dir), fit=(1998, 2001), window=(1998, 2000), last_historical=1997)
    return rounded(out.natural, "value")


@query("fit_delta", f"select variable, cell_id, {r('slope', 5)} as slope from h_slopes", **H)
def fit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Inputs(spark, sf_dir).slopes(), "slope", digits=5)


@query("fit_all", f"""
select 'delta_slope' as product, variable, cast(null as varchar) as model, cast(null as int) as replicate, cast(cell_id as double) as place, {r('slope', 4)} as slope, cast(null as double) as intercept from h_slopes
union all select 'injection_slope', null, null, null, lat, {r('sum(y * driver) / sum(driver * driver)', 4)}, null from (
  select target, lat, lat * length(target) / 100 as y from (select distinct lat from a_cells), (select distinct target from h_x)) join h_x using (target) group by lat
union all select 'coef', variable, model, replicate, cell_id, {r('b', 3)}, {r('(sy - b * sx) / sw', 3)} from (
  select *, case when abs(sw * sxx - sx * sx) <= 1e-13 * sw * sxx then 0 else (sw * sxy - sx * sy) / (sw * sxx - sx * sx) end as b from (
    select variable, model, cell_id, replicate, sum(w) as sw, sum(w * x) as sx, sum(w * value) as sy, sum(w * x * x) as sxx, sum(w * x * value) as sxy
    from h_maps m join (select scenario, year, driver / 0.97e0 as x from a_global_annual) g using (scenario, year) join h_draws d using (scenario, year) where d.replicate < 10
    group by variable, model, cell_id, replicate) x) y""", **H, h_maps=_MAPS, h_draws=_DRAWS)
def fit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    path = scratch_path(spark, "fits")
    # the fits read the maps several times: they are taken from the written field, not from the daily rows again
    maps = label_maps(i.field().filter("variable in ('tas', 'pr')"))
    targets = F.explode(F.array(*[F.lit(t) for t in ("1.5", "1.0", "0.5")]))
    injections = i.cells.select("lat").distinct().withColumn("target", targets).withColumn("value", F.col("lat") * F.length("target") / 100)
    inputs = dict(injections=injections, delta_window=(1997, 2000), replicates=10)
    P.fit_all(i.annual().filter("variable = 'tas'"), maps.filter("variable = 'tas'"), i.series, i.cells, path, **inputs)
    P.fit_all(i.annual(), maps, i.series, i.cells, path, **inputs)  # adds the other variables
    none = F.lit(None)
    coef = grid.read_coefs(spark, f"{path}/coef").select(
        F.lit("coef").alias("product"), "variable", "model", "replicate", F.col("cell_id").cast("double").alias("place"), "slope", "intercept")
    slopes = grid.read_labels(spark, f"{path}/delta_slope", ["variable"]).select(
        F.lit("delta_slope").alias("product"), "variable", none.cast("string").alias("model"), none.cast("int").alias("replicate"),
        F.col("cell_id").cast("double").alias("place"), "slope", none.cast("double").alias("intercept"))
    by_lat = grid.read_grid(spark, f"{path}/injection_slope").select(
        F.lit("injection_slope").alias("product"), none.cast("string").alias("variable"), none.cast("string").alias("model"),
        none.cast("int").alias("replicate"), F.col("lat").alias("place"), "slope", none.cast("double").alias("intercept"))
    rows = rounded(coef, "slope", "intercept", digits=3).unionByName(rounded(slopes, "slope", digits=4))
    return rows.unionByName(rounded(by_lat, "slope", digits=4))


# -- input series ------------------------------------------------------------------------------

@query("global_series", f"""
with t as (select scenario, config, t as year, sum(emissions) / 1013 as v from a_scenario_series group by all),
  b as (select scenario, config, avg(v) as base from t where year between 1995 and 1997 group by all)
select scenario, year, {r('avg(v - base)')} as driver from t join b using (scenario, config) group by scenario, year""")
def global_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.scenario_series(spark, sf_dir).groupBy("scenario", "config", F.col("t").alias("year")).agg((F.sum("emissions") / 1013).alias("value"))
    layers = t.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("value", F.col("value") * (1 + F.col("layer")))
    return rounded(P.global_series(layers, (1995, 1997)), "driver")


@query("observed_series", f"""
with o as (select cast(year(o_orderdate) as int) as year, min(o_totalprice) / 1013 as v from orders group by 1)
select year, {r('v - (select avg(v) from o where year between 1995 and 1996)')} as value from o""")
def observed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg((F.min("o_totalprice") / 1013).alias("value"))
    return rounded(P.observed_series(obs, (1995, 1996)), "value")


@query("controller_injections", f"""
with m as (select o_orderpriority as p, cast(year(o_orderdate) as int) as year, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by all),
  t as (select case when p in ('1-URGENT', '2-HIGH') then '0.5' when p = '3-MEDIUM' then '1.0' else '1.5' end as target, year, avg(lo) / 1013 as lo, avg(hi) / 1013 as hi from m group by 1, 2)
select target, -30e0 as lat, {r('avg(lo)')} as value from t where year between 1996 and 1999 group by target
union all select target, 15e0, {r('avg(hi)')} from t where year between 1996 and 1999 group by target""")
def controller_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    case = F.when(p.isin("1-URGENT", "2-HIGH"), "Lower-1.0").when(p == "3-MEDIUM", "Lower-0.5").otherwise("Default")
    table = A.table(spark, sf_dir, "orders").groupBy(
        F.concat_ws("_", F.lit("Controller_start"), case, F.substring(p, 1, 1)).alias("file"), F.year("o_orderdate").alias("year")) \
        .agg((F.min("o_totalprice") / 1013).alias("s30"), (F.max("o_totalprice") / 1013).alias("n15"))
    return rounded(P.controller_injections(table, {"s30": -30, "n15": 15}, (1996, 1999)), "value")


# -- maps, gap, delta --------------------------------------------------------------------------

@query("predict_map", f"select variable, scenario, year, cell_id, {r('value', 5)} as value from h_map", **H)
def predict_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Inputs(spark, sf_dir).maps(), "value", digits=5)


@query("historical_map", f"select variable, year, cell_id, {r('value', 9)} as value from h_history", **H)
def historical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Inputs(spark, sf_dir).history(), "value", digits=9)


@query("temp_gap", f"select scenario, target_tenths, year, {r('temp_diff', 5)} as temp_diff from h_gap", **H)
def temp_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return rounded(i.gap(), "temp_diff", digits=5)


@query("regional_delta", f"select variable, scenario, target_tenths, year, cell_id, {r('value', 4)} as value from h_delta", **H)
def regional_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return rounded(i.delta(), "value", digits=4)


_STARTED = """
select g.scenario, g.target_tenths, cast(s.y as int) as start_year, g.year, case when g.temp_diff > 0 then 0 else g.temp_diff end as d, f.first
from h_gap g join range(1996, 2001) s(y) on g.year >= s.y
left join (select scenario, target_tenths, y, min(year) filter (not temp_diff > 0) as first from h_gap, range(1996, 2001) s(y) where year >= y group by all) f
  on (f.scenario, f.target_tenths, f.y) = (g.scenario, g.target_tenths, s.y)"""


@query("injection_by_latitude", f"""
select scenario, target_tenths, start_year, year, l.lat, {r('''l.lat / 100 * d * case when year - first + 1 between 1 and least(10, 2001 - first)
  then (year - first + 1) / cast(least(10, 2001 - first) as double) else 1 end''', 5)} as value
from h_started cross join (select distinct lat from a_cells) l""", **H, h_started=_STARTED)
def injection_by_latitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    slopes = i.cells.select("lat", (F.col("lat") / 100).alias("slope")).distinct()
    out = P.injection_by_latitude(slopes, settle(i.gap(), "gap"), (1996, 2000), last_year=2001)
    return rounded(out, "value", digits=5)


_MONTHLY_INJECTION = """
select band, cast((y * 12 + m) as int) as k, value / 12 as value from (
  select band, k // 6 as y, sum(value) as value from a_injection group by band, k // 6) x, range(0, 12) t(m)"""
_ANNUAL_RESPONSE = """
select a.band, cast(a.k // 12 as int) + 2035 as year, sum(h * coalesce(m.value, 0)) / 12 as driver
from h_aod a join h_aod m on m.band = a.band and m.k <= a.k join h_kernel k on k.band = a.band and k.lag = a.k - m.k + 1 group by a.band, a.k // 12"""


@query("custom_injection_delta", f"""
select v.variable, cast(year as int) as year, c.cell_id, {r('sum(v.s * (c.lat / 50 + length(r.band)) * driver)')} as value
from h_response r cross join a_cells c, (values ('tas', 1e0), ('pr', 2e0)) v(variable, s) group by v.variable, year, c.cell_id""",
       h_params=BAND_PARAMS, h_kernel=KERNEL.replace("a_injection", "h_monthly"), h_monthly=_MONTHLY_INJECTION, h_response=_ANNUAL_RESPONSE, h_aod="""
select a.band, a.k, coalesce(sum(beta * m.value * exp(-(alpha + gamma * m.value) * (a.k - m.k + 1))), 0) as value
from h_monthly a join h_params using (band) left join h_monthly m on m.band = a.band and m.k <= a.k group by a.band, a.k""")
def custom_injection_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.injection(spark, sf_dir).groupBy("band", (F.floor(F.col("k") / 6) + 2035).cast("int").alias("year")).agg(F.sum("value").alias("value"))
    params = band_params(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit("tas").alias("variable"), F.lit(1.0).alias("s")), F.struct(F.lit("pr").alias("variable"), F.lit(2.0).alias("s"))))
    climate = params.select("band", "tau", "mu", both.alias("v")).select("v.variable", "band", "tau", "mu")
    bands = params.select("band")
    patterns = blocked_product(A.cells(spark, sf_dir).select("cell_id", "lat"), bands, "cell_id").withColumn("v", both) \
        .select("v.variable", "band", "cell_id", (F.col("v.s") * (F.col("lat") / 50 + F.length("band"))).alias("slope"))
    return rounded(P.custom_injection_delta(annual, params, climate, patterns, 2035), "value")


def band_patterns(spark: SparkSession, sf_dir: str, slopes: dict[str, Column]) -> DataFrame:
    """(variable, band, cell_id, slope) for every band, from a column of lat and band per variable."""
    both = blocked_product(A.cells(spark, sf_dir).select("cell_id", "lat"), band_params(spark, sf_dir).select("band"), "cell_id")
    own = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), c.alias("slope")) for v, c in slopes.items()])).alias("x")
    return both.select("band", "cell_id", own).select("x.variable", "band", "cell_id", "x.slope")


def climate_params(spark: SparkSession, sf_dir: str, *variables: str) -> DataFrame:
    return band_params(spark, sf_dir).select(F.explode(F.array(*map(F.lit, variables))).alias("variable"), "band", "tau", "mu")


_BANDS = dict(h_params=BAND_PARAMS, h_kernel=KERNEL.replace("a_injection", "h_monthly"), h_monthly=_MONTHLY_INJECTION, h_response=_ANNUAL_RESPONSE, h_aod="""
select a.band, a.k, coalesce(sum(beta * m.value * exp(-(alpha + gamma * m.value) * (a.k - m.k + 1))), 0) as value
from h_monthly a join h_params using (band) left join h_monthly m on m.band = a.band and m.k <= a.k group by a.band, a.k""")


@query("custom_injection_p_minus_e", f"""
select v.variable, cast(year as int) as year, c.cell_id, {r("""sum(driver * case v.variable when 'pr' then c.lat / 50 + length(r.band) when 'e' then c.lat / 90 - length(r.band) / 7e0
  else c.lat / 50 + length(r.band) - (c.lat / 90 - length(r.band) / 7e0) end)""")} as value
from h_response r cross join a_cells c, (values ('pr'), ('e'), ('p-e')) v(variable) group by v.variable, year, c.cell_id""", **_BANDS)
def custom_injection_p_minus_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = A.injection(spark, sf_dir).groupBy("band", (F.floor(F.col("k") / 6) + 2035).cast("int").alias("year")).agg(F.sum("value").alias("value"))
    n = F.length("band")
    patterns = band_patterns(spark, sf_dir, {"pr": F.col("lat") / 50 + n, "e": F.col("lat") / 90 - n / F.lit(7.0)})
    return rounded(P.custom_injection_delta(annual, band_params(spark, sf_dir), climate_params(spark, sf_dir, "pr", "e"), patterns, 2035, p_minus_e=True), "value")


_COUNTRY_TOTAL = "sum(value * persons / 1000000) over (partition by variable, experiment, member, year, c.country)"


@query("country_exposure", f"""
select variable, experiment, member, year, a.cell_id, c.country, case when c.country = 0 then 0 else {r(_COUNTRY_TOTAL)} end as value
from a_annual a join h_country c on a.cell_id = c.cell_id join a_population p on p.cell_id = a.cell_id""", h_country=_COUNTRY)
def country_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, population = A.cells(spark, sf_dir), A.population(spark, sf_dir)
    out = P.country_exposure(A.annual(spark, sf_dir), population, cells, A.region_edges(spark, sf_dir), ["variable", "experiment", "member", "year"])
    return rounded(out, "value")


@query("pvalue_maps", f"""
select variable, scenario, cell_id, decade_end, {r('''case when sd = 0 then (case when m1 = m2 then 1 else 0 end) else greatest(0, 1 - sqrt(r2 / (1 + r2)) * list_sum(list_transform(range(0, 62),
  lambda k: exp(lgamma(2e0 * k + 1) - 2 * lgamma(k + 1e0) - 2e0 * k * ln(2e0) - k * ln(1 + r2))))) end''', 5)} as p_value from (
  select *, pow((m1 - m2) / (nullif(sd, 0) * sqrt(2e0 / 63)), 2) / 124 as r2 from (
    select d.variable, d.scenario, d.cell_id, d.decade_end, d.m2, b.value as m1, s.value as sd from (
      select variable, scenario, cell_id, cast(ceil((year - 1995) / 3e0) * 3 + 1995 as int) as decade_end, avg(value) as m2
      from h_rawmap where cell_id in (select cell_id from a_land) group by all) d
    join h_base b using (variable, cell_id) join h_std s on s.cell_id = d.cell_id and s.variable = case when d.variable = 'exposure_above_35' then 'tas_above_35' else d.variable end) y) x
where sd is not null""", **H, h_std="select variable, cell_id, stddev_pop(value) + 1 as value from h_field where experiment = 'F' group by variable, cell_id")
def pvalue_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    base = i.base()
    std = i.field().filter("experiment = 'F'").groupBy("variable", "cell_id").agg((F.stddev_pop("value") + 1).alias("value"))
    return rounded(P.pvalue_maps(i.maps(base), base, std, i.land, origin=1995, decades=2, width=3), "p_value", digits=5)


# -- summaries ---------------------------------------------------------------------------------

def summary(spark: SparkSession, sf_dir: str, region: bool = False) -> P.Summary:
    i = Inputs(spark, sf_dir)
    base = i.base()
    past = P.subtract_baseline(i.history().filter("year < 1996"), base)
    obs = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 101300).alias("value"))
    std = i.field().filter("experiment = 'F'").groupBy("variable", "cell_id").agg((F.stddev_pop("value") + 1).alias("value"))
    gap = settle(i.gap(base), "gap")
    pushes = i.slopes().withColumn("component", F.lit("gap"))
    v = V.vectors(i.coef(), i.series, VARIABLES, i.cells, i.land, i.population, base, pushes, V.target_gates(gap, 1997, 3, last_year=2001), first_year=1996)
    by_lat = i.cells.select("lat", (F.col("lat") / 100).alias("slope")).distinct()
    return V.pattern_summary(v, i.cells, 1997, (1998, 2000), past, i.land if region else None, obs, history_window=(1995, 1995),
                             tests=dict(baseline=base, variability=std, land=i.land, decades=dict(origin=1995, decades=2, width=3), decade_end=2001),
                             natural=i.field().groupBy("variable").agg(F.stddev_pop("value").alias("value")), population=i.population, gap=gap,
                             injection=P.injection_by_latitude(by_lat, gap, (1996, 2000), last_year=2001))


@query("summary_maps", f"""
select d.variable, d.scenario, d.target_tenths, d.cell_id, {r('m.mean', 4)} as mean, {r('d.delta_mean', 4)} as delta_mean, d.cell_id in (select cell_id from a_land) as inside
from (select variable, scenario, target_tenths, cell_id, avg(value) as delta_mean from h_delta where year between 1998 and 2000 group by all) d
join (select variable, scenario, cell_id, avg(value) as mean from h_map where year between 1998 and 2000 group by all) m using (variable, scenario, cell_id)""", **H)
def summary_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir, region=True).maps, "mean", "delta_mean", digits=4)


_AGG = "case when variable like 'exposure%' then coalesce(sum(value), 0) else sum(value * cos(radians(lat))) / sum(cos(radians(lat))) end"
_WHOLE = f"""
select concat(variable, ':', scenario) as id, variable, scenario, year, {_AGG} as value from h_map join a_cells using (cell_id) group by variable, scenario, year
union all select concat(variable, ':', scenario), variable, scenario, year, v from (
  select variable, year, {_AGG} as v from (select h.variable, h.year, h.cell_id, case when h.variable in ('tas', 'pr') then h.value - b.value else h.value end as value
    from h_history h left join h_base b using (variable, cell_id) where h.year < 1996) h join a_cells using (cell_id) group by variable, year) x
  cross join (select distinct scenario from a_global_annual)"""
_WITH = f"""
select variable, scenario, target_tenths, year, {_AGG} as value from (
  select m.variable, m.scenario, d.target_tenths, m.year, m.cell_id, case when m.variable like '%above%' then greatest(m.value + d.value, 0) else m.value + d.value end as value
  from h_map m join h_delta d using (variable, scenario, year, cell_id) where m.year >= 1997) x join a_cells using (cell_id) group by variable, scenario, target_tenths, year"""


@query("scenario_summary", f"""
with recursive {smooth_sql('h_whole', 'id', 'year', 'value')},
  l as (select distinct variable, scenario, target_tenths from h_delta)
select l.variable, l.scenario, l.target_tenths, k.kind, cast(s.t as int) as year, {r('s.value', 4)} as value
from smoothed s join l on s.id = concat(l.variable, ':', l.scenario) join (values ('historical_model'), ('no_sai')) k(kind)
  on (k.kind = 'historical_model' and s.t <= 1997) or (k.kind = 'no_sai' and s.t >= 1997)
union all select variable, scenario, target_tenths, 'with_sai', year, {r('value', 4)} from h_with
union all select l.variable, l.scenario, l.target_tenths, 'historical_obs', o.year, {r('o.v', 4)} from l, (
  select cast(year(o_orderdate) as int) as year, avg(o_totalprice) / 101300 as v from orders group by 1) o where l.variable = 'tas'""", **H, h_whole=_WHOLE, h_with=_WITH)
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir).series, "value", digits=4)


@query("summary_histograms", f"""
with l as (select distinct variable, scenario, target_tenths from h_delta),
  x as (select l.*, 'no_sai' as kind, m.value from h_map m join l using (variable, scenario) where m.year between 1998 and 2000
    union all select l.*, 'historical', case when h.variable in ('tas', 'pr') then h.value - b.value else h.value end from h_history h left join h_base b using (variable, cell_id) join l using (variable) where h.year = 1995
    union all select d.variable, d.scenario, d.target_tenths, 'with_sai', m.value + d.value from h_map m join h_delta d using (variable, scenario, year, cell_id) where d.year between 1998 and 2000),
  e as (select * from (values (0, 1e0, 5e0), (1, 5e0, 10e0), (2, 10e0, 20e0), (3, 20e0, 50e0), (4, 50e0, null)) t(bin, lo, hi)),
  g as (select distinct variable, scenario, target_tenths, kind from x where variable like '%above%' and value > 0),
  s as (select variable, scenario, target_tenths, kind, min(value) - case when min(value) = max(value) then 0.5 else 0 end as a, max(value) + case when min(value) = max(value) then 0.5 else 0 end as b
        from x where variable not like '%above%' group by variable, scenario, target_tenths, kind),
  f as (select s.*, cast(i as int) as bin from s, range(0, 150) r(i)),
  p as (select x.variable, x.scenario, x.target_tenths, x.kind, cast(least(floor((x.value - a) / (b - a) * 150), 149) as int) as bin, count(*) as n from x join s using (variable, scenario, target_tenths, kind) group by all)
select g.*, e.bin, {r('e.lo', 4)} as lo, {r('e.hi', 4)} as hi, {r('count(x.value) / nullif(sum(count(x.value)) over (partition by g.variable, g.scenario, g.target_tenths, g.kind), 0)')} as frac
from g cross join e left join x on (x.variable, x.scenario, x.target_tenths, x.kind) = (g.variable, g.scenario, g.target_tenths, g.kind) and x.value >= e.lo and (x.value < e.hi or e.hi is null)
group by g.variable, g.scenario, g.target_tenths, g.kind, e.bin, e.lo, e.hi
union all select f.variable, f.scenario, f.target_tenths, f.kind, f.bin, {r('a + f.bin * (b - a) / 150', 4)}, {r('a + (f.bin + 1) * (b - a) / 150', 4)},
  {r('coalesce(p.n, 0) / sum(p.n) over (partition by f.variable, f.scenario, f.target_tenths, f.kind)')} from f left join p using (variable, scenario, target_tenths, kind, bin)""", **H)
def summary_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(summary(spark, sf_dir).histograms, "lo", "hi", digits=4), "frac")


@query("variability_summary", f"""
select v.variable, {r('case when v.people then x.value * (select sum(persons) from a_population join a_land using (cell_id)) / 1000000 else x.value end')} as value
from (select variable, stddev_pop(value) as value from h_field group by variable) x join (values ('tas', 'tas', false), ('tas_above_35', 'tas_above_35', false), ('exposure_above_35', 'tas_above_35', true)) v(variable, source, people)
on x.variable = v.source""", **H)
def variability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    natural = i.field().groupBy("variable").agg(F.stddev_pop("value").alias("value"))
    return rounded(P.variability_summary(natural, ["tas", "tas_above_35", "exposure_above_35"], i.population, i.land), "value")


# -- summary of custom injections --------------------------------------------------------------

_CUSTOM = dict(**H, **(_BANDS | dict(
    h_monthly=_MONTHLY_INJECTION.replace("value / 12 as value", "case when y = 0 then 0 else value / 12 end as value"),
    h_response=_ANNUAL_RESPONSE.replace("2035", "1997"))), h_custom="""
select v.variable, cast(r.year as int) as year, c.cell_id, sum(v.s * (c.lat / 5000 + length(r.band) / 100e0) * driver) as value
from h_response r cross join a_cells c, (values ('tas', 1e0, false), ('pr', 2e0, true)) v(variable, s, land)
where not v.land or c.cell_id in (select cell_id from a_land) group by v.variable, r.year, c.cell_id""", h_whole=_WHOLE)


def custom_summary(spark: SparkSession, sf_dir: str) -> P.Summary:
    """Injections begin in the second year; until then the intervention is the projection without it."""
    i = Inputs(spark, sf_dir)
    base = i.base()
    past = P.subtract_baseline(i.history().filter("variable in ('tas', 'pr') and year < 1996"), base)
    amount = F.when(F.col("k") < 6, F.lit(0.0)).otherwise(F.col("value"))
    injection = A.injection(spark, sf_dir).groupBy("band", (F.floor(F.col("k") / 6) + 1997).cast("int").alias("year")).agg(F.sum(amount).alias("value"))
    shape = F.col("lat") / 5000 + F.length("band") / F.lit(100.0)
    return V.custom_summary(i.coef(), i.series, ["tas", "pr"], i.cells, i.land, base, injection, band_params(spark, sf_dir), climate_params(spark, sf_dir, "tas", "pr"),
                            band_patterns(spark, sf_dir, {"tas": shape, "pr": 2 * shape}), 1997, 1997, (1998, 2000), first_projected=1996, history=past)


@query("custom_summary_maps", f"""
select m.variable, m.scenario, m.cell_id, {r('m.mean', 4)} as mean, {r('d.delta_mean', 4)} as delta_mean, true as inside
from (select variable, scenario, cell_id, avg(value) as mean from h_map where year between 1998 and 2000 and variable in ('tas', 'pr') group by all) m
join (select variable, cell_id, avg(value) as delta_mean from h_custom where year between 1998 and 2000 group by all) d using (variable, cell_id)""", **_CUSTOM)
def custom_summary_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(custom_summary(spark, sf_dir).maps, "mean", "delta_mean", digits=4)


@query("custom_summary_series", f"""
with recursive {smooth_sql('h_whole', 'id', 'year', 'value')},
  l as (select distinct variable, scenario from h_map where variable in ('tas', 'pr')),
  s as (select l.variable, l.scenario, cast(s.t as int) as year, s.value from smoothed s join l on s.id = concat(l.variable, ':', l.scenario)),
  w as (select m.variable, m.scenario, m.year, sum((m.value + d.value) * cos(radians(lat))) / sum(cos(radians(lat))) as value
        from h_map m join h_custom d using (variable, year, cell_id) join a_cells using (cell_id) where m.year >= 1997 group by all)
select variable, scenario, 'historical_model' as kind, year, {r('value', 4)} as value from s where year <= 1997
union all select variable, scenario, 'no_sai', year, {r('value', 4)} from s where year >= 1997
union all select w.variable, w.scenario, 'with_sai', w.year, {r('case when w.year < 1998 then s.value else w.value end', 4)} from w left join s using (variable, scenario, year)""", **_CUSTOM)
def custom_summary_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(custom_summary(spark, sf_dir).series, "value", digits=4)


# -- bucketed products -------------------------------------------------------------------------

@query("write_bucketed", f"""
with s as (select v.variable, s.cell_id, case when v.people then s.slope * p.persons / 1000000 else s.slope end as push, v.land from h_slopes s
  join (values ('tas', 'tas', false, false), ('pr', 'pr', true, false), ('tas_above_35', 'tas_above_35', true, false), ('exposure_above_35', 'tas_above_35', true, true)) v(variable, source, land, people)
    on v.source = s.variable left join a_population p on p.cell_id = s.cell_id)
select s.variable, s.cell_id, {r('s.push', 4)} as push, {r("case when s.variable in ('tas', 'pr') then b.value else 0 end", 4)} as base
from s left join h_base b using (variable, cell_id) where (not s.land or s.cell_id in (select cell_id from a_land)) and s.push is not null""", **H)
def write_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    own = V.own_patterns(i.coef(), VARIABLES, i.land, i.population)
    push = V.push_patterns(i.slopes().withColumn("component", F.lit("gap")), VARIABLES, i.land, i.population)
    stored = [grid.write_bucketed(d, ["variable", "cell_id"], 8, label) for d, label in ((own, "own"), (push, "push"), (i.base(), "base"))]
    out = V.joined_patterns(*stored).select("variable", "cell_id", F.element_at("push", 1).alias("push"), "base")
    return rounded(out, "push", "base", digits=4)


# -- further parts of the summary --------------------------------------------------------------

@query("summary_gap", f"select scenario, target_tenths, year, {r('temp_diff', 5)} as temp_diff from h_gap", **H)
def summary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir).gap, "temp_diff", digits=5)


@query("summary_injection", f"""
select scenario, target_tenths, start_year, year, l.lat, {r('''l.lat / 100 * d * case when year - first + 1 between 1 and least(10, 2001 - first)
  then (year - first + 1) / cast(least(10, 2001 - first) as double) else 1 end''', 5)} as value
from h_started cross join (select distinct lat from a_cells) l""", **H, h_started=_STARTED)
def summary_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir).injection, "value", digits=5)


@query("summary_variability", f"""
select v.variable, {r('case when v.people then x.value * (select sum(persons) from a_population join a_land using (cell_id)) / 1000000 else x.value end')} as value
from (select variable, stddev_pop(value) as value from h_field group by variable) x join (values ('tas', 'tas', false), ('pr', 'pr', false),
  ('tas_above_35', 'tas_above_35', false), ('exposure_above_35', 'tas_above_35', true)) v(variable, source, people) on x.variable = v.source""", **H)
def summary_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir, region=True).variability, "value")


# -- sweep -------------------------------------------------------------------------------------

_UNRAMPED = "(select scenario, target_tenths, year, case when temp_diff > 0 then 0 else temp_diff end as driver from h_gap where year >= 1997) d"
_P_OF = """case when sd = 0 then (case when m1 = m2 then 1 else 0 end) else greatest(0, 1 - sqrt(r2 / (1 + r2)) * list_sum(list_transform(range(0, 62),
  lambda k: exp(lgamma(2e0 * k + 1) - 2 * lgamma(k + 1e0) - 2e0 * k * ln(2e0) - k * ln(1 + r2))))) end"""
_P_SWEPT = """
select *, {p} as p from (select *, pow((m1 - m2) / (nullif(sd, 0) * sqrt(2e0 / 63)), 2) / 124 as r2 from (
  select d.*, b.value as m1, s.value as sd from ({means}) d join h_base b using (variable, cell_id)
  join h_std s on s.cell_id = d.cell_id and s.variable = case when d.variable = 'exposure_above_35' then 'tas_above_35' else d.variable end) y) x where sd is not null"""
_DECADE = "cast(ceil((year - 1995) / 3e0) * 3 + 1995 as int)"
_STD = "select variable, cell_id, stddev_pop(value) + 1 as value from h_field where experiment = 'F' group by variable, cell_id"
_MAP_MEANS = f"""
  select variable, scenario, cell_id, {_DECADE} as decade_end, avg(value) as m2 from h_rawmap where year between 1996 and 2001 and cell_id in (select cell_id from a_land) group by all"""
# the means of map and delta are formed each for itself, then added: both have the same years
_DELTA_MEANS = f"""
  select m.variable, m.scenario, d.target_tenths, m.cell_id, m.decade_end, m.value + d.value as m2 from (
    select variable, scenario, cell_id, {_DECADE} as decade_end, avg(value) as value from h_rawmap where year between 1997 and 2001 and cell_id in (select cell_id from a_land) group by all) m
  join (select variable, scenario, target_tenths, cell_id, {_DECADE} as decade_end, avg(value) as value from h_swept where year between 1997 and 2001 group by all) d
    on (d.variable, d.scenario, d.cell_id, d.decade_end) = (m.variable, m.scenario, m.cell_id, m.decade_end)"""
_SWEEP = dict(**H, h_std=_STD, h_swept=_DELTA.replace("h_ramped d", _UNRAMPED))


def swept(spark: SparkSession, sf_dir: str, *products: str, batch_rows: int = 20_000) -> tuple[str, list[dict[str, bool]]]:
    """(folder, what each of three runs wrote) of a sweep that starts with some scenarios, goes on with all, and has nothing left."""
    i = Inputs(spark, sf_dir)
    path = scratch_path(spark, "sweep")
    std = i.field().filter("experiment = 'F'").groupBy("variable", "cell_id").agg((F.stddev_pop("value") + 1).alias("value"))
    scenarios = i.series.select("scenario").distinct()
    targets = F.explode(F.array(*[F.lit(t) for t in (-20, 0, 25)]))
    work = settle(scenarios.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in VARIABLES]))).withColumn("target_tenths", targets), "work")
    by_lat = i.cells.select("lat", (F.col("lat") / 100).alias("slope")).distinct()
    inputs = dict(coef=i.coef(), series=i.series, slopes=settle(i.slopes(), "slopes"), injection_slopes=by_lat, annual=i.annual(),
                  variability=settle(std, "std"), cells=i.cells, land=i.land, population=i.population, variables=VARIABLES,
                  target_tenths=[-20, 0, 25], start_years=(1996, 2000), canvas_start=1997, first_year=1996, last_historical=1998,
                  base_window=(1995, 1996), decades=dict(origin=1995, decades=2, width=3), last_year=2001, products=products, batch_rows=batch_rows)
    return path, [P.sweep_all(spark, path, some, **inputs) for some in (work.filter("scenario < '3'"), work)]


def swept_product(spark: SparkSession, sf_dir: str, product: str) -> DataFrame:
    path, _ = swept(spark, sf_dir, product)
    return grid.read_labels(spark, f"{path}/{product}", ["variable", "scenario"])


@query("sweep_maps", f"select variable, scenario, year, cell_id, {r('value', 4)} as value from h_map", **H)
def sweep_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swept_product(spark, sf_dir, "maps"), "value", digits=4).select("variable", "scenario", "year", "cell_id", "value")


@query("sweep_pvalues", f"""
select variable, scenario, cell_id, decade_end, {r('p', 4)} as p_value from ({_P_SWEPT.format(p=_P_OF, means=_MAP_MEANS)}) q""", **_SWEEP)
def sweep_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swept_product(spark, sf_dir, "pvalues"), "p_value", digits=4).select("variable", "scenario", "cell_id", "decade_end", "p_value")


@query("sweep_delta", f"select variable, scenario, target_tenths, year, cell_id, {r('value', 4)} as value from h_swept", **_SWEEP)
def sweep_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swept_product(spark, sf_dir, "delta"), "value", digits=4).select("variable", "scenario", "target_tenths", "year", "cell_id", "value")


@query("sweep_delta_pvalues", f"""
select variable, scenario, target_tenths, cell_id, decade_end, {r('p', 4)} as p_value from ({_P_SWEPT.format(p=_P_OF, means=_DELTA_MEANS)}) q""", **_SWEEP)
def sweep_delta_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(swept_product(spark, sf_dir, "delta_pvalues"), "p_value", digits=4)
    return out.select("variable", "scenario", "target_tenths", "cell_id", "decade_end", "p_value")


@query("sweep_injection", f"""
select scenario, target_tenths, start_year, year, l.lat, {r('''l.lat / 100 * d * case when year - first + 1 between 1 and least(10, 2001 - first)
  then (year - first + 1) / cast(least(10, 2001 - first) as double) else 1 end''', 4)} as value from h_started cross join (select distinct lat from a_cells) l""", **H, h_started=_STARTED)
def sweep_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(swept_product(spark, sf_dir, "injection"), "value", digits=4)
    return out.select("scenario", "target_tenths", "start_year", "year", "lat", "value")


# every row of the five products, with the run of the sweep that wrote it
_SWEPT = f"""
select 'maps' as product, variable, scenario, cast(null as int) as target_tenths, cast(cell_id as double) as place, year, {r('value', 3)} as value, scenario < '3' as first_run from h_map
union all select 'pvalues', variable, scenario, null, cell_id, decade_end, {r('p', 3)}, scenario < '3' from ({_P_SWEPT.format(p=_P_OF, means=_MAP_MEANS)}) q
union all select 'delta', variable, scenario, target_tenths, cell_id, year, {r('value', 3)}, scenario < '3' from h_swept
union all select 'delta_pvalues', variable, scenario, target_tenths, cell_id, decade_end, {r('p', 3)}, scenario < '3' from ({_P_SWEPT.format(p=_P_OF, means=_DELTA_MEANS)}) q
union all select 'injection', concat('from ', start_year), scenario, target_tenths, l.lat, year, {r('''l.lat / 100 * d * case when year - first + 1 between 1 and least(10, 2001 - first)
  then (year - first + 1) / cast(least(10, 2001 - first) as double) else 1 end''', 3)}, scenario < '3' from h_started cross join (select distinct lat from a_cells) l"""


@query("sweep_all", _SWEPT, **_SWEEP, h_started=_STARTED)
def sweep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, runs = swept(spark, sf_dir, *P.SWEPT)
    single, pair, target = ["variable", "scenario"], ["scenario", "target_tenths"], ["variable", "scenario", "target_tenths"]
    out = []
    for product, keys, place, at, value in (("maps", single, "cell_id", "year", "value"), ("pvalues", single, "cell_id", "decade_end", "p_value"),
                                            ("delta", target, "cell_id", "year", "value"), ("delta_pvalues", target, "cell_id", "decade_end", "p_value"),
                                            ("injection", pair, "lat", "year", "value")):
        rows = grid.read_labels(spark, f"{path}/{product}", ["variable", "scenario"])
        done = grid.finished_keys(spark, f"{path}/{product}", rows, keys)
        # commits are named in the order of their time
        first = done.filter("scenario < '3'").agg(F.max("commit").alias("_until"))
        named = blocked_product(done, first, keys[0]).select(*keys, (F.col("commit") <= F.col("_until")).alias("first_run"))
        label = F.col("variable") if "variable" in keys else F.concat(F.lit("from "), F.col("start_year"))
        tenths = F.col("target_tenths") if "target_tenths" in keys else F.lit(None).cast("int")
        out.append(rows.join(named, keys).select(F.lit(product).alias("product"), label.alias("variable"), "scenario", tenths.alias("target_tenths"),
                                                 F.col(place).cast("double").alias("place"), F.col(at).alias("year"), F.col(value).alias("value"), "first_run"))
    return rounded(reduce(DataFrame.unionByName, out).filter(F.lit(all(runs[0].values()))), "value", digits=3)


@query("summary_pvalues", f"""
with l as (select distinct variable, scenario, target_tenths from h_delta)
select l.variable, l.scenario, l.target_tenths, 'no_sai' as kind, q.cell_id, {r('q.p', 3)} as p_value from l join ({_P_SWEPT.format(p=_P_OF, means="""
  select variable, scenario, cell_id, avg(value) as m2 from h_rawmap where year between 1999 and 2001 and cell_id in (select cell_id from a_land) group by all""")}) q using (variable, scenario)
union all select variable, scenario, target_tenths, 'with_sai', cell_id, {r('p', 3)} from ({_P_SWEPT.format(p=_P_OF, means="""
  select m.variable, m.scenario, d.target_tenths, m.cell_id, avg(m.value + d.value) as m2 from h_rawmap m join h_delta d using (variable, scenario, year, cell_id)
  where m.year between 1999 and 2001 and m.cell_id in (select cell_id from a_land) group by all""")}) q""", **H,
       h_std="select variable, cell_id, stddev_pop(value) + 1 as value from h_field where experiment = 'F' group by variable, cell_id")
def summary_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir).pvalues, "p_value", digits=3)
