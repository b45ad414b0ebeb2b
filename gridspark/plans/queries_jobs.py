"""Registered queries of whole jobs: files are written as a model writes them, and everything is made from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans import adapters as A
from gridspark.plans import jobs
from gridspark.plans.registry import query, r, rounded
from gridspark.scratch import scratch_path
from gridspark.sources import grid

_BASE = "b.e21.BWSSP245.f09_g17.release-cesm2.1.3.WACCM-MA-1deg"
_HISTORY = "b.e21.BWHIST.f09_g17.release-cesm2.1.3.WACCM-MA-1deg"
_CMIP = "b.e21.BWHIST.f09_g17.CMIP6-historical-WACCM"
_LOWER = f"{_BASE}.SSP245-MA-GAUSS-LOWER-0.5"


def model_files(spark: SparkSession, sf_dir: str) -> str:
    """Daily and monthly files with pieces, components, padded days, members without dates and an incomplete file.

    O runs are 20 years later as a baseline, F runs its history.  Daily files hold one member of the baseline, one of a
    target whose days are only numbered, and one historical run that goes past its last year.
    """
    obs = A.obs_daily(spark, sf_dir)
    number = F.when(F.col("member") == "A", "001").when(F.col("member") == "N", "002").otherwise("003")
    name = lambda case, member, stream, field, span: F.concat_ws(".", case, member, F.lit("cam"), F.lit(stream), field, span)
    later = lambda d, years: F.add_months(d, 12 * years)

    months = obs.groupBy("experiment", number.alias("member"), F.trunc("date", "month").alias("date"), "cell_id") \
        .agg((F.avg("tas") / F.lit(0.97)).alias("tas"), (F.avg("pr") / 1013).alias("pr"))
    new = F.col("experiment") == "O"
    stored_total = new & (F.col("member") == "001")
    cell = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    rain = F.col("pr") * F.lit(1e-9)
    fields = F.array_compact(F.array(
        cell("TREFHT", F.col("tas")), cell("QFLX", F.col("pr") * F.lit(2e-7)), F.when(stored_total, cell("PRECT", rain)),
        F.when(~stored_total, cell("PRECC", rain * F.lit(0.25))), F.when(~stored_total, cell("PRECL", rain * F.lit(0.75)))))
    rows = months.select("experiment", "member", F.when(new, later("date", 20)).otherwise(F.col("date")).alias("date"), "cell_id", F.inline(fields))
    span = F.when(F.year("date") < 2018, "201501-201712").otherwise("201801-209912")
    monthly = rows.select(name(F.when(new, _BASE).otherwise(_HISTORY), F.col("member"), "h0", F.col("field"), F.when(new, span).otherwise("185001-201412")).alias("file"),
                          "date", F.lit(None).cast("int").alias("step"), "cell_id", "value")

    warm = F.col("tas") + 265
    wet = F.col("pr") / 4013 / 86400 / 1000
    both = lambda t: F.array(cell("TREFHT", t), cell("PRECT", wet))
    first = obs.filter("experiment = 'O' and member = 'A'")
    padded = first.select("date", "cell_id", F.inline(both(F.when(F.day("date") == 31, F.lit(0.0)).otherwise(warm))))
    none = F.lit(None)
    base = padded.select(name(F.lit(_BASE), F.lit("001"), "h1", F.col("field"), F.lit("20150101-20241231")).alias("file"), later("date", 20).alias("date"),
                         none.cast("int").alias("step"), "cell_id", "value")
    incomplete = padded.select(name(F.lit(_BASE), F.lit("001"), "h1", F.col("field"), F.lit("20250102-20341231")).alias("file"), later("date", 20).alias("date"),
                               none.cast("int").alias("step"), "cell_id", (F.col("value") + 999).alias("value"))
    numbered = obs.filter("experiment = 'O' and member = 'N'").select("date", "cell_id", F.inline(both(warm)))
    numbered = numbered.select(name(F.lit(_LOWER), F.lit("002"), "h1", F.col("field"), F.lit("20150101-20170228")).alias("file"), none.cast("date").alias("date"),
                               F.datediff("date", F.lit("1990-01-01")).alias("step"), "cell_id", "value")
    past = obs.filter("experiment = 'F' and member = 'R'").select("date", "cell_id", F.inline(both(warm)))
    past = past.select(name(F.lit(_CMIP), F.lit("003"), "h1", F.col("field"), F.lit("20090101-20151231")).alias("file"), later("date", 14).alias("date"),
                       none.cast("int").alias("step"), "cell_id", "value")
    path = scratch_path(spark, "model-files")
    out = monthly
    for more in (base, incomplete, numbered, past):
        out = out.unionByName(more)
    grid.write_grid(out, path, ["file"])
    return path


_STORED_MONTHS = """
select v.variable, m.member, m.cell_id, m.year, v.f * (case when v.variable = 'tas' then m.tas else m.pr end) as value from (
  select experiment, member, cell_id, cast(year(date) + case experiment when 'O' then 20 else 0 end as int) as year, month(date) as month, avg(tas) / 0.97e0 as tas, avg(pr) / 1013 as pr
  from a_obs_daily group by all) m, (values ('tas', 1e0), ('pr', 0.0864e0), ('p-e', 0.01728e0)) v(variable, f)"""
_DAYS = """
select 'baseline' as experiment, date + interval 20 year as date, cell_id, case when day(date) = 31 then 0 else tas + 265 end as tas, pr / 4013 as wet from a_obs_daily where experiment = 'O' and member = 'A'
union all select '1.0', make_date(2015 + i // 365, cast(month(date '2001-01-01' + cast(i % 365 as int)) as bigint), cast(day(date '2001-01-01' + cast(i % 365 as int)) as bigint)), cell_id, tas + 265, pr / 4013 from (
  select *, cast(dense_rank() over (order by date) - 1 as bigint) as i from a_obs_daily where experiment = 'O' and member = 'N') x where i < 789
union all select 'cmip_historical', date + interval 14 year, cell_id, tas + 265, pr / 4013 from a_obs_daily where experiment = 'F' and member = 'R' and year(date) <= 2000"""
_MEMBERS = """
select variable, 'baseline' as experiment, member, cell_id, year, avg(value) as value from h_stored group by all
union all select v.variable, experiment, 'x', cell_id, year, case v.variable when 'tasmax' then warmest when 'tasmin' then coldest when 'tas_above_40' then above_40 when 'tas_above_35' then above_35 else below_0 end
from (select experiment, cell_id, cast(year(date) as int) as year, max(tas) as warmest, min(tas) as coldest, cast(count(*) filter (tas > 313.15e0) as double) as above_40,
        cast(count(*) filter (tas > 308.15e0) as double) as above_35, cast(count(*) filter (tas < 273.15e0) as double) as below_0
      from h_days where (experiment, date) in (select experiment, date from h_days group by experiment, date having avg(tas) <> 0) group by experiment, cell_id, year(date)) d,
  (values ('tasmax'), ('tasmin'), ('tas_above_40'), ('tas_above_35'), ('tas_below_0')) v(variable)
union all select 'pr_above_10', experiment, 'x', cell_id, cast(year(date) as int), cast(count(*) filter (wet > 10) as double) from h_days group by experiment, cell_id, year(date)
union all select 'pr_above_20', experiment, 'x', cell_id, cast(year(date) as int), cast(count(*) filter (wet > 20) as double) from h_days group by experiment, cell_id, year(date)"""
_VIEWS = dict(h_stored=_STORED_MONTHS, h_days=_DAYS, h_members=_MEMBERS)


def _products(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return jobs.process_files(spark, model_files(spark, sf_dir), scratch_path(spark, "climate"), A.cells(spark, sf_dir), fit=(2016, 2020), window=(2010, 2019))[0]


@query("process_files", f"""
with e as (select variable, experiment, year, cell_id, avg(value) as value from h_members group by all)
select e.variable, e.experiment, e.year, e.cell_id, {r("case when e.variable = 'p-e' then p.value - e.value else e.value end")} as value
from e left join (select experiment, year, cell_id, value from e where variable = 'pr') p using (experiment, year, cell_id)""", **_VIEWS)
def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _products(spark, sf_dir)["annual"]
    return rounded(out.select("variable", "experiment", "year", "cell_id", "value"), "value")


@query("process_files_variability", f"""
with b as (select * from h_members where experiment = 'baseline' and year between 2016 and 2020),
  g as (select variable, member, year, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) as y from b join a_cells using (cell_id) group by variable, member, year),
  d as (select variable, y - (coalesce(regr_slope(y, year) over w, 0) * year + coalesce(regr_intercept(y, year) over w, y)) as e from g window w as (partition by variable, member)),
  c as (select variable, cell_id, year, value - case when count(*) over w = 1 then value else regr_slope(value, year - 2016) over w * (year - 2016) + regr_intercept(value, year - 2016) over w end as e
        from b window w as (partition by variable, member, cell_id))
select 'natural' as product, variable, cast(null as int) as cell_id, {r('sqrt(avg(e * e))')} as value from d group by variable
union all select 'regional', variable, cell_id, {r('sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0))')} from c where year <= 2019 group by variable, cell_id""", **_VIEWS)
def process_files_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _products(spark, sf_dir)
    natural = out["natural"].select(F.lit("natural").alias("product"), "variable", F.lit(None).cast("int").alias("cell_id"), "value")
    regional = out["regional"].filter("value is not null").select(F.lit("regional").alias("product"), "variable", "cell_id", "value")
    return rounded(natural.unionByName(regional), "value")
