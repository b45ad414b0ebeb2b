"""Registered queries: scenario tables, parameter ensembles, units and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import columns as C
from gridspark.operators import scenario as S
from gridspark.plans import adapters as A
from gridspark.plans.registry import query, r, rounded
from gridspark.schema import SCENARIO_TITLES, literal_table


@query("filter_scenario_rows", "select scenario, region, variable, unit, y1995, y1996 from a_scenario_wide where ends_with(variable, '|O') and scenario in ('1-URGENT') union all select scenario, region, variable, unit, y1995, y1996 from a_scenario_wide where variable in ('Emissions|P', 'Emissions|F') and region = 'World'")
def filter_scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.scenario_wide(spark, sf_dir).select("scenario", "region", "variable", "unit", "y1995", "y1996")
    one = S.filter_scenario_rows(wide, scenario="1-URGENT", suffix="O")
    return one.unionByName(S.filter_scenario_rows(wide, variables=["Emissions|P", "Emissions|F"]))


@query("calibrate_configs", "select config, 4.830712e0 as clim_c1, 0.649448e0 as clim_kappa1, fscale_volcanic from a_configs")
def calibrate_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    constants = {k: S.CALIBRATION[k] for k in ("clim_c1", "clim_kappa1")}
    return S.calibrate_configs(A.configs(spark, sf_dir), constants).select("config", "clim_c1", "clim_kappa1", "fscale_volcanic")


@query("sample_configs", "select config, clim_c1 from a_configs order by md5('42-' || config), config limit 10")
def sample_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_configs(A.configs(spark, sf_dir), 10).select("config", "clim_c1")


@query("config_median", f"""
select 'price' as param, {r('median(o_totalprice)', 3)} as value from orders union all select 'day', median(dayofyear(o_orderdate)) from orders""")
def config_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensemble = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("config"), F.col("o_totalprice").alias("price"), F.dayofyear("o_orderdate").cast("double").alias("day"))
    return rounded(S.config_median(ensemble, ["price", "day"]), "value", digits=3)


@query("attach_species_params", f"""
select s.scenario, s.config, s.specie, s.t, case when s.specie = 'Brand#3' then c.clim_c1 else p.efficiency end as efficiency,
  coalesce(c.fscale_volcanic, p.baseline_concentration) as baseline_concentration
from a_scenario_series s join a_species p using (specie)
left join (select chr(cast(65 + cast(config as int) as int)) as config, fscale_volcanic, clim_c1 from a_configs) c on c.config = s.config""")
def attach_species_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.char(F.lit(65) + F.col("config").cast("int"))
    configs = A.configs(spark, sf_dir).select(letters.alias("config"), F.col("clim_c1").alias("eff_3"), F.col("fscale_volcanic").alias("base_all"))
    rules = {"eff_3": [("efficiency", "Brand#3")], "base_all": [("baseline_concentration", None)]}
    overrides = S.parameter_overrides(configs, rules)
    series = A.scenario_series(spark, sf_dir).select("scenario", "config", "specie", "t")
    return S.attach_species_params(series, A.species(spark, sf_dir), overrides, ["efficiency", "baseline_concentration"]) \
        .select("scenario", "config", "specie", "t", "efficiency", "baseline_concentration")


@query("scale_forcing_by_config", f"""
select c.config, g.scenario, g.t, {r('-g.co2 / 1000 * fscale_volcanic')} as volcanic,
  {r('g.n2o / 100 * fscale_solar_amplitude + least((g.t - 1995) / 4e0, 1) * fscale_solar_trend')} as solar
from a_three_gas g cross join a_configs c""")
def scale_forcing_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    natural = A.three_gas(spark, sf_dir) \
        .select("scenario", "t", (-F.col("co2") / 1000).alias("volcanic"), (F.col("n2o") / 100).alias("solar"))
    out = S.scale_forcing_by_config(natural, A.configs(spark, sf_dir), trend_start=1995, trend_years=4)
    return rounded(out, "volcanic", "solar")


@query("sector_sum", f"""
select scenario, t, case when count(*) = count(value) then {r("sum(case when variable in ('Emissions|F', 'Emissions|O') then value * 46.006e0 / 30.006e0 else value end)")} end as value
from a_scenario_long group by scenario, t""")
def sector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = S.unpivot_years(A.scenario_wide(spark, sf_dir), ["scenario", "region", "variable", "unit"], "y")
    return rounded(S.sector_sum(long, ["Emissions|F", "Emissions|O"], ["Emissions|P"]), "value")


_UNITS = """
select o_orderkey, o_totalprice as value, case o_orderkey % 6 when 0 then 'Gt C/yr' when 1 then 'Mt CH4/day' when 2 then 'kt N2O/s' when 3 then 'ppm' when 4 then 'Mt XX/yr' else 'Tg NO/yr' end as unit,
  case o_orderkey % 6 when 0 then 'Mt CO2/yr' when 1 then 'Mt CH4/yr' when 2 then 'Mt N2O/yr' when 3 then 'ppt' when 4 then 'Mt CO2/yr' else 'Mt NO2/yr' end as target_unit
from orders"""


@query("convert_units", f"""
select o_orderkey, unit, target_unit, {r('''case o_orderkey % 6 when 0 then value * 1000 * 44.009e0 / 12.011e0 when 1 then value * 365.24219e0
  when 2 then value / 1000 * 365.24219e0 * 86400 when 3 then value * 1000000 when 4 then null else value * 46.006e0 / 30.006e0 end / 1013e0''', 2)} as value, o_orderkey % 6 = 4 as unit_error
from h_units""", h_units=_UNITS)
def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = [("Gt C/yr", "Mt CO2/yr"), ("Mt CH4/day", "Mt CH4/yr"), ("kt N2O/s", "Mt N2O/yr"), ("ppm", "ppt"), ("Mt XX/yr", "Mt CO2/yr"), ("Tg NO/yr", "Mt NO2/yr")]
    pair = F.element_at(F.array(*[F.struct(F.lit(a).alias("u"), F.lit(b).alias("t")) for a, b in units]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), pair.alias("p")) \
        .select("o_orderkey", "value", F.col("p.u").alias("unit"), F.col("p.t").alias("target_unit"))
    weights = literal_table(spark, [("CO2", 44.009), ("CH4", 16.043), ("N2O", 44.013), *S.EXTRA_WEIGHTS.items()], ["compound", "weight"])
    out = S.convert_units(rows, weights).withColumn("value", F.col("value") / 1013.0)
    return rounded(out, "value", digits=2).select("o_orderkey", "unit", "target_unit", "value", "unit_error")


@query("tidy_scenarios", f"""
with f as (select scenario, variable, t + 0.5 as t, case when value is not null then value when t1 is null then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end as value from h_known),
  p as (select * from f where value is not null),
  s as (select scenario, variable, t as ta, value as va, lead(t) over w as tb, lead(value) over w as vb,
          row_number() over w as i, count(*) over (partition by scenario, variable) as n from p window w as (partition by scenario, variable order by t))
select scenario, 'gas ' || right(variable, 1) as specie, cast(x as double) as t, {r('(va + (vb - va) * (x - ta) / (tb - ta)) * 44.009e0 / 12.011e0')} as value, false as unit_error
from s join range(1994, 2003) a(x) on tb is not null and (x >= ta or i = 1) and (x < tb or i = n - 1) where right(variable, 1) in ('F', 'O')""",
       h_known="""
select x.*, (select max_by(y.value, y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t <= x.t and y.value is not null) as v0,
  (select max(y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t <= x.t and y.value is not null) as t0,
  (select min_by(y.value, y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t >= x.t and y.value is not null) as v1,
  (select min(y.t) from a_scenario_long y where y.scenario = x.scenario and y.variable = x.variable and y.t >= x.t and y.value is not null) as t1
from a_scenario_long x""")
def tidy_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = literal_table(spark, [("gas F",), ("gas O",)], ["specie"])
    weights = literal_table(spark, [("CO2", 44.009), *S.EXTRA_WEIGHTS.items()], ["compound", "weight"])
    out = S.tidy_scenarios(A.scenario_wide(spark, sf_dir), species, "emissions", 1994.0, 2002.0, prefix="y", renamed={"gas F": "F", "gas O": "O"},
                           targets=F.lit("Gt CO2/yr"), weights=weights)
    wanted = out.select("scenario").distinct().withColumn("specie", F.explode(F.array(F.lit("gas F"), F.lit("gas O"))))
    S.require(S.missing_species(out, wanted), "scenario files lack")
    return rounded(out, "value")


_TITLES = ", ".join(f"('{k}', '{v}')" for k, v in SCENARIO_TITLES.items())


@query("scenario_titles", f"""
select o_orderkey, t.id as scenario, t.title, t.id as back from orders
join (select row_number() over () - 1 as i, id, title from (values {_TITLES}) v(id, title)) t on t.i = o_orderkey % 8""")
def scenario_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*[F.lit(s) for s in SCENARIO_TITLES])
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(ids, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("scenario"))
    return rows.withColumn("title", C.scenario_title("scenario")).withColumn("back", C.scenario_id("title"))


# -- checks ------------------------------------------------------------------------------------

_TYPES = ["co2", "ch4", "n2o", "cfc-11", "other halogen", "f-gas", "sulfur", "eesc", "land use", "no such type"]
_MODES = ["emissions", "calculated", "concentration", "forcing"]
_TYPED = f"""
select p_partkey as specie, list_extract({_TYPES}, cast(p_size % 10 + 1 as int)) as type, list_extract({_MODES}, cast(p_partkey % 4 + 1 as int)) as input_mode, p_brand as run from part"""


def typed_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("specie"), pick(_TYPES, F.col("p_size") % 10).alias("type"),
        pick(_MODES, F.col("p_partkey") % 4).alias("input_mode"), F.col("p_brand").alias("run"))


@query("check_species", """
select 'type' as rule, cast(specie as varchar) as subject, type as detail from h_typed where type = 'no such type'
union all select 'input_mode', cast(specie as varchar), input_mode from h_typed where type <> 'no such type' and not case type
  when 'co2' then true when 'sulfur' then input_mode = 'emissions' when 'eesc' then input_mode in ('concentration', 'calculated')
  when 'land use' then input_mode in ('calculated', 'forcing') else input_mode <> 'calculated' end
union all select 'repeated', type, cast(count(*) as varchar) from h_typed where type not in ('other halogen', 'f-gas') group by type having count(*) > 1
union all select distinct 'properties', cast(l_partkey * 7 as varchar), 'missing' from lineitem where l_partkey * 7 not in (select p_partkey from part)""", h_typed=_TYPED)
def check_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 7).cast("string").alias("specie")).distinct()
    return S.check_species(typed_species(spark, sf_dir), wanted)


@query("check_no_missing", """
select specie, mode, count(*) as n_missing from (
  select specie, 'emissions' as mode, case when emissions % 10 <> 0 then emissions end as v from a_scenario_series
  union all select specie, 'concentration', case when t <> 1999 then concentration end from a_scenario_series) x
where v is null group by specie, mode""")
def check_no_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.scenario_series(spark, sf_dir)
    known = s.select("specie", F.when(F.col("emissions") % 10 != 0, F.col("emissions")).alias("emissions"),
                     F.when(F.col("t") != 1999, F.col("concentration")).alias("concentration"))
    return S.check_no_missing(known.unpivot(["specie"], ["emissions", "concentration"], "mode", "value"))


@query("check_dependencies", """
with f as (select run, bool_or(type = 'co2' and input_mode = 'calculated') as co2_calc, bool_or(type = 'land use' and input_mode = 'calculated') as land,
    bool_or(type = 'eesc' and input_mode = 'concentration') as ec, bool_or(type = 'eesc' and input_mode = 'calculated') as ek,
    bool_or(type = 'cfc-11' and input_mode in ('emissions', 'concentration')) as cfc,
    cast(bool_or(type = 'co2' and input_mode <> 'forcing') as int) as c, cast(bool_or(type = 'ch4' and input_mode in ('emissions', 'concentration')) as int) as m,
    cast(bool_or(type = 'n2o' and input_mode in ('emissions', 'concentration')) as int) as n from h_typed group by run)
select run, 'co2_sources' as rule from f where co2_calc union all select run, 'land_use_source' from f where land
union all select run, 'eesc_source' from f where not ec and ek and not cfc union all select run, 'main_gases' from f where c + m + n in (1, 2)""", h_typed=_TYPED)
def check_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.check_dependencies(typed_species(spark, sf_dir), groups=["run"])


@query("check_inputs", """
select distinct l_returnflag as member, cast(year(l_shipdate) as int) as year from lineitem where l_returnflag = 'N'
except select 'N', cast(year(o_orderdate) as int) from orders where o_totalprice > 499500 and o_orderstatus = 'P'""")
def check_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_returnflag").alias("member"), F.year("l_shipdate").alias("year"))
    have = A.table(spark, sf_dir, "orders").filter("o_totalprice > 499500 and o_orderstatus = 'P'").select(F.lit("N").alias("member"), F.year("o_orderdate").alias("year"))
    return S.check_inputs(have, need, ["member", "year"])


@query("check_inputs_by_member", """
select distinct l_returnflag as member, cast(l_shipdate as date) as date from lineitem
except select case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end, cast(o_orderdate as date) from orders""")
def check_inputs_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("member"), F.to_date("l_shipdate").alias("date"))
    member = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    have = A.table(spark, sf_dir, "orders").select(member.alias("member"), F.to_date("o_orderdate").alias("date"))
    return S.check_inputs(have, need, ["member", "date"])
