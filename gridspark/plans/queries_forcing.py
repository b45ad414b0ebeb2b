"""Registered queries: closed-form forcing diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import forcing as X
from gridspark.operators import timeops
from gridspark.plans import adapters as A
from gridspark.plans.registry import query, r, rounded

_KEYS = ["scenario", "config", "t"]


# -- greenhouse gases --------------------------------------------------------------------------

def gas_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three main gases and one minor gas per scenario and year, in long form."""
    gas = lambda name, c, ref, base, scale: F.struct(
        F.lit(name).alias("specie"), c.alias("concentration"), F.lit(ref).alias("reference_concentration"),
        F.lit(base).alias("baseline_concentration"), F.lit(scale).alias("scale"), F.lit(0.25).alias("efficiency"))
    g = A.three_gas(spark, sf_dir)
    rows = F.array(gas("CO2", F.col("co2"), 277.15, 278.3, 1.05), gas("CH4", F.col("ch4"), 731.41, 729.2, 0.86),
                   gas("N2O", F.col("n2o"), 273.87, 270.1, 1.07), gas("CFC-12", F.col("co2") - 200, 3.0, 1.0, 1.12))
    return g.select("scenario", F.lit("c").alias("config"), "t", F.inline(rows))


_WIDE = """
select *, 277.15e0 as c0, 731.41e0 as m0, 273.87e0 as n0 from (
  select scenario, t, co2 as c, ch4 as m, n2o as n, 0 as base from a_three_gas union all select distinct '', 0, 278.3e0, 729.2e0, 270.1e0, 1 from a_three_gas) x"""


def _gas_sql(co2: str, ch4: str, n2o: str, offset: bool) -> str:
    base = 1.0 if offset else 3.0
    f = f"select scenario, t, base, {co2} as fc, {ch4} as fm, {n2o} as fn, c from h_wide"
    off = (lambda x: f"{x} - (select {x} from f where base = 1)") if offset else (lambda x: x)
    rows = [("CO2", f"({off('fc')}) * 1.05e0"), ("CH4", f"({off('fm')}) * 0.86e0"), ("N2O", f"({off('fn')}) * 1.07e0"),
            ("CFC-12", f"(c - 200 - {base}) * 0.25e0 * 0.001e0 * 1.12e0")]
    return f"with f as ({f}) " + " union all ".join(
        f"select scenario, 'c' as config, cast(t as int) as t, '{g}' as specie, {r(x)} as forcing from f where base = 0" for g, x in rows)


def _ghg(name: str, method: str, co2: str, ch4: str, n2o: str, offset: bool = False) -> None:
    @query(name, _gas_sql(co2, ch4, n2o, offset), h_wide=_WIDE)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(X.ghg_forcing(gas_rows(spark, sf_dir), method), "forcing")


_ghg("ghg_forcing_meinshausen2020", "meinshausen2020",
     """((case when c <= c0 then 5.2488e0 when c > c0 + 0.00075906e0 / (2 * 2.4785e-7) then 5.2488e0 + pow(0.00075906e0, 2) / (4 * 2.4785e-7)
       else 5.2488e0 - 2.4785e-7 * pow(c - c0, 2) + 0.00075906e0 * (c - c0) end) - 0.0021492e0 * sqrt(n)) * ln(c / c0)""",
     "(-8.9603e-05 * sqrt(m) - 0.00012462e0 * sqrt(n) + 0.045194e0) * (sqrt(m) - sqrt(m0))",
     "(-0.00034197e0 * sqrt(c) + 0.00025455e0 * sqrt(n) - 0.00024357e0 * sqrt(m) + 0.12173e0) * (sqrt(n) - sqrt(n0))", offset=True)
_ghg("ghg_forcing_etminan2016", "etminan2016",
     "(-2.4e-7 * pow(c - c0, 2) + 7.2e-4 * abs(c - c0) - 2.1e-4 * (n + n0) / 2 + 5.36e0) * ln(c / c0)",
     "(-1.3e-6 * (m + m0) / 2 - 8.2e-6 * (n + n0) / 2 + 0.043e0) * (sqrt(m) - sqrt(m0))",
     "(-8e-6 * (c + c0) / 2 + 4.2e-6 * (n + n0) / 2 - 4.9e-6 * (m + m0) / 2 + 0.117e0) * (sqrt(n) - sqrt(n0))")
_OVER = "0.47e0 * ln(1 + 2.01e-5 * pow({m} * {n}, 0.75e0) + 5.32e-15 * {m} * pow({m} * {n}, 1.52e0))"
_ghg("ghg_forcing_myhre1998", "myhre1998", "5.35e0 * ln(c / c0)",
     f"0.036e0 * (sqrt(m) - sqrt(m0)) - ({_OVER.format(m='m', n='n0')} - {_OVER.format(m='m0', n='n0')})",
     f"0.12e0 * (sqrt(n) - sqrt(n0)) - ({_OVER.format(m='m0', n='n')} - {_OVER.format(m='m0', n='n0')})")
_ghg("ghg_forcing_leach2021", "leach2021", "4.57e0 * ln(c / c0) + 0.086e0 * (sqrt(c) - sqrt(c0))",
     "0.038e0 * (sqrt(m) - sqrt(m0))", "0.106e0 * (sqrt(n) - sqrt(n0))")


# -- linear and aerosol terms ------------------------------------------------------------------

@query("linear_forcing", f"""
select scenario, config, t, {r("coalesce(sum(case when specie <> 'Brand#5' then (emissions - baseline_emissions) * efficiency * 1.1e0 * (1 + 0.05e0) end), 0) / 1013")} as forcing
from a_driven group by scenario, config, t""")
def linear_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.driven_species(spark, sf_dir).withColumns({
        "driver": F.when(F.col("specie") != "Brand#5", F.col("emissions")), "baseline": F.col("baseline_emissions"),
        "scale": X.effective_scale(F.lit(1.1), F.lit(0.05))})
    out = X.linear_forcing(rows).withColumn("forcing", F.col("forcing") / 1013)
    return rounded(out, "forcing")


@query("aerosol_direct", f"""
select scenario, config, t, {r('sum(case when from_concentration then concentration - baseline_concentration when from_emissions then emissions - baseline_emissions end * efficiency * 0.9e0) / 1013')} as forcing
from a_driven group by scenario, config, t""")
def aerosol_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.aerosol_direct(A.driven_species(spark, sf_dir).withColumn("scale", F.lit(0.9)))
    return rounded(out.withColumn("forcing", F.col("forcing") / 1013), "forcing")


@query("aerosol_indirect", f"""
select scenario, config, t, {r('''-0.8e0 * (ln(1 + coalesce(sum(efficiency * emissions) filter (from_emissions), 0) + coalesce(sum(efficiency * concentration) filter (from_concentration), 0))
  - ln(1 + coalesce(sum(efficiency * baseline_emissions) filter (from_emissions), 0) + coalesce(sum(efficiency * baseline_concentration) filter (from_concentration), 0))) * 1.2e0''')} as forcing
from a_driven group by scenario, config, t""")
def aerosol_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.driven_species(spark, sf_dir).withColumns({"aci_scale": F.lit(-0.8), "aci_forcing_scale": F.lit(1.2)})
    return rounded(X.aerosol_indirect(rows, sensitivity="efficiency"), "forcing")


@query("ozone_forcing", f"""
select scenario, config, t, case when count(*) filter (from_emissions and e is null) = 0 then {r('''(coalesce(sum((concentration - baseline_concentration) * efficiency * 1.3e0) filter (from_concentration), 0)
  + coalesce(sum((e - baseline_emissions) * efficiency * 1.3e0) filter (from_emissions), 0)) / 1013''')} end as forcing
from (select *, case when emissions % 100 <> 0 or t < 1999 then emissions end as e from a_driven) x group by scenario, config, t""")
def ozone_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when((F.col("emissions") % 100 != 0) | (F.col("t") < 1999), F.col("emissions"))
    out = X.ozone_forcing(A.driven_species(spark, sf_dir).withColumns({"emissions": some, "scale": F.lit(1.3)}))
    return rounded(out.withColumn("forcing", F.col("forcing") / 1013), "forcing")


@query("eesc", f"""
select scenario, config, t, case when max(case when specie = 'Brand#1' then efficiency end) is not null
  then {r('sum((baseline_emissions + 45 * cast(from_emissions as int)) * concentration * efficiency) / 1013')} end as eesc
from a_driven group by scenario, config, t""")
def eesc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.driven_species(spark, sf_dir).select(*_KEYS, "specie", "concentration", F.col("efficiency").alias("release"),
                                                  F.col("baseline_emissions").alias("cl_atoms"), F.col("from_emissions").cast("int").alias("br_atoms"))
    out = X.eesc(rows, reference="Brand#1")
    return rounded(out.withColumn("eesc", F.col("eesc") / 1013), "eesc")


@query("methane_lifetime_scale", f"""
select scenario, config, t, {r('''exp(sum(ln(1 + efficiency * case when from_emissions then (emissions - baseline_emissions) / 1000 else (concentration - baseline_concentration) / 1000 end))
  + ln(1 + 0.8e0 * 0.04e0))''')} as lifetime_scale from a_driven group by scenario, config, t""")
def methane_lifetime_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.driven_species(spark, sf_dir).withColumns({
        "sensitivity": F.col("efficiency") / 1000, "temperature": F.lit(0.8), "temperature_sensitivity": F.lit(0.04)})
    return rounded(X.methane_lifetime_scale(rows), "lifetime_scale")


@query("species_derived", f"""
with s as (select p_partkey as specie, p_retailprice / 20 as mw, list_transform(range(1, 5), lambda i: (i + p_size % 3) / (10e0 + 4 * (p_size % 3))) as a,
    list_transform(range(1, 5), lambda i: (p_size + 1e0) * i * i) as tau from part),
  f as (select *, list_sum(list_transform(range(1, 5), lambda i: a[i] * tau[i] * (1 - exp(-100 / tau[i])))) as iirf,
    list_sum(list_transform(range(1, 5), lambda i: a[i] * tau[i] * (1 - (1 + 100 / tau[i]) * exp(-100 / tau[i])))) as g1 from s)
select specie, {r('iirf')} as iirf_0, {r('g1')} as g1, {r('exp(-iirf / g1)', 8)} as g0, {r('1 / (5.1352e0 * mw / 28.97e0)')} as concentration_per_emission from f""")
def species_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    boxes = {f"partition_fraction{i}": (i + 1 + k) / (10 + 4 * k) for i in range(4)} \
        | {f"unperturbed_lifetime{i}": (F.col("p_size") + 1.0) * ((i + 1) ** 2) for i in range(4)}
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("specie"), (F.col("p_retailprice") / 20).alias("molecular_weight"),
                                                 *[c.alias(n) for n, c in boxes.items()])
    out = X.species_derived(rows).select("specie", "iirf_0", "g1", "g0", "concentration_per_emission")
    return rounded(rounded(out, "iirf_0", "g1", "concentration_per_emission"), "g0", digits=8)


# -- totals over a run -------------------------------------------------------------------------

@query("total_forcing", f"""
select d.scenario, d.config, d.t, {r('sum(f) / 1013')} as forcing_sum, {r('sum(f * (1 + d.efficiency)) / 1013')} as forcing_efficacy_sum from (
  select d.*, case when d.concentration > 30 then d.concentration + coalesce(b.temperature, 0) * 0.1e0 end as f
  from a_driven d left join (select scenario, config, t + 1 as t, avg(emissions) as temperature from a_driven group by all) b
    on (b.scenario, b.config, b.t) = (d.scenario, d.config, d.t)) d group by d.scenario, d.config, d.t""")
def total_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.driven_species(spark, sf_dir)
    temperature = rows.groupBy(*_KEYS).agg(F.avg("emissions").alias("temperature"))
    f = rows.withColumns({"forcing": F.when(F.col("concentration") > 30, F.col("concentration")), "temperature_feedback": F.lit(0.1),
                          "efficacy": 1 + F.col("efficiency")})
    out = X.total_forcing(f, temperature=temperature, step=1)
    return rounded(out.withColumns({c: F.col(c) / 1013 for c in ("forcing_sum", "forcing_efficacy_sum")}), "forcing_sum", "forcing_efficacy_sum")


@query("co2_total", """
select scenario, config, t, max(case when specie = 'Brand#1' then emissions end) + max(case when specie = 'Brand#2' then emissions end) as emissions
from a_scenario_series where specie in ('Brand#1', 'Brand#2') group by scenario, config, t""")
def co2_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.co2_total(A.scenario_series(spark, sf_dir), fossil="Brand#1", land="Brand#2")


@query("airborne_fraction", f"""
select scenario, config, specie, t, {r('concentration / (sum(emissions) over (partition by scenario, config, specie order by t))')} as airborne_fraction from a_scenario_series""")
def airborne_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["scenario", "config", "specie"]
    run = timeops.cumulative(A.scenario_series(spark, sf_dir), keys, value="emissions")
    out = run.select(*keys, "t", X.airborne_fraction("concentration", "cumulative").alias("airborne_fraction"))
    return rounded(out, "airborne_fraction")


_LAYERS = """
select scenario, config, t, max(case when b = 1 then e end) as t0, max(case when b = 2 then e end) as t1, max(case when b = 3 then e end) as t2 from (
  select scenario, config, t, cast(substr(specie, 7) as int) as b, sum(emissions) / 1013 as e from a_scenario_series group by all) x group by scenario, config, t"""
_TOA = """
select scenario, config, t, f - 1.3e0 * t0 + (1 - 1.2e0) * 0.7e0 * (t1 - t2) as n from h_layers join (
  select scenario, config, t, avg(concentration) / 97 as f from a_scenario_series group by all) y using (scenario, config, t)"""


def _imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.scenario_series(spark, sf_dir)
    layer = F.substring("specie", 7, 3).cast("int") - 1
    temperature = s.groupBy(*_KEYS, layer.alias("layer")).agg((F.sum("emissions") / 1013).alias("temperature")).filter("layer < 3")
    forcing = s.groupBy(*_KEYS).agg((F.avg("concentration") / 97).alias("forcing_sum"))
    configs = s.select("config").distinct().withColumns({"kappa1": F.lit(1.3), "kappa3": F.lit(0.7), "efficacy": F.lit(1.2)})
    return X.toa_imbalance(temperature, forcing, configs)


@query("toa_imbalance", f"select scenario, config, t, {r('n')} as toa_imbalance from h_toa", h_layers=_LAYERS, h_toa=_TOA)
def toa_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_imbalance(spark, sf_dir), "toa_imbalance")


@query("ocean_heat", f"""
select scenario, config, t, {r('(sum(n) over w - first_value(n) over w) * 4 * pi() * 6371000e0 * 6371000e0 * 365.24219e0 * 86400 / 1e22', 5)} as zettajoules
from h_toa window w as (partition by scenario, config order by t)""", h_layers=_LAYERS, h_toa=_TOA)
def ocean_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _imbalance(spark, sf_dir)
    out = X.ocean_heat(some).select("scenario", "config", "t", (F.col("ocean_heat") / 1e22).alias("zettajoules"))
    return rounded(out, "zettajoules", digits=5)
