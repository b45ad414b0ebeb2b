"""Canonical tables derived from the driver tables, as DataFrames and as portable SQL.

The model data sets cannot be shipped, so fields, series, scenarios and species are reduced from the
relational tables.  ``VIEWS`` states the same tables in SQL for the oracle.  Scales such as 0.97 and 1013
keep means away from exact decimals, where engines break rounding ties differently.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.schema import literal_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).cast("int").alias("cell_id")).distinct()
    lat_idx, lon_idx = F.floor(F.col("cell_id") / 10).cast("int"), (F.col("cell_id") % 10).cast("int")
    return ids.select("cell_id", lat_idx.alias("lat_idx"), lon_idx.alias("lon_idx"),
                      (-81 + 18 * lat_idx).cast("double").alias("lat"), (36 * lon_idx).cast("double").alias("lon"))


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, member, date, cell_id, tas, pr): daily means per cell."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("experiment"), F.col("l_returnflag").alias("member"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_suppkey") % 100).cast("int").alias("cell_id"), "l_quantity", "l_extendedprice")
    return rows.groupBy("experiment", "member", "date", "cell_id").agg(
        F.round(F.avg("l_quantity"), 6).alias("tas"), F.round(F.avg("l_extendedprice"), 6).alias("pr"))


def daily(spark: SparkSession, sf_dir: str, variable: str) -> DataFrame:
    """One daily field in model units: temperature in K, precipitation in m/s."""
    value = F.col("tas") + 265 if variable == "tas" else F.col("pr") / 4013 / 86400 / 1000
    return obs_daily(spark, sf_dir).select("experiment", "member", "date", "cell_id", value.alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, member, year, month, cell_id, value): monthly temperature means."""
    return obs_daily(spark, sf_dir).groupBy(
        "experiment", "member", F.year("date").alias("year"), F.month("date").alias("month"), "cell_id").agg((F.avg("tas") / F.lit(0.97)).alias("value"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, experiment, member, year, cell_id, value) for tas and pr (in thousands)."""
    mean = obs_daily(spark, sf_dir).groupBy("experiment", "member", F.year("date").alias("year"), "cell_id") \
        .agg((F.avg("tas") / F.lit(0.97)).alias("tas"), (F.avg("pr") / 1013).alias("pr"))
    return mean.unpivot(["experiment", "member", "year", "cell_id"], ["tas", "pr"], "variable", "value") \
        .select("variable", "experiment", "member", "year", "cell_id", "value")


def global_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, year, driver): the global series of each scenario."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("year")) \
        .agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("driver"))


def global_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, k, value): consecutive months per scenario, k counts from January 1995."""
    k = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scenario"), k.alias("k")) \
        .agg((F.avg("l_extendedprice") / 10130).alias("value"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 100).cast("int").alias("cell_id")) \
        .agg(F.round(F.sum(F.abs("c_acctbal")), 2).alias("persons"))


# a square with a hole, a triangle, a concave shape, two parts, and one at the date line
_EDGES = [
    (0, 0, 0, 30, -50, 130, -50), (0, 0, 0, 130, -50, 130, 50), (0, 0, 0, 130, 50, 30, 50), (0, 0, 0, 30, 50, 30, -50),
    (0, 0, 1, 60, -20, 90, -20), (0, 0, 1, 90, -20, 90, 20), (0, 0, 1, 90, 20, 60, 20), (0, 0, 1, 60, 20, 60, -20),
    (1, 0, 0, -120, -70, -20, -70), (1, 0, 0, -20, -70, -70, 40), (1, 0, 0, -70, 40, -120, -70),
    (2, 0, 0, -10, 55, 160, 55), (2, 0, 0, 160, 55, 160, 88), (2, 0, 0, 160, 88, 100, 88), (2, 0, 0, 100, 88, 100, 70),
    (2, 0, 0, 100, 70, -10, 70), (2, 0, 0, -10, 70, -10, 55),
    (3, 0, 0, -40, -5, 10, -5), (3, 0, 0, 10, -5, 10, 30), (3, 0, 0, 10, 30, -40, 30), (3, 0, 0, -40, 30, -40, -5),
    (3, 1, 0, 140, -85, 181, -85), (3, 1, 0, 181, -85, 181, -50), (3, 1, 0, 181, -50, 140, -50), (3, 1, 0, 140, -50, 140, -85),
    (4, 0, 0, -180, 50, -100, 50), (4, 0, 0, -100, 50, -100, 85), (4, 0, 0, -100, 85, -180, 85), (4, 0, 0, -180, 85, -180, 50),
]


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a, b, c, float(x1), float(y1), float(x2), float(y2)) for a, b, c, x1, y1, x2, y2 in _EDGES]
    shapes = literal_table(spark, rows, ["region_id", "part_id", "ring_id", "x1", "y1", "x2", "y2"])
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))
    return shapes.join(names, "region_id")


def scenario_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide scenario table with inner, leading and trailing gaps."""
    y = F.year("o_orderdate")
    price = F.col("o_totalprice")

    def total(year: int, but: str | None = None) -> Column:
        hit = (y == year) & (F.col("o_orderstatus") != but) if but else y == year
        return F.round(F.sum(F.when(hit, price)) / 1000000, 6).alias(f"y{year}")

    gap = lambda year: F.lit(None).cast("double").alias(f"y{year}")
    sums = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        total(1995, "P"), total(1996), total(1998), total(2001, "F"))
    return sums.select(F.col("o_orderpriority").alias("scenario"), F.lit("World").alias("region"),
                       F.concat(F.lit("Emissions|"), "o_orderstatus").alias("variable"), F.lit("Gt C/yr").alias("unit"),
                       "y1995", "y1996", gap(1997), "y1998", gap(1999), gap(2000), "y2001")


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("specie")).agg(
        F.round(F.avg("p_size") / 1000, 6).alias("efficiency"), F.round(F.min("p_retailprice") / 1000, 6).alias("baseline_concentration"),
        F.min("p_size").cast("double").alias("baseline_emissions"),
        (F.max("p_size") % 2 == 0).alias("from_emissions"), (F.max("p_size") % 2 != 0).alias("from_concentration"))


def scenario_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, config, specie, t, emissions, concentration)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_linestatus").alias("scenario"), F.col("l_returnflag").alias("config"), F.col("p_brand").alias("specie"),
                        F.year("l_shipdate").alias("t")) \
        .agg(F.round(F.sum("l_quantity"), 6).alias("emissions"), F.round(F.max("l_extendedprice") / 1000, 5).alias("concentration"))


def driven_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario series with the species parameters next to them."""
    return scenario_series(spark, sf_dir).join(species(spark, sf_dir), "specie")


def three_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("t")).agg(
        F.round(270 + mean / 2000, 6).alias("co2"), F.round(700 + mean / 250, 6).alias("ch4"), F.round(265 + mean / 4000, 6).alias("n2o"))


def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(band, k, value): amounts per band and day, as steps."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("band"), (F.day("ts") - 1).cast("int").alias("k")) \
        .agg(F.round(F.sum("value") / 1000, 6).alias("value"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter ensemble: one config per nation."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("config")).agg(
        F.round(F.avg("c_acctbal") / 1000, 6).alias("fscale_volcanic"), F.round(F.min("c_acctbal") / 1000, 6).alias("fscale_solar_amplitude"),
        F.round(F.max("c_acctbal") / 10000, 6).alias("fscale_solar_trend"), F.count("*").cast("double").alias("clim_c1"))


VIEWS = {
    "a_cells": """
select cell_id, cast(floor(cell_id / 10) as int) as lat_idx, cast(cell_id % 10 as int) as lon_idx,
       cast(-81 + 18 * floor(cell_id / 10) as double) as lat, cast(36 * (cell_id % 10) as double) as lon
from (select distinct cast(s_suppkey % 100 as int) as cell_id from supplier) s""",
    "a_obs_daily": """
select l_linestatus as experiment, l_returnflag as member, cast(l_shipdate as date) as date,
       cast(l_suppkey % 100 as int) as cell_id, round(avg(l_quantity), 6) as tas, round(avg(l_extendedprice), 6) as pr
from lineitem group by l_linestatus, l_returnflag, cast(l_shipdate as date), cast(l_suppkey % 100 as int)""",
    "a_daily": """
select experiment, member, date, cell_id, tas + 265 as tas, pr / 4013 / 86400 / 1000 as pr from a_obs_daily""",
    "a_monthly": """
select experiment, member, cast(year(date) as int) as year, cast(month(date) as int) as month, cell_id, avg(tas) / 0.97e0 as value
from a_obs_daily group by all""",
    "a_annual_wide": """
select experiment, member, cast(year(date) as int) as year, cell_id, avg(tas) / 0.97e0 as tas, avg(pr) / 1013 as pr
from a_obs_daily group by experiment, member, year(date), cell_id""",
    "a_annual": """
select 'tas' as variable, experiment, member, year, cell_id, tas as value from a_annual_wide
union all select 'pr', experiment, member, year, cell_id, pr from a_annual_wide""",
    "a_global_annual": """
select o_orderpriority as scenario, cast(year(o_orderdate) as int) as year, round(avg(o_totalprice) / 100000, 6) as driver
from orders group by o_orderpriority, year(o_orderdate)""",
    "a_global_monthly": """
select l_returnflag as scenario, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as k, avg(l_extendedprice) / 10130 as value
from lineitem group by 1, 2""",
    "a_population": """
select cast(c_custkey % 100 as int) as cell_id, round(sum(abs(c_acctbal)), 2) as persons
from customer group by cast(c_custkey % 100 as int)""",
    "a_region_edges": """
select e.region_id, r.r_name as region, e.part_id, e.ring_id,
       cast(e.x1 as double) as x1, cast(e.y1 as double) as y1, cast(e.x2 as double) as x2, cast(e.y2 as double) as y2
from (values %s) as e(region_id, part_id, ring_id, x1, y1, x2, y2) join region r on r.r_regionkey = e.region_id""" % ", ".join(map(str, _EDGES)),
    "a_scenario_wide": """
select o_orderpriority as scenario, 'World' as region, concat('Emissions|', o_orderstatus) as variable, 'Gt C/yr' as unit,
  round(sum(case when year(o_orderdate) = 1995 and o_orderstatus <> 'P' then o_totalprice end) / 1000000, 6) as y1995,
  round(sum(case when year(o_orderdate) = 1996 then o_totalprice end) / 1000000, 6) as y1996,
  cast(null as double) as y1997,
  round(sum(case when year(o_orderdate) = 1998 then o_totalprice end) / 1000000, 6) as y1998,
  cast(null as double) as y1999, cast(null as double) as y2000,
  round(sum(case when year(o_orderdate) = 2001 and o_orderstatus <> 'F' then o_totalprice end) / 1000000, 6) as y2001
from orders group by o_orderpriority, o_orderstatus""",
    "a_scenario_long": """
select scenario, region, variable, unit, 1995 as t, y1995 as value from a_scenario_wide
union all select scenario, region, variable, unit, 1996, y1996 from a_scenario_wide
union all select scenario, region, variable, unit, 1997, y1997 from a_scenario_wide
union all select scenario, region, variable, unit, 1998, y1998 from a_scenario_wide
union all select scenario, region, variable, unit, 1999, y1999 from a_scenario_wide
union all select scenario, region, variable, unit, 2000, y2000 from a_scenario_wide
union all select scenario, region, variable, unit, 2001, y2001 from a_scenario_wide""",
    "a_species": """
select p_brand as specie, round(avg(p_size) / 1000, 6) as efficiency, round(min(p_retailprice) / 1000, 6) as baseline_concentration,
       cast(min(p_size) as double) as baseline_emissions,
       max(p_size) % 2 = 0 as from_emissions, max(p_size) % 2 <> 0 as from_concentration
from part group by p_brand""",
    "a_scenario_series": """
select l_linestatus as scenario, l_returnflag as config, p_brand as specie, cast(year(l_shipdate) as int) as t,
       round(sum(l_quantity), 6) as emissions, round(max(l_extendedprice) / 1000, 5) as concentration
from lineitem join part on l_partkey = p_partkey group by l_linestatus, l_returnflag, p_brand, year(l_shipdate)""",
    "a_driven": """
select s.*, p.efficiency, p.baseline_concentration, p.baseline_emissions, p.from_emissions, p.from_concentration
from a_scenario_series s join a_species p on s.specie = p.specie""",
    "a_three_gas": """
select o_orderpriority as scenario, cast(year(o_orderdate) as int) as t, round(270 + avg(o_totalprice) / 2000, 6) as co2,
       round(700 + avg(o_totalprice) / 250, 6) as ch4, round(265 + avg(o_totalprice) / 4000, 6) as n2o
from orders group by o_orderpriority, year(o_orderdate)""",
    "a_injection": """
select event_type as band, cast(day(ts) - 1 as int) as k, round(sum(value) / 1000, 6) as value
from events group by event_type, day(ts)""",
    "a_configs": """
select cast(c_nationkey as varchar) as config, round(avg(c_acctbal) / 1000, 6) as fscale_volcanic,
       round(min(c_acctbal) / 1000, 6) as fscale_solar_amplitude, round(max(c_acctbal) / 10000, 6) as fscale_solar_trend,
       cast(count(*) as double) as clim_c1
from customer group by c_nationkey""",
    # cells inside each polygon, by crossing counts
    "a_inside": """
select region_id, region, cell_id from (
  select e.region_id, e.region, e.part_id, c.cell_id
  from (select cell_id, lat, case when lon > 180 then lon - 360 else lon end as x from a_cells) c
  join a_region_edges e on (e.y1 > c.lat) <> (e.y2 > c.lat)
   and c.x < e.x1 + (c.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  group by all having count(*) % 2 = 1) p
group by region_id, region, cell_id""",
    "a_land": "select distinct cell_id from a_inside",
}


def oracle(body: str, **extra: str) -> str:
    """A query over the views it names (transitively), as one statement."""
    views = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} as ({views[n]})" for n in needed)
    body = body.strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"with {head}\n{body}"
