"""End products: daily to monthly to annual, fits, maps, deltas, injections, summaries and the sweep."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.columns import check_variable, floor_zero, flux_to_mm_day, lat_weight
from gridspark.operators import align, signal, spatial, stats, timeops
from gridspark.schema import (CANVAS_START_YEAR, DAILY_THRESHOLDS, EXPERIMENT_WINDOW, FIRST_PROJECTED_YEAR, FIRST_START_YEAR, FIT_VARIABLES,
                              LAST_HISTORICAL_YEAR, LAST_START_YEAR, PREINDUSTRIAL, REPLICATES, SWEEP_VARIABLES, TARGET_TENTHS, VARIABLES, sql_literal,
                              variable_flag)
from gridspark.scratch import settle
from gridspark.sources.grid import BATCH_ROWS, read_labels, write_missing

# -- variables ---------------------------------------------------------------------------------

def expand_variables(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows of source variables become rows of every wanted variable computed from them."""
    for v in variables:
        check_variable(v)
    wanted: dict[str, list[str]] = {}
    for v in variables:
        wanted.setdefault(VARIABLES[v].source, []).append(v)
    pairs = ", ".join(f"{sql_literal(s)}, array({', '.join(map(sql_literal, vs))})" for s, vs in wanted.items())
    return df.withColumn("variable", F.explode(F.expr(f"map({pairs})")[F.col("variable")]))


def land_and_people(df: DataFrame, land: DataFrame, population: DataFrame | None, values: Sequence[str] = ("value",)) -> DataFrame:
    """Keep the land cells of land-only variables and weight exposures by persons (in millions).

    Both only depend on the cell, so patterns get them before they are multiplied out over time.
    """
    flag = lambda f: variable_flag(F.col("variable"), f)
    cells = land.select("cell_id", F.lit(True).alias("_land")).distinct()
    df = df.join(cells, "cell_id", "left").filter(~flag("land_only") | F.col("_land")).drop("_land")
    if population is not None:
        df = df.join(population.select("cell_id", "persons"), "cell_id", "left")
        df = df.filter(~flag("is_exposure") | F.col("persons").isNotNull())
        weight = F.when(flag("is_exposure"), F.col("persons") / 1e6).otherwise(F.lit(1.0))
        df = df.withColumns({v: F.col(v) * weight for v in values}).drop("persons")
    return df


def floor_counts(df: DataFrame) -> DataFrame:
    """Day counts (and exposures, whose weights are not negative) are at least zero."""
    count = variable_flag(F.col("variable"), "is_count")
    return df.withColumn("value", F.when(count, floor_zero("value")).otherwise(F.col("value")))


def subtract_baseline(df: DataFrame, baseline: DataFrame, sign: int = -1) -> DataFrame:
    """Subtract (or add back) the historical mean map for the variables that are reported relative to it."""
    base = baseline.select("variable", "cell_id", F.col("value").alias("_base"))
    out = df.join(base, ["variable", "cell_id"], "left")
    change = F.when(variable_flag(F.col("variable"), "rebase"), F.col("value") + sign * F.col("_base")).otherwise(F.col("value"))
    return out.withColumn("value", change).drop("_base")


# -- daily and monthly jobs --------------------------------------------------------------------

def process_daily(daily: DataFrame, variable: str, keys: Sequence[str] = ("experiment", "member", "cell_id"),
                  thresholds: Sequence[tuple[str, str, float]] | None = None, drop_empty: bool = True) -> DataFrame:
    """Monthly products of one daily variable as (variable, keys, year, month, value), in one group-by.

    Temperature gives monthly extremes and three day counts, precipitation two day counts.
    """
    check_variable(variable, ["tas", "pr"])
    limits = DAILY_THRESHOLDS[variable] if thresholds is None else thresholds
    if variable == "tas" and drop_empty:
        daily = align.drop_degenerate_days(daily, [k for k in keys if k != "cell_id"])
    if variable == "pr":
        daily = daily.withColumn("value", flux_to_mm_day(F.lit("pr"), "value"))
    wide = timeops.daily_indices(daily, keys, limits, extremes=variable == "tas")
    named = {"tasmax": "max", "tasmin": "min"} if variable == "tas" else {}
    named |= {name: name for name, _, _ in limits}
    cells = [F.struct(F.lit(v).alias("variable"), F.col(c).cast("double").alias("value")) for v, c in named.items()]
    return wide.select(*keys, "year", "month", F.inline(F.array(*cells)))


@dataclass
class MonthlyProducts:
    annual: DataFrame               # (variable, experiment, year, cell_id, value), ensemble means on the target grid
    natural: DataFrame              # (variable, value)
    regional: DataFrame             # (variable, cell_id, value) on the target grid


def annual_members(monthly: DataFrame) -> DataFrame:
    """Members' annual fields, fluxes converted; ``variable`` decides the annual rule."""
    converted = monthly.withColumn("value", flux_to_mm_day("variable", "value"))
    return timeops.monthly_to_annual(converted, ["variable", "experiment", "member", "cell_id"])


def process_monthly(monthly: DataFrame, cells: DataFrame, target_cells: DataFrame | None = None, baseline: str = "baseline",
                    history: str = "historical", fit: tuple[int, int] = stats.VARIABILITY_FIT,
                    window: tuple[int, int] = stats.VARIABILITY_WINDOW,
                    last_historical: int = LAST_HISTORICAL_YEAR) -> MonthlyProducts:
    """Annual ensemble means, scalar and per-cell variability of all variables in one plan.

    Members' annual fields, a twelfth of the input, are written once and feed every product.  Averaging
    over members and regridding are both linear, so members are averaged before the regrid.
    """
    annual = settle(annual_members(monthly), "annual")
    base = annual.filter(F.col("experiment") == baseline)
    natural = stats.natural_variability(base, cells, window=fit)
    regional = stats.regional_variability(base, fit=fit, window=window)
    past = annual.filter(F.col("experiment") == history)
    rest = annual.filter(F.col("experiment") != history)
    joined = align.append_history(past, rest, last_historical, baseline)
    mean = timeops.ensemble_mean(joined, ["member"])
    if target_cells is not None:
        mean = spatial.bilinear_regrid(mean, cells, target_cells, ["variable", "experiment", "year"])
        regional = spatial.bilinear_regrid(regional, cells, target_cells, ["variable"])
    mean = mean.select("variable", "experiment", "year", "cell_id", "value")
    return MonthlyProducts(precipitation_minus_evaporation(mean), natural, regional)


def precipitation_minus_evaporation(annual: DataFrame) -> DataFrame:
    """Replace the evaporation product stored under p-e by precipitation minus it."""
    keys = ["experiment", "year", "cell_id"]
    pe = align.precip_minus_evap(annual.filter("variable = 'pr'").drop("variable"), annual.filter("variable = 'p-e'").drop("variable"), keys)
    rest = annual.filter("variable <> 'p-e'")
    return rest.unionByName(pe.withColumn("variable", F.lit("p-e")).select(*rest.columns))


# -- fits --------------------------------------------------------------------------------------

def fit_map(annual: DataFrame, series: DataFrame, replicates: int = REPLICATES, **kw) -> DataFrame:
    """Bootstrap fits of annual maps (variable, model, scenario, year, cell_id, value) to the global series."""
    years = series.select("scenario", "year").distinct()
    rows = annual.join(years, ["scenario", "year"], "left_semi")
    return stats.bootstrap_ols(rows, series, ["variable", "model"], replicates, **kw)


def experiment_changes(annual: DataFrame, targets: Sequence[str], baseline: str, window: tuple[int, int]) -> DataFrame:
    """(variable, target, cell_id, value): experiment minus baseline mean over one window, one pass."""
    sel = annual.filter(F.col("experiment").isin([*targets, baseline]) & F.col("year").between(*window))
    mean = lambda e: F.avg(F.when(F.col("experiment") == e, F.col("value")))
    wide = sel.groupBy("variable", "cell_id").agg(mean(baseline).alias("_b"), *[mean(t).alias(f"_{i}") for i, t in enumerate(targets)])
    rows = [F.struct(F.lit(t).alias("target"), (F.col(f"_{i}") - F.col("_b")).alias("value")) for i, t in enumerate(targets)]
    return wide.select("variable", "cell_id", F.inline(F.array(*rows)))


def fit_delta(annual: DataFrame, cells: DataFrame, targets: Sequence[str] = ("1.5", "1.0", "0.5"), baseline: str = "baseline",
              window: tuple[int, int] = EXPERIMENT_WINDOW, injections: DataFrame | None = None,
              predictor_variable: str = "tas") -> tuple[DataFrame, DataFrame | None]:
    """Slopes (variable, cell_id, slope) of change on the change of the global temperature mean.

    ``injections`` (target, lat, value), already averaged over the window, are fitted the same way with
    a zero baseline: (lat, slope).
    """
    change = settle(experiment_changes(annual, targets, baseline, window), "changes")
    x = stats.area_weighted_mean(change.filter(F.col("variable") == predictor_variable), cells, ["target"]) \
        .withColumnRenamed("value", "driver")
    slopes = stats.slope_through_origin(change, x)
    by_lat = stats.slope_through_origin(injections, x, ["lat"]) if injections is not None else None
    return slopes, by_lat


def fit_all(annual: DataFrame, scenario_maps: DataFrame, series: DataFrame, cells: DataFrame, path: str, injections: DataFrame | None = None,
            delta_window: tuple[int, int] = EXPERIMENT_WINDOW, ignore_existing: bool = False, variables: Sequence[str] = tuple(FIT_VARIABLES), **kw) -> dict[str, bool]:
    """Write the fits of every one of ``variables`` that are not there yet: map fits, change fits and, if given, injection fits."""
    spark, done = annual.sparkSession, {}
    annual, scenario_maps = (d.filter(F.col("variable").isin(list(variables))) for d in (annual, scenario_maps))
    both = ["variable", "model"]
    done["coef"] = write_missing(
        spark, scenario_maps.select(*both).distinct(), f"{path}/coef", both,
        lambda todo: fit_map(scenario_maps.join(todo, both, "left_semi"), series, **kw), ignore_existing)
    slopes, by_lat = fit_delta(annual, cells, window=delta_window, injections=injections)
    done["delta_slope"] = write_missing(
        spark, annual.select("variable").distinct(), f"{path}/delta_slope", ["variable"],
        lambda todo: slopes.join(todo, "variable", "left_semi"), ignore_existing)
    if by_lat is not None:
        done["injection_slope"] = write_missing(
            spark, injections.select(F.lit("injection").alias("quantity")).distinct(), f"{path}/injection_slope", ["quantity"],
            lambda todo: by_lat.withColumn("quantity", F.lit("injection")), ignore_existing)
    return done


# -- input series ------------------------------------------------------------------------------

def global_series(temperature: DataFrame, window: tuple[int, int] = PREINDUSTRIAL) -> DataFrame:
    """(scenario, year, driver): surface-layer temperature of every config relative to its own
    pre-industrial mean, averaged over configs.  ``temperature`` is (scenario, config, layer, year, value)."""
    surface = align.select_label(temperature, layer=0)
    own = timeops.rebase(surface, ["scenario", "config"], window)
    return timeops.ensemble_mean(own, ["config"]).withColumnRenamed("value", "driver")


def observed_series(obs: DataFrame, window: tuple[int, int] = PREINDUSTRIAL) -> DataFrame:
    """(year, value): observed anomalies relative to their own pre-industrial mean."""
    return timeops.rebase(obs, [], window)


def controller_injections(table: DataFrame, columns: dict[str, float], window: tuple[int, int] = EXPERIMENT_WINDOW) -> DataFrame:
    """(target, lat, value): injected amounts of the controllers, averaged over members, then over the window.

    ``table`` comes from the whitespace-table reader: the target is read from the file name, and
    ``columns`` maps amount columns to latitudes.
    """
    name = F.col("file")
    target = F.when(name.contains("Lower-1.0"), F.lit("0.5")).when(name.contains("Lower-0.5"), F.lit("1.0")).otherwise(F.lit("1.5"))
    cells = [F.struct(F.lit(float(lat)).alias("lat"), F.col(c).alias("value")) for c, lat in columns.items()]
    long = table.select(target.alias("target"), "file", "year", F.inline(F.array(*cells)))
    mean = timeops.ensemble_mean(long, ["file"])
    return mean.filter(F.col("year").between(*window)).groupBy("target", "lat").agg(F.avg("value").alias("value"))


# -- maps --------------------------------------------------------------------------------------

def mean_coefs(coef: DataFrame, model: str | None = None) -> DataFrame:
    """Mean over replicates of a*T + b is mean(a)*T + mean(b): predict once instead of per replicate.

    Replicates of one model are averaged, never models: name one where there are several, else reading is an error.
    """
    own = coef if model is None else coef.filter(F.col("model") == model)
    one = F.min("model").eqNullSafe(F.max("model"))
    several = F.raise_error(F.lit("coefficients of several models: name one")).cast("double")
    return own.groupBy("variable", "cell_id").agg(*[F.when(one, F.avg(c)).otherwise(several).alias(c) for c in ("slope", "intercept")])


def predict_map(coef: DataFrame, series: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None = None,
                baseline: DataFrame | None = None, first_year: int = FIRST_PROJECTED_YEAR, last_year: int = align.LAST_YEAR,
                model: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Projected maps (variable, scenario, year, cell_id, value) of one model from the global series.

    ``pairs`` (variable, scenario) restricts the product before it is formed.
    """
    drivers = series.filter(F.col("year").between(first_year, last_year)).select("scenario", "year", "driver")
    patterns = land_and_people(expand_variables(mean_coefs(coef, model), variables), land, population, ["slope", "intercept"])
    if pairs is None:
        out = align.outer_scale(patterns, drivers, intercept="intercept")
    else:
        out = align.outer_scale(patterns, drivers.join(pairs.select("variable", "scenario").distinct(), "scenario"), ["variable"], intercept="intercept")
    out = floor_counts(out).select("variable", "scenario", "year", "cell_id", "value")
    return subtract_baseline(out, baseline) if baseline is not None else out


def historical_map(annual: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None = None,
                   last_year: int = LAST_HISTORICAL_YEAR, experiments: Column | None = None) -> DataFrame:
    """Historical maps (variable, year, cell_id, value), not rebased; each variable from its own experiment."""
    source = experiments if experiments is not None else variable_flag(F.col("variable"), "history")
    past = annual.filter((F.col("year") <= last_year) & (F.col("experiment") == source)).drop("experiment")
    return land_and_people(floor_counts(expand_variables(past, variables)), land, population)


def baseline_map(history: DataFrame, window: tuple[int, int] = PREINDUSTRIAL) -> DataFrame:
    """(variable, cell_id, value): the historical mean that maps are compared with."""
    return history.filter(F.col("year").between(*window)).groupBy("variable", "cell_id").agg(F.avg("value").alias("value"))


def pvalue_maps(maps: DataFrame, baseline: DataFrame, variability: DataFrame, land: DataFrame, rebased: bool = True,
                keys: Sequence[str] = ("variable", "scenario"), **kw) -> DataFrame:
    """Decadal p-values of maps against the baseline; rebased variables get it added back first."""
    full = subtract_baseline(maps, baseline, +1) if rebased else maps
    std = expand_variables(variability, [*VARIABLES]) if "variable" in variability.columns else variability
    return stats.regional_pvalues(full, baseline, std, land, keys, **kw)


def decade_pvalues(means: DataFrame, baseline: DataFrame, variability: DataFrame, land: DataFrame, rebased: bool = True,
                   keys: Sequence[str] = ("variable", "scenario")) -> DataFrame:
    """p-values of decadal means (keys, cell_id, decade_end, value), as ``pvalue_maps`` has them for yearly maps."""
    full = subtract_baseline(means, baseline, +1) if rebased else means
    std = expand_variables(variability, [*VARIABLES]) if "variable" in variability.columns else variability
    return stats.decade_pvalues(full, baseline, std, land, keys)


def country_exposure(maps: DataFrame, population: DataFrame, cells: DataFrame, boundaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell_id, country, value): persons exposed (in millions), summed per country and written back to its cells.

    Country and persons of a cell are found once; rows meet them in one join and only totals are joined back.  Cells
    of no country get 0.
    """
    places = spatial.assign_country(cells, boundaries).join(population.select("cell_id", "persons"), "cell_id")
    rows = maps.join(settle(places, "places"), "cell_id").withColumn("value", F.col("value") * F.col("persons") / 1e6).drop("persons")
    totals = rows.filter(F.col("country") != 0).groupBy(*keys, "country").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_total"))
    back = rows.join(settle(totals, "country-exposure"), [*keys, "country"], "left")
    return back.withColumn("value", F.coalesce("_total", F.lit(0.0))).select(*keys, "cell_id", "country", "value")


# -- gap, delta, injection ---------------------------------------------------------------------

def temp_gap(tas_map: DataFrame, cells: DataFrame, target_tenths: tuple[int, int] | Sequence[int]) -> DataFrame:
    """(scenario, target_tenths, year, temp_diff): target minus the area mean of the temperature map."""
    mean = stats.area_weighted_mean(tas_map, cells, ["scenario", "year"])
    tenths = F.explode(F.sequence(*map(F.lit, target_tenths)) if isinstance(target_tenths, tuple) else F.array(*map(F.lit, target_tenths)))
    return mean.withColumn("target_tenths", tenths) \
        .select("scenario", "target_tenths", "year", (F.col("target_tenths") / F.lit(10.0) - F.col("value")).alias("temp_diff"))


def pattern_gap(coef: DataFrame, series: DataFrame, cells: DataFrame, target_tenths: tuple[int, int] | Sequence[int], baseline: DataFrame | None = None,
                model: str | None = None, first_year: int = FIRST_PROJECTED_YEAR, last_year: int = align.LAST_YEAR) -> DataFrame:
    """(scenario, target_tenths, year, temp_diff) as ``temp_gap`` has it of the temperature map.

    The area mean of the map is mean slope * driver + mean intercept - mean base: only the coefficients are read.
    """
    tas = coef.filter(F.col("variable") == "tas")
    if tas.isEmpty():
        raise ValueError("the gap to a target needs fits of 'tas'")
    if baseline is not None and baseline.filter(F.col("variable") == "tas").isEmpty():
        raise ValueError("the gap to a target needs the baseline of 'tas'")
    own = mean_coefs(tas, model)
    base = baseline.filter(F.col("variable") == "tas").select("cell_id", F.col("value").alias("base")) if baseline is not None else None
    own = own.join(base, "cell_id", "left") if base is not None else own.withColumn("base", F.lit(0.0))
    own = own.join(cells.select("cell_id", "lat"), "cell_id")
    level = F.col("intercept") - F.col("base")
    w = F.when(F.col("slope").isNotNull() & level.isNotNull(), lat_weight("lat"))
    mean = settle(own.agg(F.try_divide(F.sum(w * F.col("slope")), F.sum(w)).alias("_a"), F.try_divide(F.sum(w * level), F.sum(w)).alias("_b")), "mean-pattern")
    drivers = series.filter(F.col("year").between(first_year, last_year)).select("scenario", "year", "driver")
    rows = align.blocked_product(drivers, mean, "year")
    tenths = F.explode(F.sequence(*map(F.lit, target_tenths)) if isinstance(target_tenths, tuple) else F.array(*map(F.lit, target_tenths)))
    return rows.withColumn("target_tenths", tenths).select(
        "scenario", "target_tenths", "year", (F.col("target_tenths") / F.lit(10.0) - (F.col("_a") * F.col("driver") + F.col("_b"))).alias("temp_diff"))


def gated_gap(gap: DataFrame, start_year: int, ramp_years: int, keys: Sequence[str] = ("scenario", "target_tenths"), **kw) -> DataFrame:
    """The gap from the start year on, gated and ramped: both only depend on time, so they come before the map product."""
    g = gap.filter(F.col("year") >= start_year).withColumn("driver", F.col("temp_diff"))
    return timeops.gate_and_ramp(g, keys, ramp_years, value="driver", **kw).select(*keys, "year", "driver")


def regional_delta(slopes: DataFrame, gap: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None,
                   start_year: int, ramp_years: int, keys: DataFrame | None = None, **kw) -> DataFrame:
    """(variable, scenario, target_tenths, year, cell_id, value): slope map times the gated gap.

    ``keys`` (variable, scenario, target_tenths) restricts the product before it is formed.
    """
    drivers = gated_gap(gap, start_year, ramp_years, **kw)
    patterns = land_and_people(expand_variables(slopes, variables), land, population, ["slope"])
    if keys is None:
        return align.outer_scale(patterns, drivers)
    wanted = drivers.join(keys.select("variable", "scenario", "target_tenths").distinct(), ["scenario", "target_tenths"])
    return align.outer_scale(patterns, wanted, ["variable"])


def delta_decades(maps: DataFrame, slopes: DataFrame, gap: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None,
                  keys: DataFrame, start_year: int, ramp_years: int, **decades) -> DataFrame:
    """Decadal means of map plus delta (variable, scenario, target_tenths, cell_id, decade_end, value), without the delta maps.

    Both parts are linear in time: mean(map) + slope * mean(gated gap), over the years that both have.
    """
    drivers = gated_gap(gap, start_year, ramp_years)
    patterns = settle(land_and_people(expand_variables(slopes, variables), land, population, ["slope"]), "pattern")
    means = timeops.decadal_means(maps.filter(F.col("year") >= start_year), ["variable", "scenario", "cell_id"], **decades)
    push = timeops.decadal_means(drivers.withColumnRenamed("driver", "value"), ["scenario", "target_tenths"], **decades).withColumnRenamed("value", "_push")
    push = settle(push.join(keys.select("variable", "scenario", "target_tenths").distinct(), ["scenario", "target_tenths"]), "push")
    rows = means.join(patterns, ["variable", "cell_id"]).join(push, ["variable", "scenario", "decade_end"])
    return rows.withColumn("value", F.col("value") + F.col("slope") * F.col("_push")).drop("slope", "_push")


def injection_by_latitude(slopes: DataFrame, gap: DataFrame, start_years: tuple[int, int], ramp_years: int = 10,
                          last_year: int = align.LAST_YEAR) -> DataFrame:
    """(scenario, target_tenths, start_year, year, lat, value) for every start year."""
    keys = ["scenario", "target_tenths", "start_year"]
    g = gap.withColumn("start_year", F.explode(F.sequence(*map(F.lit, start_years)))).filter(F.col("year") >= F.col("start_year"))
    g = timeops.gate_and_ramp(g.withColumn("driver", F.col("temp_diff")), keys, ramp_years, value="driver", last_year=last_year)
    rows = align.blocked_product(g.select(*keys, "year", "driver"), slopes.select("lat", "slope"), "year")
    return rows.select(*keys, "year", "lat", (F.col("slope") * F.col("driver")).alias("value"))


def injection_drivers(injection: DataFrame, aod_params: DataFrame, climate_params: DataFrame, first_year: int,
                      co2_forcing: DataFrame | None = None, co2_band: str = "co2") -> DataFrame:
    """(variable, band, year, driver): annual response of each variable to the injections of each latitude band.

    Annual amounts are spread over months, turned into optical depth, then into a response per variable; the annual
    mean is taken before any product with patterns (both are linear).  ``co2_forcing`` (k, value) enters the response
    directly, with its own parameters.
    """
    monthly = timeops.monthly_expand(injection).withColumn("k", ((F.col("year") - first_year) * 12 + F.col("month") - 1).cast("int"))
    forcing = signal.convolve_decay(monthly.select("band", "k", "value"), aod_params)
    if co2_forcing is not None:
        forcing = forcing.unionByName(co2_forcing.select(F.lit(co2_band).alias("band"), "k", "value"))
    per_variable = forcing.join(climate_params.select("variable", "band"), "band")
    response = signal.convolve_kernel(per_variable.select("variable", "band", "k", "value"), climate_params, ["variable", "band"])
    annual = timeops.annual_mean_12(response, ["variable", "band"], start_year=first_year)
    return annual.withColumnRenamed("value", "driver")


def add_precipitation_minus_evaporation(terms: DataFrame, value: str | None = None, first: str = "pr", second: str = "e") -> DataFrame:
    """Terms (variable, band, ..) of p-e next to those of pr and e: the bands of both, with ``value`` of e negated."""
    parts = [terms]
    for name, sign in ((first, 1.0), (second, -1.0)):
        own = terms.filter(F.col("variable") == name).withColumns({"variable": F.lit("p-e"), "band": F.concat(F.lit(f"{name}:"), "band")})
        parts.append(own.withColumn(value, F.col(value) * sign) if value else own)
    return reduce(DataFrame.unionByName, parts)


def custom_injection_delta(injection: DataFrame, aod_params: DataFrame, climate_params: DataFrame, patterns: DataFrame,
                           first_year: int, co2_forcing: DataFrame | None = None, co2_band: str = "co2", p_minus_e: bool = False) -> DataFrame:
    """(variable, year, cell_id, value) from annual injections per latitude band; bands add up.

    With ``p_minus_e`` there is also the difference of the responses of pr and e, as bands of opposite sign.
    """
    drivers = injection_drivers(injection, aod_params, climate_params, first_year, co2_forcing, co2_band)
    if p_minus_e:
        drivers, patterns = add_precipitation_minus_evaporation(settle(drivers, "responses")), add_precipitation_minus_evaporation(patterns, "slope")
    scaled = align.outer_scale(patterns, drivers, ["variable", "band"])
    return scaled.groupBy("variable", "year", "cell_id").agg(F.sum("value").alias("value"))


# -- summary -----------------------------------------------------------------------------------

class Summary:
    """Parts of a summary, each built when it is first asked for, so that reading one starts no job of another."""

    def __init__(self, **parts: Callable[[], DataFrame]):
        self._parts = parts

    def _part(self, name: str) -> DataFrame:
        if name not in self._parts:
            raise ValueError(f"the inputs of {name!r} were not given")
        return self._parts[name]()

    @cached_property
    def maps(self) -> DataFrame:
        """(keys, cell_id, mean, delta_mean, inside)"""
        return self._part("maps")

    @cached_property
    def series(self) -> DataFrame:
        """(keys, kind, year, value)"""
        return self._part("series")

    @cached_property
    def histograms(self) -> DataFrame:
        """(keys, kind, bin, lo, hi, frac)"""
        return self._part("histograms")

    @cached_property
    def pvalues(self) -> DataFrame:
        """(keys, cell_id, kind, p_value): without and with intervention, at the decade's end"""
        return self._part("pvalues")

    @cached_property
    def variability(self) -> DataFrame:
        """(variable, value)"""
        return self._part("variability")

    @cached_property
    def gap(self) -> DataFrame:
        """(scenario, target_tenths, year, temp_diff)"""
        return self._part("gap")

    @cached_property
    def injection(self) -> DataFrame:
        """(scenario, target_tenths, start_year, year, lat, value)"""
        return self._part("injection")


def map_summary(maps: DataFrame, delta: DataFrame, decade: tuple[int, int], keys: Sequence[str], region: DataFrame | None = None) -> DataFrame:
    """Decade means of map and delta per cell, with the region mask."""
    mean = maps.filter(F.col("year").between(*decade)).groupBy("variable", "scenario", "cell_id").agg(F.avg("value").alias("mean"))
    dmean = delta.filter(F.col("year").between(*decade)).groupBy(*keys, "cell_id").agg(F.avg("value").alias("delta_mean"))
    out = dmean.join(mean, ["variable", "scenario", "cell_id"])
    if region is None:
        return out.withColumn("inside", F.lit(True))
    marks = region.select("cell_id", F.lit(True).alias("inside")).distinct()
    return out.join(marks, "cell_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def aggregate_series(maps: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area means, or plain sums for exposures, of a multi-variable map table in one group-by."""
    w = F.cos(F.radians("lat"))
    v = F.col("value")
    exposure = variable_flag(F.col("variable"), "is_exposure")
    rows = maps.join(cells.select("cell_id", "lat"), "cell_id")
    out = rows.groupBy(*keys, "year").agg(F.sum(v * w).alias("_vw"), F.sum(F.when(v.isNotNull(), w)).alias("_w"), F.sum(v).alias("_s"))
    return out.withColumn("value", F.when(exposure, F.coalesce("_s", F.lit(0.0))).otherwise(F.try_divide("_vw", "_w"))).drop("_vw", "_w", "_s")


def with_intervention(maps: DataFrame, delta: DataFrame, floor: bool) -> DataFrame:
    """Map plus delta on their shared cells and years; day counts floored at zero when asked."""
    d = delta.withColumnRenamed("value", "_delta")
    out = maps.join(d, ["variable", "scenario", "year", "cell_id"]).withColumn("value", F.col("value") + F.col("_delta")).drop("_delta")
    return floor_counts(out) if floor else out


def series_summary(maps: DataFrame, delta: DataFrame, history: DataFrame | None, cells: DataFrame, start_year: int,
                   keys: Sequence[str], smooth: bool = True, starts: DataFrame | None = None, obs: DataFrame | None = None) -> DataFrame:
    """Series of history, without and with intervention: (keys, kind, year, value)."""
    without = aggregate_series(maps, cells, ["variable", "scenario"])
    with_ = aggregate_series(with_intervention(maps.filter(F.col("year") >= start_year), delta, floor=True), cells, keys)
    past = aggregate_series(history, cells, ["variable"]) if history is not None else None
    return compose_series(without, with_, past, delta.select(*keys).distinct(), start_year, keys, smooth, starts, obs)


def compose_series(without: DataFrame, with_: DataFrame, past: DataFrame | None, labels: DataFrame, start_year: int, keys: Sequence[str],
                   smooth: bool = True, starts: DataFrame | None = None, obs: DataFrame | None = None, splice_at: int | None = None) -> DataFrame:
    """(keys, kind, year, value) from area series without (variable, scenario) and with intervention (keys).

    History (``past``, by variable) and projection are smoothed as one series and cut again; before its first injection
    the intervention follows the series without it: from ``splice_at``, ``starts`` or the start year.
    """
    base = ["variable", "scenario"]
    if past is not None:
        past = align.blocked_product(past, without.select("scenario").distinct(), "year").select(*without.columns)
        without = align.join_series(past, without)
    full = signal.smooth_lowpass(without, base) if smooth else without
    full = settle(full.select(*base, "year", "value"), "series")
    before, after = align.split_series(full, start_year - 1)
    extra = [k for k in keys if k not in base]
    spread = lambda d: d.join(labels, base).select(*keys, "year", "value")
    before, after = spread(before), spread(after)
    at = splice_at if splice_at is not None else start_year if starts is None else None
    with_ = align.splice_before(with_.select(*keys, "year", "value"), after, keys, at, starts if splice_at is None else None)
    out = align.stack_dim({"historical_model": before, "no_sai": after, "with_sai": with_}, "kind")
    if obs is not None:
        tas = labels.filter(F.col("variable") == "tas")
        seen = align.blocked_product(obs.select("year", "value"), tas, "year")
        out = out.unionByName(seen.withColumn("kind", F.lit("historical_obs")).select(*out.columns))
    return out.select(*base, *extra, "kind", "year", "value")


def histogram_summary(maps: DataFrame, delta: DataFrame, history: DataFrame | None, decade: tuple[int, int], keys: Sequence[str],
                      history_window: tuple[int, int] = (1950, 1960)) -> DataFrame:
    """Distributions over cells and years of a decade: equal bins, or fixed edges for day counts."""
    now = maps.filter(F.col("year").between(*decade))
    past = history.filter(F.col("year").between(*history_window)) if history is not None else None
    return compose_histograms(now, with_intervention(now, delta, floor=False), past, delta.select(*keys).distinct(), keys)


def compose_histograms(without: DataFrame, with_: DataFrame, past: DataFrame | None, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms (keys, kind, bin, lo, hi, frac) of values without, with intervention and of the past."""
    labels = settle(labels, "labels")
    count = variable_flag(F.col("variable"), "is_count")

    def bins(rows: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
        rows = rows.select(*by, "value")
        both = stats.histogram_equal(rows.filter(~count), by).unionByName(stats.histogram_edges(rows.filter(count & (F.col("value") > 0)), by))
        missing = [k for k in keys if k not in by]
        # values without a target are binned once, and the bins get the targets
        named = both.join(labels, list(by)) if missing else both
        return named.select(*keys, F.lit(kind).alias("kind"), "bin", "lo", "hi", "frac")

    out = bins(without, ["variable", "scenario"], "no_sai").unionByName(bins(with_, keys, "with_sai"))
    return out.unionByName(bins(past, ["variable"], "historical")) if past is not None else out


def scenario_summary(maps: DataFrame, delta: DataFrame, history: DataFrame | None, cells: DataFrame, start_year: int,
                     decade: tuple[int, int], region: DataFrame | None = None, starts: DataFrame | None = None,
                     obs: DataFrame | None = None, smooth: bool = True, history_window: tuple[int, int] = (1950, 1960),
                     tests: dict | None = None, natural: DataFrame | None = None, population: DataFrame | None = None,
                     gap: DataFrame | None = None, injection_slopes: DataFrame | None = None, injection: dict | None = None) -> Summary:
    """Maps, series, histograms and more of one or many scenarios and targets.

    ``maps`` and ``history`` are already rebased; with ``region`` series, histograms and variability use its cells only.
    ``tests`` has what the p-values need: baseline, variability, land, decades (arguments of the decadal means) and
    decade_end.  ``natural`` (with ``population``), ``gap`` and ``injection_slopes`` (with ``injection``, arguments of
    ``injection_by_latitude``) are for the other parts.
    """
    keys = [c for c in delta.columns if c not in ("year", "cell_id", "value")]
    cut = (lambda d: d) if region is None else (lambda d: spatial.clip_to_land(d, region))
    past = cut(history) if history is not None else None
    parts = {
        "maps": lambda: map_summary(maps, delta, decade, keys, region),
        "series": lambda: series_summary(cut(maps), cut(delta), past, cells, start_year, keys, smooth, starts, obs),
        "histograms": lambda: histogram_summary(cut(maps), cut(delta), past, decade, keys, history_window)}
    if tests is not None:
        parts["pvalues"] = lambda: decade_end_pvalues(maps, delta, keys, **tests)
    if natural is not None:
        names = lambda: [r["variable"] for r in maps.select("variable").distinct().collect()]
        parts["variability"] = lambda: variability_summary(natural, names(), population, region)
    if gap is not None:
        parts["gap"] = lambda: gap
        if injection_slopes is not None:
            parts["injection"] = lambda: injection_by_latitude(injection_slopes, gap, **injection or {})
    return Summary(**parts)


def decade_end_pvalues(maps: DataFrame, delta: DataFrame, keys: Sequence[str], baseline: DataFrame, variability: DataFrame, land: DataFrame,
                       decades: dict, decade_end: int) -> DataFrame:
    """p-values per cell of one decade, without and with intervention (kind), for all ``keys``."""
    end = lambda d: d.filter(F.col("decade_end") == decade_end).drop("decade_end")
    without = end(pvalue_maps(maps, baseline, variability, land, **decades)).join(delta.select(*keys).distinct(), ["variable", "scenario"])
    with_ = end(pvalue_maps(with_intervention(maps, delta, floor=False), baseline, variability, land, keys=keys, **decades))
    return align.stack_dim({"no_sai": without.select(*keys, "cell_id", "p_value"), "with_sai": with_.select(*keys, "cell_id", "p_value")}, "kind")


def variability_summary(natural: DataFrame, variables: Sequence[str], population: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """(variable, value): scalar variability, times persons of the region (or all) for exposures."""
    rows = expand_variables(natural, variables)
    people = stats.population_variability(rows, population, region)
    pick = variable_flag(F.col("variable"), "is_exposure")
    return rows.filter(~pick).unionByName(people.filter(pick).select(*rows.columns))


# -- sweep -------------------------------------------------------------------------------------

SWEPT = ("maps", "pvalues", "delta", "delta_pvalues", "injection")


def sweep_all(spark: SparkSession, path: str, work: DataFrame, coef: DataFrame, series: DataFrame, slopes: DataFrame,
              injection_slopes: DataFrame | None, annual: DataFrame, variability: DataFrame, cells: DataFrame, land: DataFrame,
              population: DataFrame, variables: Sequence[str] = tuple(SWEEP_VARIABLES), target_tenths: tuple[int, int] | Sequence[int] = TARGET_TENTHS,
              start_years: tuple[int, int] = (FIRST_START_YEAR, LAST_START_YEAR),
              canvas_start: int = CANVAS_START_YEAR, first_year: int = FIRST_PROJECTED_YEAR, last_historical: int = LAST_HISTORICAL_YEAR,
              base_window: tuple[int, int] = PREINDUSTRIAL, decades: dict | None = None, ignore_existing: bool = False,
              model: str | None = None, last_year: int = align.LAST_YEAR, products: Sequence[str] = SWEPT, batch_rows: int = BATCH_ROWS) -> dict[str, bool]:
    """Write every product of scenarios x variables x targets that is not there yet.

    One plan covers many missing keys, so the sweep is partition parallelism, not a loop; keys go in batches of about
    ``batch_rows`` estimated rows, each committed to the product's ledger, and a stopped sweep goes on behind the last
    one.  Written maps feed the p-values.  The gap comes from the fits of ``tas``, whether or not it is swept; without
    them or its baseline the sweep is an error.  Ramp-up is left out of the cached deltas.
    """
    unknown = set(products) - set(SWEPT)
    if unknown:
        raise ValueError(f"unknown products {sorted(unknown)}")
    history = historical_map(annual, list(dict.fromkeys([*variables, "tas"])), land, population, last_historical)
    base = settle(baseline_map(history, base_window), "baseline")
    years, n_cells, n_decades = last_year - first_year + 1, cells.count(), (decades or {}).get("decades", 6)
    done = {}

    def write(name: str, todo: DataFrame, keys: Sequence[str], rows: int, build: Callable[[DataFrame], DataFrame]) -> None:
        done[name] = write_missing(spark, todo, f"{path}/{name}", keys, build, ignore_existing, F.lit(rows), batch_rows)

    singles, pair = work.select("scenario", "variable").distinct(), ["variable", "scenario"]
    if "maps" in products or {"pvalues", "delta_pvalues"} & set(products):
        write("maps", singles, pair, n_cells * years, lambda todo: predict_map(coef, series, variables, land, population, base, first_year, model=model, pairs=todo))
        maps = read_labels(spark, f"{path}/maps", pair)
    if "pvalues" in products:
        write("pvalues", singles, pair, n_cells * n_decades,
              lambda todo: pvalue_maps(maps.join(todo, ["scenario", "variable"], "left_semi"), base, variability, land, **decades or {}))
    if not {"delta", "delta_pvalues", "injection"} & set(products):
        return done
    gap = settle(pattern_gap(coef, series, cells, target_tenths, base, model, first_year), "gap")
    keys = ["variable", "scenario", "target_tenths"]
    targets = work.select(*keys).distinct()

    def deltas_for(todo: DataFrame) -> DataFrame:
        wanted = gap.join(todo.select("scenario", "target_tenths").distinct(), ["scenario", "target_tenths"], "left_semi")
        return regional_delta(slopes, wanted, variables, land, population, canvas_start, 0, todo)

    if "delta" in products:
        write("delta", targets, keys, n_cells * years, deltas_for)
    if "delta_pvalues" in products:
        write("delta_pvalues", targets, keys, n_cells * n_decades, lambda todo: decade_pvalues(
            delta_decades(maps, slopes, gap, variables, land, population, todo, canvas_start, 0, **decades or {}), base, variability, land, keys=keys))
    if "injection" in products and injection_slopes is not None:
        both = ["scenario", "target_tenths"]
        write("injection", work.select(*both).distinct(), both, injection_slopes.count() * years * (start_years[1] - start_years[0] + 1),
              lambda todo: injection_by_latitude(injection_slopes, gap.join(todo, both, "left_semi"), start_years, last_year=last_year))
    return done
