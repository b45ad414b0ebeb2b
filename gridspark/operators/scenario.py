"""Scenario tables, parameter ensembles and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.align import blocked_product
from gridspark.operators.stats import exact_median
from gridspark.operators.timeops import interpolate_gaps, resample_axis
from gridspark.schema import literal_map, literal_table, sql_literal
from gridspark.scratch import settle

# Climate parameters of the calibrated model.
CALIBRATION = {
    "clim_c1": 4.830712,
    "clim_c2": 6.397801,
    "clim_c3": 71.294445,
    "clim_kappa1": 0.649448,
    "clim_kappa2": 3.876076,
    "clim_kappa3": 0.900808,
    "clim_epsilon": 1.678583,
    "clim_gamma": 2.796757,
    "clim_sigma_eta": 0.713515,
    "clim_sigma_xi": 0.491656,
    "clim_F_4xCO2": 8.175245,
}

# Greenhouse gases that share one forcing scale.
MINOR_GASES = [
    "CFC-11", "CFC-12", "CFC-113", "CFC-114", "CFC-115", "HCFC-22", "HCFC-141b", "HCFC-142b",
    "CCl4", "CHCl3", "CH2Cl2", "CH3Cl", "CH3CCl3", "CH3Br", "Halon-1211", "Halon-1301", "Halon-2402",
    "CF4", "C2F6", "C3F8", "c-C4F8", "C4F10", "C5F12", "C6F14", "C7F16", "C8F18", "NF3", "SF6", "SO2F2",
    "HFC-125", "HFC-134a", "HFC-143a", "HFC-152a", "HFC-227ea", "HFC-23", "HFC-236fa", "HFC-245fa",
    "HFC-32", "HFC-365mfc", "HFC-4310mee",
]
EESC = "Equivalent effective stratospheric chlorine"

# Ensemble column -> (species parameter, species); None stands for every species.
PARAMETER_COLUMNS: dict[str, list[tuple[str, str | None]]] = {
    "cc_r0": [("iirf_0", "CO2")],
    "cc_rA": [("iirf_airborne", "CO2")],
    "cc_rU": [("iirf_uptake", "CO2")],
    "cc_rT": [("iirf_temperature", "CO2")],
    "cc_co2_concentration_1750": [("baseline_concentration", "CO2")],
    "aci_beta": [("aci_scale", None)],
    "aci_shape_so2": [("aci_shape", "Sulfur")],
    "aci_shape_bc": [("aci_shape", "BC")],
    "aci_shape_oc": [("aci_shape", "OC")],
    **{f"ari_{s}": [("erfari_radiative_efficiency", s)]
       for s in ["BC", "CH4", "N2O", "NH3", "NOx", "OC", "Sulfur", "VOC", EESC]},
    **{f"fscale_{s}": [("forcing_scale", s)]
       for s in ["CO2", "CH4", "N2O", "Stratospheric water vapour", "Contrails",
                 "Light absorbing particles on snow and ice", "Land use"]},
    "fscale_minorGHG": [("forcing_scale", s) for s in MINOR_GASES],
    **{f"o3_{s}": [("ozone_radiative_efficiency", s)] for s in ["CH4", "N2O", EESC, "CO", "VOC", "NOx"]},
}

# Species whose name in the scenario files is not its own name without hyphens.
SCENARIO_NAMES = {
    "CO2 FFI": "CO2|MAGICC Fossil and Industrial",
    "CO2 AFOLU": "CO2|MAGICC AFOLU",
    "NOx aviation": "NOx|MAGICC Fossil and Industrial|Aircraft",
    "Aerosol-radiation interactions": "Aerosols-radiation interactions",
    "Aerosol-cloud interactions": "Aerosols-radiation interactions",
    "Contrails": "Contrails and Contrail-induced Cirrus",
    "Light absorbing particles on snow and ice": "BC on Snow",
    "Stratospheric water vapour": "CH4 Oxidation Stratospheric H2O",
    "Land use": "Albedo Change",
}

# Nitrogen oxide sectors; burning is reported as NO and counted as NO2.
BURNING_SECTORS = [
    "Emissions|NOx|MAGICC AFOLU|Agricultural Waste Burning",
    "Emissions|NOx|MAGICC AFOLU|Forest Burning",
    "Emissions|NOx|MAGICC AFOLU|Grassland Burning",
    "Emissions|NOx|MAGICC AFOLU|Peat Burning",
]
OTHER_SECTORS = ["Emissions|NOx|MAGICC AFOLU|Agriculture", "Emissions|NOx|MAGICC Fossil and Industrial"]
NO2_PER_NO = 46.006 / 30.006

# Forcing per injected amount.
FORCING_PER_TG = -0.28

# Units. Grams per mass prefix, seconds per time unit, parts per mixing-ratio unit.
SECONDS_PER_YEAR = 60 * 60 * 24 * 365.24219
MASS_GRAMS = {"Gt": 1e15, "Tg": 1e12, "Mt": 1e12, "kt": 1e9, "t": 1e6, "kg": 1e3, "g": 1.0}
TIME_SECONDS = {"yr": SECONDS_PER_YEAR, "day": 86400.0, "s": 1.0}
MIXING_PARTS = {"ppm": 1e6, "ppb": 1e3, "ppt": 1.0}
EXTRA_WEIGHTS = {"C": 12.011, "NO2": 46.006, "NO": 30.006, "N": 14.007, "N2": 28.014, "SO2": 64.069, "S": 32.07}

# Species whose wanted emissions unit is not "kt <name without hyphens>/yr".
EMISSION_UNITS = {
    "CO2 FFI": "Gt CO2/yr",
    "CO2 AFOLU": "Gt CO2/yr",
    "CO2": "Gt CO2/yr",
    "CH4": "Mt CH4/yr",
    "N2O": "Mt N2O/yr",
    "Sulfur": "Mt SO2/yr",
    "BC": "Mt BC/yr",
    "OC": "Mt OC/yr",
    "NH3": "Mt NH3/yr",
    "NOx": "Mt NO2/yr",
    "NOx aviation": "Mt NO2/yr",
    "VOC": "Mt VOC/yr",
    "CO": "Mt CO/yr",
}
# Species whose wanted mixing ratio is not ppt.
MIXING_UNITS = {"CO2": "ppm", "CH4": "ppb", "N2O": "ppb"}

# Valid input modes per species type, and the types that may occur more than once.
INPUT_MODES = {
    "co2 ffi": ["emissions"],
    "co2 afolu": ["emissions"],
    "co2": ["emissions", "calculated", "concentration", "forcing"],
    "ch4": ["emissions", "concentration", "forcing"],
    "n2o": ["emissions", "concentration", "forcing"],
    "cfc-11": ["emissions", "concentration", "forcing"],
    "other halogen": ["emissions", "concentration", "forcing"],
    "f-gas": ["emissions", "concentration", "forcing"],
    "sulfur": ["emissions"],
    "black carbon": ["emissions"],
    "organic carbon": ["emissions"],
    "other slcf": ["emissions"],
    "nox aviation": ["emissions"],
    "eesc": ["concentration", "calculated"],
    "ozone": ["calculated", "forcing"],
    "ari": ["calculated", "forcing"],
    "aci": ["calculated", "forcing"],
    "contrails": ["calculated", "forcing"],
    "lapsi": ["calculated", "forcing"],
    "h2o stratospheric": ["calculated", "forcing"],
    "land use": ["calculated", "forcing"],
    "volcanic": ["forcing"],
    "solar": ["forcing"],
    "unspecified": ["forcing"],
}
REPEATABLE_TYPES = ["other halogen", "f-gas", "other slcf", "unspecified"]


# -- rows and configs --------------------------------------------------------------------------

def filter_scenario_rows(df: DataFrame, scenario: str | None = None, region: str = "World",
                         suffix: str | None = None, variables: Sequence[str] | None = None) -> DataFrame:
    df = df.filter(F.col("region") == region)
    if scenario is not None:
        df = df.filter(F.col("scenario") == scenario)
    if suffix is not None:
        df = df.filter(F.col("variable").endswith("|" + suffix))
    if variables is not None:
        df = df.filter(F.col("variable").isin(list(variables)))
    return df


def unpivot_years(df: DataFrame, keys: Sequence[str], prefix: str = "", t: str = "t", value: str = "value") -> DataFrame:
    """One column per year to (t, value) rows."""
    years = [c for c in df.columns if c not in keys and c[len(prefix):].isdigit() and c.startswith(prefix)]
    long = df.unpivot(list(keys), years, t, value)
    return long.withColumn(t, F.substring(F.col(t), len(prefix) + 1, 8).cast("int"))


def calibrate_configs(configs: DataFrame, constants: dict[str, float] = CALIBRATION) -> DataFrame:
    """Overwrite the given parameters of every config with constants."""
    return configs.withColumns({c: F.lit(v) for c, v in constants.items()})


def sample_configs(configs: DataFrame, n: int, seed: int = 42, key: str = "config") -> DataFrame:
    """A fixed-size sample that depends only on the seed and the config labels."""
    return configs.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def config_median(configs: DataFrame, params: Sequence[str], key: str = "config") -> DataFrame:
    """Median of every parameter over the configs: (param, value)."""
    return exact_median(configs.unpivot([key], list(params), "param", "value"), ["param"])


def parameter_overrides(configs: DataFrame, rules: dict[str, list[tuple[str, str | None]]] = PARAMETER_COLUMNS,
                        key: str = "config") -> DataFrame:
    """(config, specie, param, value) from the ensemble's columns; specie is NULL for all-species parameters."""
    columns = [c for c in configs.columns if c in rules]
    targets = literal_map_of_structs({c: rules[c] for c in columns})
    long = configs.unpivot([key], columns, "column", "value")
    return long.select(key, F.inline(targets[F.col("column")]), "value")


def literal_map_of_structs(mapping: dict[str, list[tuple[str, str | None]]]) -> Column:
    def rows(pairs):
        return ", ".join(f"named_struct('param', {sql_literal(p)}, 'specie', cast({sql_literal(s)} as string))" for p, s in pairs)

    return F.expr("map(" + ", ".join(f"{sql_literal(name)}, array({rows(pairs)})" for name, pairs in mapping.items()) + ")")


def attach_species_params(df: DataFrame, species: DataFrame, overrides: DataFrame, params: Sequence[str],
                          key: str = "config") -> DataFrame:
    """Add species properties to rows with (config, specie), overridden where the config sets its own."""
    wide = overrides.filter(F.col("specie").isNotNull()).groupBy(key, "specie") \
        .pivot("param", list(params)).agg(F.max("value"))
    shared = overrides.filter(F.col("specie").isNull()).groupBy(key).pivot("param", list(params)).agg(F.max("value"))
    wide = wide.withColumnsRenamed({p: f"_o_{p}" for p in params})
    shared = shared.withColumnsRenamed({p: f"_s_{p}" for p in params})
    out = df.join(species.select("specie", *params), "specie", "left") \
        .join(wide, [key, "specie"], "left").join(shared, key, "left")
    return out.withColumns({p: F.coalesce(f"_o_{p}", f"_s_{p}", p) for p in params}) \
        .drop(*[f"_o_{p}" for p in params], *[f"_s_{p}" for p in params])


def scale_forcing_by_config(natural: DataFrame, configs: DataFrame, t: str = "t", trend_start: float = 1750,
                            trend_years: float = 270, key: str = "config") -> DataFrame:
    """Volcanic and solar forcing of each config: amplitude, plus a linear trend up to 1 for solar.

    Further columns of ``natural``, such as a scenario, stay.
    """
    more = [c for c in natural.columns if c not in (t, "volcanic", "solar")]
    scales = configs.select(key, "fscale_volcanic", "fscale_solar_amplitude", "fscale_solar_trend")
    rows = blocked_product(natural, scales, t)
    ramp = F.least((F.col(t) - trend_start) / F.lit(float(trend_years)), F.lit(1.0))
    return rows.select(key, *more, t, (F.col("volcanic") * F.col("fscale_volcanic")).alias("volcanic"),
                       (F.col("solar") * F.col("fscale_solar_amplitude") + ramp * F.col("fscale_solar_trend")).alias("solar"))


def sector_sum(df: DataFrame, scaled: Sequence[str] = tuple(BURNING_SECTORS), plain: Sequence[str] = tuple(OTHER_SECTORS),
               factor: float = NO2_PER_NO, keys: Sequence[str] = ("scenario", "t"), value: str = "value") -> DataFrame:
    """Sum of the burning sectors, rescaled, plus the other sectors as they are; missing propagates."""
    v = F.when(F.col("variable").isin(list(scaled)), F.col(value) * factor).otherwise(F.col(value))
    used = df.filter(F.col("variable").isin([*scaled, *plain]))
    total = F.when(F.count_if(v.isNull()) == 0, F.sum(v))
    return used.groupBy(*keys).agg(total.alias(value))


# -- units and tidying -------------------------------------------------------------------------

def emission_unit(specie: Column) -> Column:
    return F.coalesce(literal_map(EMISSION_UNITS)[specie], F.concat(F.lit("kt "), F.replace(specie, F.lit("-"), F.lit("")), F.lit("/yr")))


def mixing_unit(specie: Column) -> Column:
    return F.coalesce(literal_map(MIXING_UNITS)[specie], F.lit("ppt"))


def molecular_weights(species: DataFrame) -> DataFrame:
    """(compound, weight) of the species table plus the plain elements and oxides."""
    own = species.filter(F.col("molecular_weight").isNotNull()) \
        .select(F.replace("specie", F.lit("-"), F.lit("")).alias("compound"), F.col("molecular_weight").alias("weight"))
    extra = literal_table(species.sparkSession, list(EXTRA_WEIGHTS.items()), ["compound", "weight"])
    return own.join(extra, "compound", "left_anti").unionByName(extra)


def convert_units(df: DataFrame, weights: DataFrame, unit: str = "unit", target: str = "target_unit",
                  value: str = "value") -> DataFrame:
    """Convert ``prefix compound/time`` or mixing-ratio units row by row.

    A unit that cannot be converted gives NULL and ``unit_error`` = true.
    """
    def piece(column: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(F.col(column), r"^(\S+)\s+([^/\s]+)/(\S+)$", group), F.lit(""))

    rows = df.withColumns({f"_{side}{i}": piece(col, i) for side, col in (("f", unit), ("t", target)) for i in (1, 2, 3)})
    for side in ("f", "t"):
        rows = rows.join(weights.select(F.col("compound").alias(f"_{side}2"), F.col("weight").alias(f"_w{side}")), f"_{side}2", "left")
    mass, time, mixing = literal_map(MASS_GRAMS), literal_map(TIME_SECONDS), literal_map(MIXING_PARTS)
    compound = F.when(F.col("_f2") == F.col("_t2"), F.lit(1.0)).otherwise(F.col("_wt") / F.col("_wf"))
    emission = (mass[F.col("_f1")] / mass[F.col("_t1")]) * compound * (time[F.col("_t3")] / time[F.col("_f3")])
    ratio = mixing[F.col(unit)] / mixing[F.col(target)]
    rows = rows.withColumn("_factor", F.coalesce(ratio, emission))
    return rows.withColumns({value: F.col(value) * F.col("_factor"), "unit_error": F.col("_factor").isNull()}) \
        .drop("_factor", "_wf", "_wt", *[f"_{s}{i}" for s in "ft" for i in (1, 2, 3)])


def scenario_names(species: DataFrame, renamed: dict[str, str] = SCENARIO_NAMES) -> DataFrame:
    """(specie, alias): the name each species goes by in the scenario files."""
    own = F.replace("specie", F.lit("-"), F.lit(""))
    return species.select("specie", F.coalesce(literal_map(renamed)[F.col("specie")], own).alias("alias"))


def match_species(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose variable ends in ``|alias`` of a species.

    Every tail of the variable after a bar is tried, so the suffix match is an equi-join.
    """
    parts = F.split("variable", r"\|")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "|"))
    tried = df.withColumn("_parts", F.size(parts)).filter(F.col("_parts") >= 2).withColumn("alias", F.explode(tails))
    return tried.join(names, "alias").drop("_parts", "alias")


def tidy_scenarios(wide: DataFrame, species: DataFrame, kind: str, start: float, end: float, step: float = 1.0,
                   region: str = "World", prefix: str = "", renamed: dict[str, str] = SCENARIO_NAMES,
                   targets: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Wide scenario table to (scenario, specie, t, value, unit_error) on the wanted axis and units.

    ``kind`` is the input mode (emissions, concentration or forcing).  Values stand for mid-year; gaps
    are filled, the axis is interpolated with open ends, and points outside the tables' span are NULL.
    """
    first = {"emissions": 1750, "concentration": 1700, "forcing": 1750}[kind]
    rows = match_species(filter_scenario_rows(wide, region=region), scenario_names(species, renamed))
    keys = ["scenario", "specie", "unit"]
    years = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    long = unpivot_years(rows.select(*keys, *years), keys, prefix)
    filled = settle(interpolate_gaps(long, keys).withColumn("t", F.col("t") + 0.5), "filled")
    axis = resample_axis(filled, keys, start, end, step, valid=(first, 2501))
    if kind == "forcing":
        return axis.drop("unit").withColumn("unit_error", F.lit(False))
    wanted = targets if targets is not None else (emission_unit if kind == "emissions" else mixing_unit)(F.col("specie"))
    weights = weights if weights is not None else molecular_weights(species)
    return convert_units(axis.withColumn("target_unit", wanted), weights).drop("unit", "target_unit")


def missing_species(tidy: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scenario, specie) that the scenario files do not have; callers raise when it is not empty."""
    return wanted.join(tidy.select("scenario", "specie").distinct(), ["scenario", "specie"], "left_anti")


# -- checks ------------------------------------------------------------------------------------

def check_species(species: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Rule violations of a species table: (rule, subject, detail)."""
    modes = F.expr("map(" + ", ".join(f"{sql_literal(t)}, array({', '.join(map(sql_literal, m))})" for t, m in INPUT_MODES.items()) + ")")
    allowed = modes[F.col("type")]
    bad_type = species.filter(allowed.isNull()).select(F.lit("type").alias("rule"), F.col("specie").alias("subject"), F.col("type").alias("detail"))
    bad_mode = species.filter(allowed.isNotNull() & ~F.array_contains(allowed, F.col("input_mode"))) \
        .select(F.lit("input_mode").alias("rule"), F.col("specie").alias("subject"), F.col("input_mode").alias("detail"))
    repeats = species.filter(~F.col("type").isin(REPEATABLE_TYPES)).groupBy("type").agg(F.count("*").alias("n")) \
        .filter("n > 1").select(F.lit("repeated").alias("rule"), F.col("type").alias("subject"), F.col("n").cast("string").alias("detail"))
    out = bad_type.unionByName(bad_mode).unionByName(repeats)
    if requested is not None:
        unknown = requested.join(species.select("specie"), "specie", "left_anti") \
            .select(F.lit("properties").alias("rule"), F.col("specie").alias("subject"), F.lit("missing").alias("detail"))
        out = out.unionByName(unknown)
    return out


def check_no_missing(series: DataFrame, keys: Sequence[str] = ("specie", "mode"), value: str = "value") -> DataFrame:
    """Driving series that have missing values."""
    return series.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("n_missing")).filter("n_missing > 0")


def check_dependencies(species: DataFrame, ghg_method: str = "meinshausen2020", ch4_method: str = "thornhill2021",
                       groups: Sequence[str] = ()) -> DataFrame:
    """Broken cross-species rules, one row each, from one conditional aggregate over the species."""
    def has(kind: str, *modes: str) -> Column:
        return F.coalesce(F.max((F.col("type") == kind) & F.col("input_mode").isin(list(modes))), F.lit(False))

    flags = species.groupBy(*groups).agg(
        has("co2", "calculated").alias("co2_calc"), has("co2 ffi", "emissions").alias("ffi"),
        has("co2 afolu", "emissions").alias("afolu"), has("land use", "calculated").alias("land_calc"),
        has("eesc", "concentration").alias("eesc_conc"), has("eesc", "calculated").alias("eesc_calc"),
        has("cfc-11", "emissions", "concentration").alias("cfc11"),
        has("co2", "calculated", "emissions", "concentration").cast("int").alias("co2"),
        has("ch4", "emissions", "concentration").cast("int").alias("ch4"),
        has("n2o", "emissions", "concentration").cast("int").alias("n2o"))
    c = F.col
    rules = {
        "co2_sources": c("co2_calc") & ~(c("ffi") & c("afolu")),
        "land_use_source": c("land_calc") & ~c("afolu"),
    }
    if ch4_method == "thornhill2021":
        rules["eesc_source"] = ~c("eesc_conc") & c("eesc_calc") & ~c("cfc11")
    if ghg_method in ("meinshausen2020", "etminan2016"):
        rules["main_gases"] = (c("co2") + c("ch4") + c("n2o")).isin(1, 2)
    elif ghg_method == "myhre1998":
        rules["main_gases"] = (c("ch4") + c("n2o")) == 1
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return flags.select(*groups, F.explode(broken).alias("rule"))


def check_inputs(available: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required key combinations for which there is no data."""
    return required.select(*keys).distinct().join(available.select(*keys).distinct(), list(keys), "left_anti")


def require(violations: DataFrame, message: str) -> None:
    """Raise when a check found anything, naming a few of the rows."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")
