"""Closed-form forcing diagnostics over scenario tables.

Rows are (scenario, config, specie, t, ...) joined to species parameters.  ``scale`` is always the
effective one: forcing_scale * (1 + tropospheric_adjustment).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import _c
from gridspark.operators.scenario import SECONDS_PER_YEAR
from gridspark.operators.timeops import cumulative

# Published coefficients of the greenhouse gas formulas.
MEINSHAUSEN2020 = dict(a1=-2.4785e-07, b1=0.00075906, c1=-0.0021492, d1=5.2488,
                       a2=-0.00034197, b2=0.00025455, c2=-0.00024357, d2=0.12173,
                       a3=-8.9603e-05, b3=-0.00012462, d3=0.045194)
ETMINAN2016 = dict(a1=-2.4e-7, b1=7.2e-4, c1=-2.1e-4, d1=5.36,
                   a2=-8e-6, b2=4.2e-6, c2=-4.9e-6, d2=0.117,
                   a3=-1.3e-6, b3=-8.2e-6, d3=0.043)
MYHRE1998 = dict(alpha_co2=5.35, alpha_ch4=0.036, alpha_n2o=0.12, alpha_overlap=0.47,
                 a1=2.01e-5, exp1=0.75, a2=5.32e-15, exp2=1.52)
LEACH2021 = dict(f1_co2=4.57, f3_co2=0.086, f3_ch4=0.038, f3_n2o=0.106)

# Properties of the Earth.
AIR_WEIGHT = 28.97
EARTH_RADIUS = 6371000.0
ATMOSPHERE_MASS = 5.1352e18
BROMINE_PER_CHLORINE = 45.0

MAIN_GASES = ("CO2", "CH4", "N2O")


def effective_scale(scale: Column | str = "forcing_scale", adjustment: Column | str = "tropospheric_adjustment") -> Column:
    return _c(scale) * (1 + _c(adjustment))


# -- greenhouse gases --------------------------------------------------------------------------

def _meinshausen2020(co2, ch4, n2o, co2_0, ch4_0, n2o_0):
    k = MEINSHAUSEN2020
    over = co2 - co2_0
    peak = -k["b1"] / (2 * k["a1"])
    alpha = F.when(over <= 0, F.lit(k["d1"])) \
        .when(over > peak, F.lit(k["d1"] - k["b1"] ** 2 / (4 * k["a1"]))) \
        .otherwise(k["d1"] + k["a1"] * over * over + k["b1"] * over)
    rc, rm, rn = F.sqrt(co2), F.sqrt(ch4), F.sqrt(n2o)
    return ((alpha + k["c1"] * rn) * F.ln(co2 / co2_0),
            (k["a3"] * rm + k["b3"] * rn + k["d3"]) * (rm - F.sqrt(ch4_0)),
            (k["a2"] * rc + k["b2"] * rn + k["c2"] * rm + k["d2"]) * (rn - F.sqrt(n2o_0)))


def _etminan2016(co2, ch4, n2o, co2_0, ch4_0, n2o_0):
    k = ETMINAN2016
    mc, mm, mn = (co2 + co2_0) / 2, (ch4 + ch4_0) / 2, (n2o + n2o_0) / 2
    over = co2 - co2_0
    return ((k["a1"] * over * over + k["b1"] * F.abs(over) + k["c1"] * mn + k["d1"]) * F.ln(co2 / co2_0),
            (k["a3"] * mm + k["b3"] * mn + k["d3"]) * (F.sqrt(ch4) - F.sqrt(ch4_0)),
            (k["a2"] * mc + k["b2"] * mn + k["c2"] * mm + k["d2"]) * (F.sqrt(n2o) - F.sqrt(n2o_0)))


def _myhre1998(co2, ch4, n2o, co2_0, ch4_0, n2o_0):
    k = MYHRE1998

    def overlap(m, n):
        return k["alpha_overlap"] * F.ln(1 + k["a1"] * F.pow(m * n, F.lit(k["exp1"])) + k["a2"] * m * F.pow(m * n, F.lit(k["exp2"])))

    return (k["alpha_co2"] * F.ln(co2 / co2_0),
            k["alpha_ch4"] * (F.sqrt(ch4) - F.sqrt(ch4_0)) - (overlap(ch4, n2o_0) - overlap(ch4_0, n2o_0)),
            k["alpha_n2o"] * (F.sqrt(n2o) - F.sqrt(n2o_0)) - (overlap(ch4_0, n2o) - overlap(ch4_0, n2o_0)))


def _leach2021(co2, ch4, n2o, co2_0, ch4_0, n2o_0):
    k = LEACH2021
    return (k["f1_co2"] * F.ln(co2 / co2_0) + k["f3_co2"] * (F.sqrt(co2) - F.sqrt(co2_0)),
            k["f3_ch4"] * (F.sqrt(ch4) - F.sqrt(ch4_0)),
            k["f3_n2o"] * (F.sqrt(n2o) - F.sqrt(n2o_0)))


GHG_METHODS = {"meinshausen2020": _meinshausen2020, "etminan2016": _etminan2016,
               "myhre1998": _myhre1998, "leach2021": _leach2021}


def main_gas_forcing(method: str, gases: Sequence[Column], base: Sequence[Column]) -> tuple[Column, Column, Column]:
    """CO2, CH4 and N2O forcing (unscaled) from concentrations in ppm, ppb, ppb and their reference."""
    if method not in GHG_METHODS:
        raise ValueError(f"unknown method {method!r}")
    return GHG_METHODS[method](*gases, *base)


def ghg_forcing(df: DataFrame, method: str = "meinshausen2020", keys: Sequence[str] = ("scenario", "config", "t"),
                specie: str = "specie") -> DataFrame:
    """Forcing of every greenhouse gas: (keys, specie, forcing).

    ``df`` has concentration, reference_concentration, scale and efficiency per row, and
    baseline_concentration for meinshausen2020, whose forcing is relative to the same formula at the
    baseline.  The three main gases of a step are brought onto one row by conditional aggregation and
    handed back; the other gases are linear and stay where they are.
    """
    cols = ["concentration", "reference_concentration", "scale"]
    offset = method == "meinshausen2020"
    if offset:
        cols.append("baseline_concentration")
    main = df.filter(F.col(specie).isin(list(MAIN_GASES)))
    wide = main.groupBy(*keys).agg(
        *[F.max(F.when(F.col(specie) == g, F.col(c))).alias(f"{c}_{g}") for g in MAIN_GASES for c in cols],
        *[F.max(F.col(specie) == g).alias(f"_is_{g}") for g in MAIN_GASES])
    pick = lambda c: [F.col(f"{c}_{g}") for g in MAIN_GASES]
    now = main_gas_forcing(method, pick("concentration"), pick("reference_concentration"))
    if offset:
        base = main_gas_forcing(method, pick("baseline_concentration"), pick("reference_concentration"))
        now = tuple(a - b for a, b in zip(now, base))
    rows = [F.when(F.col(f"_is_{g}"), F.struct(F.lit(g).alias(specie), (f * F.col(f"scale_{g}")).alias("forcing")))
            for g, f in zip(MAIN_GASES, now)]
    big = wide.select(*keys, F.inline(F.array_compact(F.array(*rows))))
    zero = F.col("baseline_concentration") if offset else F.col("reference_concentration")
    small = df.filter(~F.col(specie).isin(list(MAIN_GASES))).select(
        *keys, specie, ((F.col("concentration") - zero) * F.col("efficiency") * 0.001 * F.col("scale")).alias("forcing"))
    return big.unionByName(small)


# -- linear and aerosol terms ------------------------------------------------------------------

def linear_forcing(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"), driver: str = "driver",
                   baseline: str = "baseline", efficiency: str = "efficiency", scale: str = "scale") -> DataFrame:
    """sum over species of (driver - baseline) * efficiency * scale, missing terms skipped."""
    term = (F.col(driver) - F.col(baseline)) * F.col(efficiency) * F.col(scale)
    return df.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("forcing"))


def _driven(emission: Column, concentration: Column) -> Column:
    """Emission- or concentration-driven term; concentration wins when both flags are set."""
    return F.when(F.col("from_concentration"), concentration).when(F.col("from_emissions"), emission)


def aerosol_direct(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t")) -> DataFrame:
    gap = _driven(F.col("emissions") - F.col("baseline_emissions"), F.col("concentration") - F.col("baseline_concentration"))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(gap * F.col("efficiency") * F.col("scale")), F.lit(0.0)).alias("forcing"))


def aerosol_indirect(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"), sensitivity: str = "sensitivity",
                     beta: str = "aci_scale", scale: str = "aci_forcing_scale") -> DataFrame:
    """beta * (ln(1 + sum s A) - ln(1 + sum s A0)) * scale; beta and scale are constant within a group.

    Emission- and concentration-driven sums both count a species with both flags.
    """
    s = F.col(sensitivity)

    def total(emission: str, concentration: str) -> Column:
        return (F.coalesce(F.sum(F.when(F.col("from_emissions"), s * F.col(emission))), F.lit(0.0))
                + F.coalesce(F.sum(F.when(F.col("from_concentration"), s * F.col(concentration))), F.lit(0.0)))

    diff = F.ln(1 + total("emissions", "concentration")) - F.ln(1 + total("baseline_emissions", "baseline_concentration"))
    return df.groupBy(*keys).agg((F.max(beta) * diff * F.max(scale)).alias("forcing"))


def ozone_forcing(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t")) -> DataFrame:
    """Concentration- plus emission-based weighted sums; one missing term makes the result missing."""
    conc = (F.col("concentration") - F.col("baseline_concentration")) * F.col("efficiency") * F.col("scale")
    emis = (F.col("emissions") - F.col("baseline_emissions")) * F.col("efficiency") * F.col("scale")
    by_conc, by_emis = F.when(F.col("from_concentration"), conc), F.when(F.col("from_emissions"), emis)
    gap = (F.col("from_concentration") & conc.isNull()) | (F.col("from_emissions") & emis.isNull())
    total = F.coalesce(F.sum(by_conc), F.lit(0.0)) + F.coalesce(F.sum(by_emis), F.lit(0.0))
    return df.groupBy(*keys).agg(F.when(F.count_if(gap) == 0, total).alias("forcing"))


def eesc(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"), reference: str = "CFC-11",
         bromine: float = BROMINE_PER_CHLORINE) -> DataFrame:
    """Equivalent effective stratospheric chlorine: atoms * concentration * release, over the halogens.

    Release is normalised by the reference gas and rescaled, so the reference must be present.
    """
    ref = F.max(F.when(F.col("specie") == reference, F.col("release")))
    atoms = F.col("cl_atoms") + F.lit(bromine) * F.col("br_atoms")
    total = F.sum(atoms * F.col("concentration") * F.col("release"))
    return df.groupBy(*keys).agg(F.when(ref.isNotNull(), F.coalesce(total, F.lit(0.0))).alias("eesc"))


def methane_lifetime_scale(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"), sensitivity: str = "sensitivity",
                           temperature: str = "temperature", temperature_sensitivity: str = "temperature_sensitivity") -> DataFrame:
    """exp(sum ln(1 + d * s) + ln(1 + T * s_T)); T and s_T are constant within a group."""
    s = F.col(sensitivity)
    log = lambda x: F.ln(1 + x * s)
    conc, emis = F.col("concentration") - F.col("baseline_concentration"), F.col("emissions") - F.col("baseline_emissions")
    term = F.when(F.col("from_concentration"), log(conc)).otherwise(F.lit(0.0)) \
        + F.when(F.col("from_emissions"), log(emis)).otherwise(F.lit(0.0))
    total = F.when(F.count_if(term.isNull()) == 0, F.sum(term))
    return df.groupBy(*keys).agg(F.exp(total + F.ln(1 + F.max(temperature) * F.max(temperature_sensitivity))).alias("lifetime_scale"))


# -- species constants -------------------------------------------------------------------------

def species_derived(species: DataFrame, horizon: float = 100.0, boxes: int = 4) -> DataFrame:
    """iirf_0, g1, g0 from partition_fraction<i> and unperturbed_lifetime<i>, and concentration per emission.

    A row-local expression over the boxes; a missing box makes the result missing.
    """
    def total(term) -> Column:
        parts = [term(F.col(f"partition_fraction{i}"), F.col(f"unperturbed_lifetime{i}")) for i in range(boxes)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    decay = lambda tau: F.exp(-F.lit(horizon) / tau)
    iirf = total(lambda a, tau: a * tau * (1 - decay(tau)))
    g1 = total(lambda a, tau: a * tau * (1 - (1 + F.lit(horizon) / tau) * decay(tau)))
    per = F.lit(1.0) / (F.lit(ATMOSPHERE_MASS / 1e18) * F.col("molecular_weight") / F.lit(AIR_WEIGHT))
    out = species.withColumns({"iirf_0": iirf, "g1": g1, "concentration_per_emission": per})
    return out.withColumn("g0", F.exp(-F.col("iirf_0") / F.col("g1")))


# -- totals over a run -------------------------------------------------------------------------

def total_forcing(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"),
                  temperature: DataFrame | None = None, step: float = 1.0) -> DataFrame:
    """Sum and efficacy-weighted sum over species, missing skipped.

    With ``temperature`` (keys, temperature) each species gets its feedback times the surface
    temperature of the previous step; the first step has no feedback.
    """
    f = F.col("forcing")
    if temperature is not None:
        before = temperature.select(*[k for k in keys if k != "t"], (F.col("t") + step).alias("t"), F.col("temperature").alias("_t0"))
        df = df.join(before, list(keys), "left")
        f = f + F.coalesce(F.col("_t0"), F.lit(0.0)) * F.col("temperature_feedback")
    return df.groupBy(*keys).agg(F.coalesce(F.sum(f), F.lit(0.0)).alias("forcing_sum"),
                                 F.coalesce(F.sum(f * F.col("efficacy")), F.lit(0.0)).alias("forcing_efficacy_sum"))


def co2_total(df: DataFrame, keys: Sequence[str] = ("scenario", "config", "t"), fossil: str = "CO2 FFI", land: str = "CO2 AFOLU") -> DataFrame:
    """Total CO2 emissions: fossil plus land; missing when either is missing."""
    pick = lambda s: F.max(F.when(F.col("specie") == s, F.col("emissions")))
    return df.filter(F.col("specie").isin(fossil, land)).groupBy(*keys).agg((pick(fossil) + pick(land)).alias("emissions"))


def airborne_fraction(airborne: Column | str = "airborne", cumulative: Column | str = "cumulative") -> Column:
    return F.try_divide(_c(airborne), _c(cumulative))


def toa_imbalance(temperature: DataFrame, forcing: DataFrame, configs: DataFrame, layers: int = 3,
                  keys: Sequence[str] = ("scenario", "config", "t")) -> DataFrame:
    """forcing - k1 T1 + (1 - efficacy) k_last (T_before_last - T_last), from the layers' temperatures.

    ``configs`` has kappa1..kappa<layers> and efficacy.
    """
    wide = temperature.groupBy(*keys).agg(*[F.max(F.when(F.col("layer") == i, F.col("temperature"))).alias(f"_T{i}") for i in range(layers)])
    rows = wide.join(forcing.select(*keys, "forcing_sum"), list(keys)) \
        .join(configs.select("config", "kappa1", F.col(f"kappa{layers}").alias("_kn"), "efficacy"), "config")
    n = F.col("forcing_sum") - F.col("kappa1") * F.col("_T0") \
        + (1 - F.col("efficacy")) * F.col("_kn") * (F.col(f"_T{layers - 2}") - F.col(f"_T{layers - 1}"))
    return rows.select(*keys, n.alias("toa_imbalance"))


def ocean_heat(imbalance: DataFrame, keys: Sequence[str] = ("scenario", "config"), t: str = "t", step: float = 1.0,
               initial: float = 0.0) -> DataFrame:
    """Ocean heat content change: running imbalance without its first step, over the Earth's surface, in J."""
    run = cumulative(imbalance, keys, t, "toa_imbalance", "_total")
    first = imbalance.groupBy(*keys).agg(F.min_by("toa_imbalance", t).alias("_first"))
    joules = step * EARTH_RADIUS ** 2 * 4 * math.pi * SECONDS_PER_YEAR
    return run.join(first, list(keys)).select(*keys, t, "toa_imbalance",
                                              ((F.col("_total") - F.col("_first")) * joules + initial).alias("ocean_heat"))
