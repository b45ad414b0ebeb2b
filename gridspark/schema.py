"""Variable vocabulary, labels and other values that are fixed by the data sets.

Metadata is looked up with literal maps (``variable_flag``), so no join is spent on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variable:
    name: str
    source: str        # variable whose fit and variability are used
    stream: str        # field name inside the model output files
    annual: str        # months -> year
    is_count: bool     # day counts: floored at zero
    is_exposure: bool  # multiplied by persons
    land_only: bool
    rebase: bool       # reported relative to the 1850-1900 mean
    history: str       # experiment that holds the historical period


# Variable names, field names and rules of the data sets.
VARIABLES = {v.name: v for v in [
    Variable("tas", "tas", "TREFHT", "mean", False, False, False, True, "baseline"),
    Variable("pr", "pr", "PRECT", "mean", False, False, True, True, "baseline"),
    Variable("p-e", "p-e", "QFLX", "mean", False, False, True, True, "baseline"),
    Variable("tasmin", "tasmin", "TREFHTMN", "min", False, False, False, True, "cmip_historical"),
    Variable("tasmax", "tasmax", "TREFHTMX", "max", False, False, False, True, "cmip_historical"),
    Variable("tas_above_40", "tas_above_40", "TREFHT_above_40", "sum", True, False, True, False, "cmip_historical"),
    Variable("tas_above_35", "tas_above_35", "TREFHT_above_35", "sum", True, False, True, False, "cmip_historical"),
    Variable("tas_below_0", "tas_below_0", "TREFHT_below_0", "sum", True, False, True, False, "cmip_historical"),
    Variable("pr_above_10", "pr_above_10", "PRECT_above_10", "sum", True, False, True, False, "cmip_historical"),
    Variable("pr_above_20", "pr_above_20", "PRECT_above_20", "sum", True, False, True, False, "cmip_historical"),
    Variable("exposure_above_40", "tas_above_40", "TREFHT_above_40", "sum", True, True, True, False, "cmip_historical"),
    Variable("exposure_above_35", "tas_above_35", "TREFHT_above_35", "sum", True, True, True, False, "cmip_historical"),
    Variable("exposure_below_0", "tas_below_0", "TREFHT_below_0", "sum", True, True, True, False, "cmip_historical"),
    Variable("exposure_above_10", "pr_above_10", "PRECT_above_10", "sum", True, True, True, False, "cmip_historical"),
    Variable("exposure_above_20", "pr_above_20", "PRECT_above_20", "sum", True, True, True, False, "cmip_historical"),
    Variable("aod", "aod", "AODVISstdn", "mean", False, False, False, False, "baseline"),
]}

# Variables of the default sweep, and those fitted to the global series / to differences.
SWEEP_VARIABLES = ["tas", "p-e", "tasmin", "tasmax", "exposure_above_40", "exposure_above_35",
                   "exposure_below_0", "exposure_above_10", "exposure_above_20"]
FIT_VARIABLES = ["tas", "pr", "tasmax", "tasmin", "tas_above_35", "tas_above_40", "tas_below_0",
                 "pr_above_10", "pr_above_20", "p-e"]

# Scenario ids and titles.
SCENARIO_TITLES = {
    "ssp119": "SSP1-1.9",
    "ssp126": "SSP1-2.6",
    "ssp434": "SSP4-3.4",
    "ssp534-over": "SSP5-3.4",
    "ssp245": "SSP2-4.5",
    "ssp460": "SSP4-6.0",
    "ssp370": "SSP3-Baseline",
    "ssp585": "SSP5-Baseline",
}

# Experiment label found in a file name -> experiment (a target is the warming it holds).
EXPERIMENT_LABELS = [
    ("SSP245-MA-GAUSS-LOWER-0.5", "1.0"),
    ("SSP245-MA-GAUSS-LOWER-1.0", "0.5"),
    ("SSP245-MA-GAUSS-DEFAULT", "1.5"),
    ("CMIP6-historical", "cmip_historical"),
    ("HIST.", "historical"),
    ("WACCM-MA-1deg", "baseline"),
]

# Axes of the scenario products.
FIRST_PROJECTED_YEAR = 2015
LAST_YEAR = 2100
LAST_HISTORICAL_YEAR = 2014
PREINDUSTRIAL = (1850, 1900)
FIRST_START_YEAR = 2035
CANVAS_START_YEAR = 2024
LAST_START_YEAR = 2090
TARGET_TENTHS = (5, 25)
DECADE_ORIGIN = 2040
EXPERIMENT_WINDOW = (2050, 2069)
EQUIVALENT_WINDOWS = {"1.5": (2020, 2039), "1.0": (2008, 2027), "0.5": (1993, 2012)}
VARIABILITY_FIT = (2025, 2099)
VARIABILITY_WINDOW = (2010, 2030)
SAMPLES_PER_GROUP = 63
REPLICATES = 100

# Daily thresholds, temperature in K and precipitation in mm/day.
ZERO_CELSIUS = 273.15
DAILY_THRESHOLDS = {
    "tas": [("tas_above_40", ">", 40 + ZERO_CELSIUS), ("tas_above_35", ">", 35 + ZERO_CELSIUS),
            ("tas_below_0", "<", 0 + ZERO_CELSIUS)],
    "pr": [("pr_above_10", ">", 10.0), ("pr_above_20", ">", 20.0)],
}


def sql_literal(x) -> str:
    """A Python value as SQL text; short fixed tables are parsed once instead of built call by call."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}D"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items()) + ")")


def variable_flag(variable: Column, field: str) -> Column:
    """Metadata ``field`` of a variable column, as a literal lookup."""
    values = {v.name: getattr(v, field) for v in VARIABLES.values()}
    if all(isinstance(x, bool) for x in values.values()):
        return variable.isin([name for name, on in values.items() if on])
    return literal_map(values)[variable]


def literal_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A short fixed table, inlined in the plan so that Catalyst knows how small it is."""
    values = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
