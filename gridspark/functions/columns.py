"""Column expressions: missing values, geography, units, labels, calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.schema import SCENARIO_TITLES, VARIABLES, literal_map, variable_flag


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """NaN becomes NULL, so that comparisons and aggregates skip it."""
    return F.when(~F.isnan(_c(x)), _c(x))


def floor_zero(x: Column | str) -> Column:
    """Positive values, else 0; a missing value becomes 0 too."""
    return F.when(_c(x) > 0, _c(x)).otherwise(F.lit(0.0))


def lat_weight(lat: Column | str) -> Column:
    return F.cos(F.radians(_c(lat)))


def lon_to_180(lon: Column | str) -> Column:
    """0..360 to -180..180; exactly 180 stays +180."""
    return F.when(_c(lon) > 180, _c(lon) - 360).otherwise(_c(lon))


def lon_to_360(lon: Column | str) -> Column:
    return F.pmod(_c(lon), F.lit(360.0))


def lon_wrap_180(lon: Column | str) -> Column:
    """0..360 to -180..180; exactly 180 becomes -180 (country assignment uses this one)."""
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def population_lon(lon: Column | str) -> Column:
    """The population raster is stored half a turn away from the grid."""
    return F.pmod(_c(lon) + 180, F.lit(360.0))


def flux_to_mm_day(variable: Column | str, x: Column | str) -> Column:
    """pr: m/s to mm/day; p-e source: kg/m2/s to mm/day; other variables unchanged."""
    v = _c(variable)
    return F.when(v == "pr", _c(x) * 1000 * 86400).when(v == "p-e", _c(x) * 86400).otherwise(_c(x))


def target_key(tenths: Column | str) -> Column:
    """Integer tenths of a degree to the one-decimal key used in product names."""
    return F.format_string("%.1f", _c(tenths) / F.lit(10.0))


def scenario_title(scenario: Column | str) -> Column:
    return literal_map(SCENARIO_TITLES)[_c(scenario)]


def scenario_id(title: Column | str) -> Column:
    return literal_map({t: s for s, t in SCENARIO_TITLES.items()})[_c(title)]


def source_variable(variable: Column | str) -> Column:
    return variable_flag(_c(variable), "source")


def month_index(year: Column | str, month: Column | str) -> Column:
    return _c(year) * 12 + _c(month)


def year_month_key(date: Column | str) -> Column:
    return F.date_format(_c(date), "yyyyMM")


def exceeds(x: Column, op: str, limit: float, single: bool = False) -> Column:
    """Strict comparison; ``single`` compares in single precision, as stored fields do."""
    bound = F.lit(float(limit)).cast("float") if single else F.lit(float(limit))
    if op == ">":
        return x > bound
    if op == "<":
        return x < bound
    raise ValueError(f"unknown comparison {op!r}")


def check_variable(name: str, allowed: list[str] | None = None) -> None:
    names = allowed if allowed is not None else list(VARIABLES)
    if name not in names:
        raise ValueError(f"variable {name!r} is not one of {names}")
