"""Selecting, tagging and combining gridded variables by their key columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.columns import target_key
from gridspark.schema import FIRST_START_YEAR, LAST_START_YEAR, LAST_YEAR, TARGET_TENTHS
from gridspark.scratch import settle

_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}


def time_slice(df: DataFrame, start=None, end=None, time: str | Column = "year") -> DataFrame:
    """Rows between two labels, both ends included; an open end is None."""
    t = F.col(time) if isinstance(time, str) else time
    if start is not None:
        df = df.filter(t >= F.lit(start))
    if end is not None:
        df = df.filter(t <= F.lit(end))
    return df


def select_label(df: DataFrame, **labels) -> DataFrame:
    """Keep one label of each named dimension and drop the dimension."""
    for dim, label in labels.items():
        df = df.filter(F.col(dim) == F.lit(label))
    return df.drop(*labels)


def tag_dims(df: DataFrame, constants: dict | None = None, rename: dict | None = None,
             drop: Sequence[str] = (), order: Sequence[str] | None = None) -> DataFrame:
    """Add constant dimensions, rename, drop and reorder columns."""
    df = df.drop(*drop).withColumnsRenamed(rename or {})
    df = df.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    return df.select(*order) if order else df


def align_binary(left: DataFrame, right: DataFrame, op: str, on: Sequence[str] | None = None,
                 value: str = "value") -> DataFrame:
    """``left op right`` on the shared dimensions; dimensions only one side has are kept."""
    if op not in _ARITHMETIC:
        raise ValueError(f"unknown operation {op!r}")
    keys = list(on) if on else [c for c in left.columns if c in right.columns and c != value]
    other = right.withColumnRenamed(value, "_right")
    joined = left.join(other, keys)
    return joined.withColumn(value, _ARITHMETIC[op](F.col(value), F.col("_right"))).drop("_right")


def sum_components(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Total of two components paired by key, for streams where only the parts are stored."""
    return align_binary(first, second, "+", keys, value)


def unpaired_components(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present in only one of two component streams."""
    a, b = first.select(*keys), second.select(*keys)
    return a.join(b, list(keys), "left_anti").unionByName(b.join(a, list(keys), "left_anti"))


def precip_minus_evap(precip: DataFrame, evap: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return align_binary(precip, evap, "-", keys, value)


def population_exposure(df: DataFrame, population: DataFrame, value: str = "value") -> DataFrame:
    """Value times persons of the cell, in millions."""
    persons = population.select("cell_id", "persons")
    return df.join(persons, "cell_id").withColumn(value, F.col(value) * F.col("persons") / 1e6).drop("persons")


def blocked_product(left: DataFrame, right: DataFrame, spread: str, on: Sequence[str] = (), blocks: int = 16) -> DataFrame:
    """Every left row with every right row of the same ``on`` keys, as an equi-join.

    The left side is spread over ``blocks`` by a hash of column ``spread`` and the right side is copied once per block,
    so a small right side is broadcast by Catalyst and a large one shuffles with its work split over the
    blocks, whatever the keys look like.
    """
    a = left.withColumn("_block", F.pmod(F.hash(spread), F.lit(blocks)))
    b = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return a.join(b, [*on, "_block"]).drop("_block")


#: Rows of a map product that one task makes.
ROWS_PER_TASK = 2_000_000


def outer_scale(pattern: DataFrame, series: DataFrame, on: Sequence[str] = (), slope: str = "slope",
                driver: str = "driver", intercept: str | None = None, value: str = "value",
                blocks: int = 16) -> DataFrame:
    """Map times series: ``slope(cell) * driver(time) [+ intercept(cell)]`` for every cell and time."""
    scaled = F.col(slope) * F.col(driver)
    if intercept:
        scaled = scaled + F.col(intercept)
    used = [c for c in (slope, driver, intercept) if c and c != value]
    pattern, series = settle(pattern, "pattern"), settle(series, "drivers")
    # adaptive execution would merge a small pattern into one task before it is multiplied out; a stated number is kept
    steps = series.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-pattern.count() * steps // ROWS_PER_TASK))
    if parts > 1:
        pattern = pattern.repartition(parts, "cell_id")
    return blocked_product(pattern, series, "cell_id", on, blocks).withColumn(value, scaled).drop(*used)


def mask_cells(df: DataFrame, mask: DataFrame, value: str = "value", drop: bool = False) -> DataFrame:
    """Blank out (or drop) the cells that are not in ``mask``."""
    cells = mask.select("cell_id").distinct()
    if drop:
        return df.join(cells, "cell_id", "left_semi")
    marked = df.join(cells.withColumn("_inside", F.lit(True)), "cell_id", "left")
    return marked.withColumn(value, F.when(F.col("_inside"), F.col(value))).drop("_inside")


def drop_degenerate_days(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    """Remove the days of a member whose plain grid mean is exactly 0 (files padded with zeros)."""
    days = df.groupBy(*keys, date).agg(F.avg(value).alias("_mean"))
    empty = settle(days.filter(F.col("_mean") == 0).drop("_mean"), "empty-days")
    return df.join(empty, [*keys, date], "left_anti")


def match_time(df: DataFrame, driver: DataFrame, time: str = "year") -> DataFrame:
    """Restrict to the years of the driver series; a driver year without data is an error."""
    years = driver.select(time).distinct()
    missing = years.join(df.select(time).distinct(), time, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no data for {time}: {sorted(r[0] for r in missing)}")
    return df.join(years, time, "left_semi")


def common_scenarios(left: DataFrame, right: DataFrame, key: str = "scenario") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def sweep_grid(spark: SparkSession, scenarios: DataFrame, variables: Sequence[str],
               target_tenths: tuple[int, int] = TARGET_TENTHS,
               start_years: tuple[int, int] | None = (FIRST_START_YEAR, LAST_START_YEAR)) -> DataFrame:
    """Work list scenario x variable x target (x start year); targets are integer tenths."""
    work = scenarios.select("scenario").distinct()
    work = work.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables])))
    work = work.withColumn("target_tenths", F.explode(F.sequence(*[F.lit(t) for t in target_tenths])))
    work = work.withColumn("target_key", target_key("target_tenths"))
    if start_years:
        work = work.withColumn("start_year", F.explode(F.sequence(*[F.lit(y) for y in start_years])))
    return work


def overlay_override(df: DataFrame, override: DataFrame, keys: Sequence[str], value: str = "value",
                     zero: Column | None = None, factor: float = 1.0) -> DataFrame:
    """Replace values where ``override`` has the key; rows matching ``zero`` become 0.

    ``factor`` scales the replacement (an injected amount becomes a forcing).
    """
    repl = override.select(*keys, (F.col(value) * factor).alias("_override"))
    out = df.join(repl, list(keys), "left").withColumn(value, F.coalesce("_override", value)).drop("_override")
    return out.withColumn(value, F.when(zero, F.lit(0.0)).otherwise(F.col(value))) if zero is not None else out


def first_nonzero_year(df: DataFrame, keys: Sequence[str] = (), year: str = "year", value: str = "value") -> DataFrame:
    """First year whose total over the other dimensions is positive (NULL when there is none)."""
    totals = df.groupBy(*keys, year).agg(F.sum(value).alias("_total"))
    return totals.groupBy(*keys).agg(F.min(F.when(F.col("_total") > 0, F.col(year))).alias("first_year"))


def splice_before(with_: DataFrame, without: DataFrame, keys: Sequence[str], start_year: int | None = None,
                  starts: DataFrame | None = None, year: str = "year", value: str = "value") -> DataFrame:
    """Copy the series without intervention into the one with it before the start year.

    The start is a number, or one ``first_year`` per key in ``starts``; a NULL there (no injection at
    all) copies everything.
    """
    base = without.select(*keys, year, F.col(value).alias("_without"))
    out = with_.join(base, [*keys, year], "left")
    if starts is not None:
        shared = [k for k in keys if k in starts.columns]
        first = starts.select(*shared, F.coalesce("first_year", F.lit(LAST_YEAR + 1)).alias("_first"))
        out = out.join(first, shared)
    else:
        out = out.withColumn("_first", F.lit(start_year))
    before = (F.col(year) < F.col("_first")) & F.col("_without").isNotNull()
    return out.withColumn(value, F.when(before, F.col("_without")).otherwise(F.col(value))).drop("_without", "_first")


def append_history(history: DataFrame, projection: DataFrame, last_year: int, label: str,
                   dim: str = "experiment", year: str = "year") -> DataFrame:
    """Historical part up to ``last_year``, relabelled, followed by the projection."""
    past = history.filter(F.col(year) <= last_year).withColumn(dim, F.lit(label))
    return past.unionByName(projection)


def join_series(*parts: DataFrame) -> DataFrame:
    """One series from consecutive parts."""
    return reduce(DataFrame.unionByName, parts)


def split_series(df: DataFrame, last: int, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """History up to one year past its ``last`` year, and the projection from that same year on."""
    return df.filter(F.col(year) <= last + 1), df.filter(F.col(year) >= last + 1)


def stack_dim(parts: dict[str, DataFrame], dim: str) -> DataFrame:
    """Stack tables along a new label column."""
    return reduce(DataFrame.unionByName, [d.withColumn(dim, F.lit(k)) for k, d in parts.items()])


def sort_axis(df: DataFrame, *axes: str) -> DataFrame:
    """Order the output rows; ordering inside operators lives in windows."""
    return df.orderBy(*axes)
