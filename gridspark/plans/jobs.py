"""Whole jobs: from stored daily and monthly files to annual, regional and natural products.

A job is a graph of products.  Each is written once, committed to its ledger under a mark that stands for everything it
was made from, and read back by the products behind it.  A run that stopped goes on at the first product that isn't
finished; a product whose inputs were made anew is made anew as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.columns import check_variable
from gridspark.operators import align, spatial, stats, timeops
from gridspark.plans import products as P
from gridspark.schema import LAST_HISTORICAL_YEAR, VARIABLES
from gridspark.scratch import settle
from gridspark.sources import grid, ledger

#: Years that are kept of historical and of other experiments.
HISTORICAL_YEARS, PROJECTED_YEARS = (1850, LAST_HISTORICAL_YEAR), (2015, 2099)
#: Fields of total precipitation and of its two components.
TOTAL, COMPONENTS = "PRECT", ("PRECC", "PRECL")


@dataclass(frozen=True)
class Product:
    """A named table, built from the products it needs; ``inner`` columns become folders."""

    name: str
    build: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    inner: tuple[str, ...] = ()


def run_products(spark: SparkSession, path: str, products: Sequence[Product], source: str = "", redo: Sequence[str] = ()) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """(tables, whether each was written in this run) of products listed in the order of their needs.

    ``source`` marks the state of what lies outside the graph (names of input files, parameters); products named in
    ``redo`` are made anew, and so is everything made from them.
    """
    tables, written, marks = {}, {}, {}
    for p in products:
        mark = hashlib.md5("|".join([source, p.name, *(marks[n] for n in p.needs)]).encode()).hexdigest()
        where = f"{path}/{p.name}"
        key = spark.range(1).select(F.lit(mark).alias("made_from"))
        have = None if p.name in redo else ledger.finished(spark, where, {"made_from": key.schema["made_from"].dataType})
        found = have.filter(F.col("made_from") == mark).select(ledger.COMMIT).first() if have is not None else None
        written[p.name] = found is None
        if found is None:
            df = p.build(*(tables[n] for n in p.needs))
            id_ = ledger.commit(df.withColumn("made_from", F.lit(mark)), where, ["made_from"], key, p.inner)
        else:
            id_ = found[0]
        marks[p.name] = id_
        tables[p.name] = ledger.read(spark, where).filter(F.col("made_from") == mark).drop("made_from")
    return tables, written


# -- from files to months ----------------------------------------------------------------------

def is_historical(experiment: Column) -> Column:
    return experiment.contains("historical")


def keep_years(df: DataFrame, historical: tuple[int, int] = HISTORICAL_YEARS, projected: tuple[int, int] = PROJECTED_YEARS, year: Column | str = "year") -> DataFrame:
    """Historical experiments within their years, the others within theirs; ends included."""
    y = F.col(year) if isinstance(year, str) else year
    past = is_historical(F.col("experiment"))
    return df.filter((past & y.between(*historical)) | (~past & y.between(*projected)))


def redate(df: DataFrame) -> DataFrame:
    """Give the days of members whose files have no readable dates those of the 365-day calendar, by their ``step``.

    The calendar starts with the first month that the names of the member's files state and ends with the last; steps
    beyond it go.
    """
    undated = df.filter(F.col("date").isNull())
    ends = F.split("span", "-")
    month = lambda i: F.substring(ends[i], 1, 6).cast("int")
    spans = settle(undated.groupBy("experiment", "member").agg(F.min(month(0)).alias("_from"), F.max(month(1)).alias("_to")), "spans")
    of_year = lambda y, m, d: F.dayofyear(F.make_date(F.lit(2001), m, d)) + 365 * y
    y0, m0, y1, m1 = F.floor(F.col("_from") / 100).cast("int"), F.col("_from") % 100, F.floor(F.col("_to") / 100).cast("int"), F.col("_to") % 100
    last = F.dayofmonth(F.last_day(F.make_date(F.lit(2001), m1, F.lit(1))))
    spans = spans.select("experiment", "member", y0.alias("_y0"), m0.alias("_m0"), (of_year(y1, m1, last) - of_year(y0, m0, F.lit(1)) + 1).alias("_days"))
    keys = ["experiment", "member", "_y0", "_m0", "_days"]
    rows = undated.drop("date").join(spans, ["experiment", "member"])
    rows = timeops.assign_noleap_dates(rows, keys, F.col("_y0"), F.col("_days"), date="step", start_month=F.col("_m0"))
    rows = rows.withColumnRenamed("noleap_date", "date").drop("_y0", "_m0", "_days")
    return df.filter(F.col("date").isNotNull()).unionByName(rows.select(*df.columns))


def daily_field(spark: SparkSession, root: str, variable: str, last_historical: int = LAST_HISTORICAL_YEAR) -> DataFrame:
    """(experiment, member, date, cell_id, value) of a daily field's files: named, dated and cut."""
    rows = grid.file_keys(grid.scan_grid(spark, root, VARIABLES[variable].stream, daily=True))
    stepped = "step" in rows.columns
    step = F.col("step").cast("long") if stepped else F.lit(None).cast("long")
    rows = rows.select("experiment", "member", "span", F.col("date").cast("date").alias("date"), step.alias("step"), "cell_id", F.col("value").cast("double").alias("value"))
    if stepped:
        rows = redate(rows)
    late = is_historical(F.col("experiment")) & (F.year("date") > last_historical)
    return rows.filter(~late).select("experiment", "member", "date", "cell_id", "value")


def monthly_indices(spark: SparkSession, root: str, thresholds: dict | None = None) -> DataFrame:
    """(variable, experiment, member, cell_id, year, month, value): extremes and day counts of both daily fields."""
    parts = [P.process_daily(daily_field(spark, root, v), v, thresholds=(thresholds or {}).get(v)) for v in ("tas", "pr")]
    return parts[0].unionByName(parts[1])


def stored_field(spark: SparkSession, root: str, field: str) -> DataFrame:
    """(experiment, member, cell_id, year, month, value) of a monthly field's files, all pieces of a member as one."""
    rows = grid.file_keys(grid.scan_grid(spark, root, field, daily=False))
    return rows.select("experiment", "member", "cell_id", F.year("date").alias("year"), F.month("date").alias("month"), F.col("value").cast("double").alias("value"))


def total_precipitation(spark: SparkSession, root: str) -> DataFrame:
    """Stored totals; members that have the two components get their sum, and an unpaired component is an error."""
    keys = ["experiment", "member", "cell_id", "year", "month"]
    first, second = (stored_field(spark, root, c) for c in COMPONENTS)
    alone = align.unpaired_components(first, second, keys).limit(3).collect()
    if alone:
        raise ValueError(f"components without their other part: {[tuple(r) for r in alone]}")
    summed = align.sum_components(first, second, keys)
    have = settle(first.select("experiment", "member").distinct(), "summed-members")
    stored = stored_field(spark, root, TOTAL).join(have, ["experiment", "member"], "left_anti")
    return stored.unionByName(summed.select(*stored.columns))


def stored_months(spark: SparkSession, root: str, variables: Sequence[str]) -> DataFrame:
    """(variable, experiment, member, cell_id, year, month, value) of the variables that are stored by month.

    A member whose months don't follow each other is an error.
    """
    out = []
    for v in variables:
        rows = total_precipitation(spark, root) if v == "pr" else stored_field(spark, root, VARIABLES[v].stream)
        out.append(keep_years(rows).withColumn("variable", F.lit(v)))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = settle(rows, "months")
    gaps = timeops.assert_monthly_contiguous(rows, ["variable", "experiment", "member"]).limit(3).collect()
    if gaps:
        raise ValueError(f"months are missing before {[tuple(r) for r in gaps]}")
    return rows


# -- the job -----------------------------------------------------------------------------------

#: Variables that monthly files hold; the others come out of daily ones.
STORED = ("tas", "pr", "p-e")


def climate_products(spark: SparkSession, root: str, cells: DataFrame, target_cells: DataFrame | None = None, variables: Sequence[str] = STORED,
                     thresholds: dict | None = None, fit: tuple[int, int] = stats.VARIABILITY_FIT, window: tuple[int, int] = stats.VARIABILITY_WINDOW,
                     last_historical: int = LAST_HISTORICAL_YEAR, baseline: str = "baseline", history: str = "historical") -> list[Product]:
    """The graph from stored files: indices, months, members' years, then natural, regional and annual products."""
    for v in variables:
        check_variable(v)

    def members(indices: DataFrame, months: DataFrame) -> DataFrame:
        return P.annual_members(months.unionByName(keep_years(indices).select(*months.columns)))

    def natural(annual: DataFrame) -> DataFrame:
        return stats.natural_variability(annual.filter(F.col("experiment") == baseline), cells, window=fit)

    def regional(annual: DataFrame) -> DataFrame:
        out = stats.regional_variability(annual.filter(F.col("experiment") == baseline), fit=fit, window=window)
        return out if target_cells is None else spatial.bilinear_regrid(out, cells, target_cells, ["variable"])

    def ensemble(annual: DataFrame) -> DataFrame:
        past, rest = annual.filter(F.col("experiment") == history), annual.filter(F.col("experiment") != history)
        mean = timeops.ensemble_mean(align.append_history(past, rest, last_historical, baseline), ["member"])
        if target_cells is not None:
            mean = spatial.bilinear_regrid(mean, cells, target_cells, ["variable", "experiment", "year"])
        return mean.select("variable", "experiment", "year", "cell_id", "value")

    return [
        Product("indices", lambda: monthly_indices(spark, root, thresholds), (), ("variable",)),
        Product("months", lambda: stored_months(spark, root, variables), (), ("variable",)),
        Product("members", members, ("indices", "months"), ("variable",)),
        Product("natural", natural, ("members",)),
        Product("regional", regional, ("members",), ("variable",)),
        Product("ensemble", ensemble, ("members",), ("variable",)),
        Product("annual", P.precipitation_minus_evaporation, ("ensemble",), ("variable",)),
    ]


def source_mark(spark: SparkSession, root: str) -> str:
    """A mark of the stored files' names and sizes; their contents are not read."""
    files = ledger.data_files(spark, root)
    return files.agg(F.coalesce(F.md5(F.concat_ws("|", F.sum(F.xxhash64("name", "size").cast("decimal(38,0)")), F.count("*"))), F.lit(""))).first()[0]


def process_files(spark: SparkSession, root: str, path: str, cells: DataFrame, redo: Sequence[str] = (), **kw) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """Run the graph of ``climate_products`` over the files below ``root``; (products, which were written now)."""
    return run_products(spark, path, climate_products(spark, root, cells, **kw), source_mark(spark, root), redo)
