"""Calendar aggregation and ordered-series operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions.columns import exceeds
from gridspark.operators.align import blocked_product
from gridspark.schema import DECADE_ORIGIN, EQUIVALENT_WINDOWS, LAST_YEAR, PREINDUSTRIAL, variable_flag
from gridspark.scratch import settle


# -- calendar aggregation ----------------------------------------------------------------------

def daily_indices(df: DataFrame, keys: Sequence[str], thresholds: Sequence[tuple[str, str, float]] = (),
                  extremes: bool = True, date: str = "date", value: str = "value",
                  single: bool = False) -> DataFrame:
    """Monthly extremes and exceedance-day counts of a daily field, all in one pass.

    Every aggregate is partial, so each scan task sends one row per (key, month) it saw.
    """
    v = F.col(value)
    aggs = [F.max(v).alias("max"), F.min(v).alias("min")] if extremes else []
    aggs += [F.count_if(exceeds(v, op, limit, single)).alias(name) for name, op, limit in thresholds]
    months = df.withColumns({"year": F.year(date), "month": F.month(date)})
    return months.groupBy(*keys, "year", "month").agg(*aggs)


def daily_to_monthly_max(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    return daily_indices(df, keys, date=date, value=value).drop("min").withColumnRenamed("max", value)


def daily_to_monthly_min(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value") -> DataFrame:
    return daily_indices(df, keys, date=date, value=value).drop("max").withColumnRenamed("min", value)


def daily_exceedance_days(df: DataFrame, keys: Sequence[str], thresholds: Sequence[tuple[str, str, float]],
                          date: str = "date", value: str = "value", single: bool = False) -> DataFrame:
    return daily_indices(df, keys, thresholds, extremes=False, date=date, value=value, single=single)


def monthly_to_annual(df: DataFrame, keys: Sequence[str], how: str | None = None, year: str = "year",
                      value: str = "value") -> DataFrame:
    """Months to years. Without ``how`` the rule comes from the ``variable`` column's metadata."""
    rules = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    if how is not None:
        if how not in rules:
            raise ValueError(f"unknown annual aggregate {how!r}")
        return df.groupBy(*keys, year).agg(rules[how](value).alias(value))
    if "variable" not in keys:
        raise ValueError("keys must include 'variable' when no rule is given")
    out = df.groupBy(*keys, year).agg(*[f(value).alias(f"_{name}") for name, f in rules.items()])
    rule = variable_flag(F.col("variable"), "annual")
    pick = F.coalesce(*[F.when(rule == name, F.col(f"_{name}")) for name in rules])
    return out.withColumn(value, pick).drop(*[f"_{name}" for name in rules])


def ensemble_mean(df: DataFrame, over: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over member, emulator, config or replicate columns."""
    keys = [c for c in df.columns if c not in over and c != value]
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def climatology(df: DataFrame, keys: Sequence[str], windows: dict[str, tuple[int, int]] = EQUIVALENT_WINDOWS,
                year: str = "year", value: str = "value") -> DataFrame:
    """Mean over each named year window (inclusive, may overlap), in one pass."""
    hit = [F.when(F.col(year).between(a, b), F.lit(name)) for name, (a, b) in windows.items()]
    spread = df.withColumn("window", F.explode(F.array_compact(F.array(*hit))))
    return spread.groupBy(*keys, "window").agg(F.avg(value).alias(value))


def rebase(df: DataFrame, keys: Sequence[str], window: tuple[int, int] = PREINDUSTRIAL, year: str = "year",
           value: str = "value") -> DataFrame:
    """Subtract each series' own mean over the window; a series without data there becomes NULL."""
    base = df.filter(F.col(year).between(*window)).groupBy(*keys).agg(F.avg(value).alias("_base"))
    base = settle(base, "rebase")
    joined = df.join(base, list(keys), "left") if keys else blocked_product(df, base, year)
    return joined.withColumn(value, F.col(value) - F.col("_base")).drop("_base")


def decadal_means(df: DataFrame, keys: Sequence[str], origin: int = DECADE_ORIGIN, decades: int = 6,
                  year: str = "year", value: str = "value", width: int = 10) -> DataFrame:
    """Means of consecutive decades after ``origin``, labelled by their last year."""
    last = F.ceil((F.col(year) - origin) / width).cast("int") * width + origin
    inside = df.filter(F.col(year).between(origin + 1, origin + width * decades))
    return inside.groupBy(*keys, last.alias("decade_end")).agg(F.avg(value).alias(value))


def band_total(df: DataFrame, keys: Sequence[str] = ("year",), value: str = "value") -> DataFrame:
    """Sum over latitude bands."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


# -- fits along time ---------------------------------------------------------------------------

def linear_fit(df: DataFrame, keys: Sequence[str], x: str = "year", value: str = "value") -> DataFrame:
    """Degree-1 least squares per series. One point fits itself exactly."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.regr_slope(value, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(value, x), F.avg(value)).alias("intercept"))


def detrend_linear(df: DataFrame, keys: Sequence[str], x: str = "year", value: str = "value") -> DataFrame:
    """Subtract the degree-1 fit of each series.

    The fit is an aggregate joined back instead of a window: a long series is never gathered in one task.
    """
    fit = settle(linear_fit(df, keys, x, value), "trend")
    residual = F.col(value) - (F.col("slope") * F.col(x) + F.col("intercept"))
    return df.join(fit, list(keys)).withColumn(value, residual).drop("slope", "intercept")


# -- ordered series ----------------------------------------------------------------------------

def assert_monthly_contiguous(df: DataFrame, keys: Sequence[str], year: str = "year", month: str = "month") -> DataFrame:
    """Months that do not follow their predecessor by exactly one (empty when all is well).

    Works on the distinct months of a series, so the window never holds cells or duplicates.
    """
    months = df.select(*keys, (F.col(year) * 12 + F.col(month) - 1).alias("_m")).distinct()
    step = F.col("_m") - F.lag("_m").over(W.partitionBy(*keys).orderBy("_m"))
    bad = months.withColumn("gap_months", step).filter(F.col("gap_months") != 1)
    return bad.select(*keys, F.floor(F.col("_m") / 12).cast("int").alias(year),
                      (F.col("_m") % 12 + 1).cast("int").alias(month), "gap_months")


def known_neighbors(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value",
                    block: int = 4096, strict: bool = False) -> DataFrame:
    """Last known point at or before each row and first known point at or after it; without the row, if strict.

    Adds ``prev`` and ``next`` structs (t, v).  A series is cut into time blocks: windows run inside a
    block, and only one summary row per block is carried across, so no task ever holds a whole series.
    """
    point = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    known = F.when(F.col(value).isNotNull(), point)
    cut = df.withColumns({"_b": F.floor(F.col(t) / block), "_p": known})
    ends = cut.groupBy(*keys, "_b").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    order = W.partitionBy(*keys).orderBy("_b")
    carry = ends.select(
        *keys, "_b",
        F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inside = W.partitionBy(*keys, "_b").orderBy(t)
    lo = inside.rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    hi = inside.rowsBetween(1 if strict else W.currentRow, W.unboundedFollowing)
    local = cut.withColumns({"prev": F.last("_p", True).over(lo), "next": F.first("_p", True).over(hi)})
    joined = local.join(carry, [*keys, "_b"])
    return joined.withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")}) \
        .drop("_b", "_p", "_before", "_after")


def _on_line(at: Column, a: Column, b: Column) -> Column:
    """The line through points ``a`` and ``b`` (t, v) at ``at``."""
    return a["v"] + (b["v"] - a["v"]) * F.try_divide(at - a["t"], b["t"] - a["t"])


def interpolate_gaps(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value",
                     block: int = 4096) -> DataFrame:
    """Linear fill between known points; leading gaps stay missing, trailing gaps keep the last value."""
    near = known_neighbors(df, keys, t, value, block)
    filled = F.coalesce(F.col(value), F.when(F.col("next").isNull(), F.col("prev.v"))
                        .otherwise(_on_line(F.col(t), F.col("prev"), F.col("next"))))
    return near.withColumn(value, filled).drop("prev", "next")


def resample_axis(df: DataFrame, keys: Sequence[str], start: float, end: float, step: float = 1.0,
                  valid: tuple[float, float] | None = None, t: str = "t", value: str = "value",
                  block: int = 4096) -> DataFrame:
    """Linear interpolation of the known points onto the axis start, start+step, .., end.

    Each segment between two known points emits the axis points it covers; the first and last segment
    also cover the open ends (linear extrapolation).  Axis points outside ``valid`` become NULL.
    """
    points = known_neighbors(df.filter(F.col(value).isNotNull()), keys, t, value, block, strict=True)
    here, before, after = F.struct(F.col(t).alias("t"), F.col(value).alias("v")), F.col("prev"), F.col("next")
    # a point serves the axis up to the next one; the last point serves the rest with the line that ends in it
    seg = points.filter(before.isNotNull() | after.isNotNull()).select(
        *keys, F.col(t).alias("_t"), before.isNull().alias("_first"), after["t"].alias("_until"),
        F.when(after.isNotNull(), here).otherwise(before).alias("_a"), F.coalesce(after, here).alias("_b"))
    last = F.lit(int(round((end - start) / step)))
    position = lambda x: F.ceil((x - start) / step).cast("int")
    lo = F.when(F.col("_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), position(F.col("_t"))))
    hi = F.when(F.col("_until").isNull(), last).otherwise(F.least(last, position(F.col("_until")) - 1))
    out = seg.withColumn("_i", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    at = F.lit(start) + F.col("_i") * F.lit(step)
    v = _on_line(at, F.col("_a"), F.col("_b"))
    if valid:
        v = F.when(at.between(*valid), v)
    return out.select(*keys, at.alias(t), v.alias(value))


def cumulative(df: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value", out: str = "cumulative",
               step: float = 1.0, initial: float = 0.0, block: int = 4096) -> DataFrame:
    """Running total x step + initial; once a value is missing every later total is missing.

    Blocked like ``known_neighbors``: block totals are carried, rows are only ordered inside a block.
    """
    cut = df.withColumns({"_b": F.floor(F.col(t) / block), "_gap": F.col(value).isNull().cast("int")})
    sums = cut.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"), F.max("_gap").alias("_g"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
                        F.coalesce(F.max("_g").over(before), F.lit(0)).alias("_g0"))
    inside = W.partitionBy(*keys, "_b").orderBy(t).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = cut.withColumns({"_run": F.sum(value).over(inside), "_seen": F.max("_gap").over(inside)})
    total = (F.col("_s0") + F.col("_run")) * step + initial
    ok = (F.col("_g0") == 0) & (F.col("_seen") == 0)
    return run.join(carry, [*keys, "_b"]).withColumn(out, F.when(ok, total)) \
        .drop("_b", "_gap", "_run", "_seen", "_s0", "_g0")


def assign_noleap_dates(df: DataFrame, keys: Sequence[str], start_year: int, n_days: int,
                        date: str = "date", start_month: int = 1) -> DataFrame:
    """Re-date a daily series on the 365-day calendar from its start month; rows past ``n_days`` go.

    Positions are ranked on the distinct dates of a series (bounded by the calendar) and joined back.
    """
    days = df.select(*keys, date).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(date)) - 1
    days = days.withColumn("_i", rank).filter(F.col("_i") < n_days)
    first = F.dayofyear(F.make_date(F.lit(2001), F.lit(start_month), F.lit(1))) - 1
    pos = F.col("_i") + first
    # 2001 has no leap day: its day-of-year gives month and day on the 365-day calendar
    template = F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(pos, F.lit(365)).cast("int"))
    new = F.make_date(F.lit(start_year) + F.floor(pos / 365).cast("int"), F.month(template), F.day(template))
    mapping = days.withColumn("noleap_date", new).drop("_i")
    return df.join(mapping, [*keys, date])


def gate_and_ramp(df: DataFrame, keys: Sequence[str], ramp_years: int, diff: str = "temp_diff", value: str = "value",
                  year: str = "year", last_year: int = LAST_YEAR) -> DataFrame:
    """Zero while the target lies above the projection, then ramp up linearly.

    The ramp runs from 1/r to 1 over the first r active years, r capped at ``last_year`` - first active
    year; a first active year equal to ``last_year`` gets factor 1.
    """
    if not keys:
        raise ValueError("gate_and_ramp needs at least one series key")
    active = ~F.coalesce(F.col(diff) > 0, F.lit(False))
    gated = F.when(active, F.col(value)).otherwise(F.lit(0.0))
    if ramp_years <= 0:
        return df.withColumn(value, gated)
    first = df.groupBy(*keys).agg(F.min(F.when(active, F.col(year))).alias("_first"))
    length = F.least(F.lit(ramp_years), F.lit(last_year) - F.col("_first"))
    pos = F.col(year) - F.col("_first") + 1
    factor = F.when(pos.between(1, length), pos / length).otherwise(F.lit(1.0))
    return df.join(first, list(keys)).withColumn(value, gated * F.coalesce(factor, F.lit(1.0))).drop("_first")


def monthly_expand(df: DataFrame, year: str = "year", value: str = "value") -> DataFrame:
    """Spread an annual amount evenly over 12 months."""
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn(value, F.col(value) / 12)


def annual_mean_12(df: DataFrame, keys: Sequence[str], month_index: str = "k", value: str = "value",
                   start_year: int = 0) -> DataFrame:
    """Mean of consecutive blocks of 12 months; ``month_index`` counts from 0."""
    year = F.floor(F.col(month_index) / 12).cast("int") + start_year
    return df.groupBy(*keys, year.alias("year")).agg(F.avg(value).alias(value))
