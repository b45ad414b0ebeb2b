"""Summaries straight from patterns and drivers, without the maps in between.

A map is slope(cell) * driver(year) + intercept(cell) - base(cell), an intervention adds the sum over its components of
push(cell, component) * gate(year, component).  So there is one row per variable and cell, the years are short arrays
that come with the scenario, and means over cells or years are taken of the patterns or the drivers first.  Only day
counts, which a floor makes non-linear, are folded value by value, inside a row's arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import lat_weight
from gridspark.operators import align, spatial
from gridspark.plans import products as P
from gridspark.schema import DECADE_ORIGIN, FIRST_PROJECTED_YEAR, LAST_YEAR, variable_flag
from gridspark.scratch import settle

_BASE = ["variable", "scenario"]


@dataclass
class Vectors:
    """Patterns (variable, cell_id, lat, slope, intercept, base, push) and their axes.

    ``axis`` is (scenario, points) with points (year, d); ``pushed`` is (keys, points) with points (year, d, g), over the
    years that the intervention has; g and push are arrays over components in the same order.
    """

    patterns: DataFrame
    axis: DataFrame
    pushed: DataFrame
    keys: list[str]

    def within(self, region: DataFrame | None) -> Vectors:
        return self if region is None else Vectors(spatial.clip_to_land(self.patterns, region), self.axis, self.pushed, self.keys)


def vectors(coef: DataFrame, series: DataFrame, variables: Sequence[str], cells: DataFrame, land: DataFrame, population: DataFrame | None,
            baseline: DataFrame | None, pushes: DataFrame, gates: DataFrame, model: str | None = None,
            first_year: int = FIRST_PROJECTED_YEAR, last_year: int = LAST_YEAR) -> Vectors:
    """``pushes`` are patterns (variable, component, cell_id, slope) of source variables, ``gates`` drivers (keys, component, year, driver).

    Keys of ``gates`` may be variable, scenario and others; every scenario of ``series`` gets gates that name none.
    """
    own, push = own_patterns(coef, variables, land, population, model), push_patterns(pushes, variables, land, population)
    return assemble(own, push, baseline, cells, series, gates, first_year, last_year)


def own_patterns(coef: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None, model: str | None = None) -> DataFrame:
    """(variable, cell_id, slope, intercept) of the wanted variables."""
    return P.land_and_people(P.expand_variables(P.mean_coefs(coef, model), variables), land, population, ["slope", "intercept"]) \
        .select("variable", "cell_id", "slope", "intercept")


def push_patterns(pushes: DataFrame, variables: Sequence[str], land: DataFrame, population: DataFrame | None) -> DataFrame:
    """(variable, cell_id, push): slopes of all components of an intervention, in the components' order."""
    push = P.land_and_people(P.expand_variables(pushes, variables), land, population, ["slope"])
    push = push.groupBy("variable", "cell_id").agg(F.array_sort(F.collect_list(F.struct("component", "slope"))).alias("_p"))
    return push.select("variable", "cell_id", F.col("_p.slope").alias("push"))


def joined_patterns(own: DataFrame, push: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(variable, cell_id, slope, intercept, push, base); tables that are bucketed by variable and cell meet as they lie."""
    keys = ["variable", "cell_id"]
    out = own.join(push, keys, "left")
    if baseline is None:
        return out.withColumn("base", F.lit(0.0))
    out = out.join(baseline.select(*keys, F.col("value").alias("_base")), keys, "left")
    return out.withColumn("base", F.when(variable_flag(F.col("variable"), "rebase"), F.col("_base")).otherwise(F.lit(0.0))).drop("_base")


def assemble(own: DataFrame, push: DataFrame, baseline: DataFrame | None, cells: DataFrame, series: DataFrame, gates: DataFrame,
             first_year: int = FIRST_PROJECTED_YEAR, last_year: int = LAST_YEAR) -> Vectors:
    """Vectors from patterns that exist already, such as stored ones."""
    out = settle(joined_patterns(own, push, baseline).join(cells.select("cell_id", "lat"), "cell_id"), "patterns")
    drivers = settle(series.filter(F.col("year").between(first_year, last_year)).select("scenario", "year", F.col("driver").alias("d")), "drivers")
    points = lambda *c: F.array_sort(F.collect_list(F.struct(*c))).alias("points")
    axis = drivers.groupBy("scenario").agg(points("year", "d"))
    by = [c for c in gates.columns if c not in ("component", "year", "driver")]
    g = gates.groupBy(*by, "year").agg(F.array_sort(F.collect_list(F.struct("component", "driver"))).alias("_g")) \
        .select(*by, "year", F.col("_g.driver").alias("g"))
    rows = g.join(drivers, [c for c in ("scenario", "year") if c in g.columns])
    if "variable" not in by:
        names = out.select("variable").distinct()
        pushed = align.blocked_product(rows, names, "year")
    else:
        pushed = rows
    extra = [c for c in by if c not in _BASE]
    pushed = settle(pushed.groupBy(*_BASE, *extra).agg(points("year", "d", "g")), "gates")
    return Vectors(out, settle(axis, "axis"), pushed, [*_BASE, *extra])


def target_gates(gap: DataFrame, start_year: int, ramp_years: int, **kw) -> DataFrame:
    """Gates of the path to a target: one component, the gated gap."""
    return P.gated_gap(gap, start_year, ramp_years, **kw).withColumn("component", F.lit("gap"))


def injection_gates(injection: DataFrame, aod_params: DataFrame, climate_params: DataFrame, patterns: DataFrame, first_year: int,
                    variables: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(pushes, gates) of custom injections: one component per latitude band; p-e has the bands of pr and of e."""
    drivers = settle(P.injection_drivers(injection, aod_params, climate_params, first_year, **kw), "responses")
    drivers, own = P.add_precipitation_minus_evaporation(drivers), P.add_precipitation_minus_evaporation(patterns, "slope")
    wanted = lambda d: d.filter(F.col("variable").isin(list(variables))).withColumnRenamed("band", "component")
    return wanted(own).select("variable", "component", "cell_id", "slope"), wanted(drivers).select("variable", "component", "year", "driver")


# -- values ------------------------------------------------------------------------------------

def _is_count() -> Column:
    return variable_flag(F.col("variable"), "is_count")


def _map_value(p: Column) -> Column:
    raw = F.col("slope") * p["d"] + F.col("intercept")
    return F.when(_is_count(), F.when(raw > 0, raw).otherwise(F.lit(0.0))).otherwise(raw) - F.col("base")


def _push_value(p: Column) -> Column:
    return F.aggregate(F.zip_with("push", p["g"], lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def without_rows(v: Vectors, years: tuple[int, int] | None = None) -> DataFrame:
    """(variable, scenario, cell_id, lat, year, value), formed inside a row's arrays: nothing is joined by year."""
    axis = v.axis if years is None else v.axis.withColumn("points", F.filter("points", lambda p: p["year"].between(*years)))
    rows = align.blocked_product(v.patterns, axis, "cell_id")
    return rows.select("variable", "scenario", "cell_id", "lat", F.inline(F.transform("points", lambda p: F.struct(p["year"].alias("year"), _map_value(p).alias("value")))))


def with_rows(v: Vectors, years: tuple[int, int] | None = None, floor: bool = False) -> DataFrame:
    """(keys, cell_id, lat, year, value) with the intervention, over the years that it has."""
    axis = v.pushed if years is None else v.pushed.withColumn("points", F.filter("points", lambda p: p["year"].between(*years)))
    rows = align.blocked_product(v.patterns.filter(F.col("push").isNotNull()), axis, "cell_id", ["variable"])
    value = lambda p: _map_value(p) + _push_value(p)
    rows = rows.select(*v.keys, "cell_id", "lat", F.inline(F.transform("points", lambda p: F.struct(p["year"].alias("year"), value(p).alias("value")))))
    return P.floor_counts(rows) if floor else rows


def _mean(points: Column, value) -> Column:
    """Mean of the values that are there."""
    known = F.filter(F.transform(points, value), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x), F.size(known))


# -- parts -------------------------------------------------------------------------------------

def area_series(v: Vectors, start_year: int) -> tuple[DataFrame, DataFrame]:
    """Area means (or sums of exposures) without (variable, scenario, year) and with intervention (keys, year).

    Of linear variables only the mean patterns meet the years.
    """
    linear = v.patterns.filter(~_is_count())
    level = F.col("intercept") - F.col("base")
    w = F.when(F.col("slope").isNotNull() & level.isNotNull(), lat_weight("lat"))
    both = F.when(F.col("push").isNotNull() & F.forall(F.coalesce("push", F.array().cast("array<double>")), lambda x: x.isNotNull()), w)
    mean = lambda weight, x: F.try_divide(F.sum(weight * x), F.sum(weight))
    own = linear.groupBy("variable").agg(mean(w, F.col("slope")).alias("_a"), mean(w, level).alias("_b"), mean(both, F.col("slope")).alias("_a2"), mean(both, level).alias("_b2"))
    parts = linear.select("variable", both.alias("_w"), F.posexplode("push").alias("_i", "_x")).groupBy("variable", "_i").agg(mean(F.col("_w"), F.col("_x")).alias("_x"))
    parts = parts.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_m")).select("variable", F.col("_m._x").alias("_push"))
    means = settle(own.join(parts, "variable", "left"), "mean-patterns")
    flat = lambda value: F.inline(F.transform("points", lambda p: F.struct(p["year"].alias("year"), value(p).alias("value"))))
    without = align.blocked_product(v.axis, means, "scenario").select(*_BASE, flat(lambda p: F.col("_a") * p["d"] + F.col("_b")))
    pushed = F.zip_with("_push", "_g", lambda a, b: a * b)
    after = v.pushed.join(means.filter(F.col("_push").isNotNull()), "variable").select(*v.keys, "_a2", "_b2", "_push", F.inline(F.expr("transform(points, p -> struct(p.year as year, p.d as _d, p.g as _g))")))
    after = after.filter(F.col("year") >= start_year)
    with_ = after.select(*v.keys, "year", (F.col("_a2") * F.col("_d") + F.col("_b2") + F.aggregate(pushed, F.lit(0.0), lambda acc, x: acc + x)).alias("value"))
    counts = Vectors(v.patterns.filter(_is_count()), v.axis, v.pushed, v.keys)
    cells = lambda rows: rows.select("cell_id", "lat").distinct()
    places = cells(v.patterns)
    more = P.aggregate_series(without_rows(counts).drop("lat"), places, _BASE)
    more_with = P.aggregate_series(with_rows(counts, (start_year, LAST_YEAR), floor=True).drop("lat"), places, v.keys)
    return without.unionByName(more.select(*without.columns)), with_.unionByName(more_with.select(*with_.columns))


def map_means(v: Vectors, decade: tuple[int, int], region: DataFrame | None = None) -> DataFrame:
    """(keys, cell_id, mean, delta_mean, inside): decade means per cell of the map and of the intervention."""
    inside = lambda p: p["year"].between(*decade)
    axis = v.axis.withColumn("points", F.filter("points", inside)).filter(F.size("points") > 0)
    pushed = v.pushed.withColumn("points", F.filter("points", inside)).filter(F.size("points") > 0)
    both = pushed.join(axis.select("scenario", F.col("points").alias("_all")), "scenario")
    rows = align.blocked_product(v.patterns.filter(F.col("push").isNotNull()), both, "cell_id", ["variable"])
    out = rows.select(*v.keys, "cell_id", _mean(F.col("_all"), _map_value).alias("mean"), _mean(F.col("points"), _push_value).alias("delta_mean"))
    if region is None:
        return out.withColumn("inside", F.lit(True))
    marks = region.select("cell_id", F.lit(True).alias("inside")).distinct()
    return out.join(marks, "cell_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def decade_means(v: Vectors, intervention: bool, origin: int = DECADE_ORIGIN, decades: int = 6, width: int = 10) -> DataFrame:
    """(keys, cell_id, decade_end, value): decadal means folded inside a cell's arrays."""
    ends = [origin + width * (i + 1) for i in range(decades)]
    axis, patterns = (v.pushed, v.patterns.filter(F.col("push").isNotNull())) if intervention else (v.axis, v.patterns)
    inside = lambda end: F.filter("points", lambda p: p["year"].between(end - width + 1, end))
    spans = F.array(*[F.struct(F.lit(e).alias("decade_end"), inside(e).alias("points")) for e in ends])
    axis = axis.select(*[c for c in axis.columns if c != "points"], F.inline(spans)).filter(F.size("points") > 0)
    rows = align.blocked_product(patterns, axis, "cell_id", ["variable"] if intervention else [])
    value = (lambda p: _map_value(p) + _push_value(p)) if intervention else _map_value
    return rows.select(*(v.keys if intervention else _BASE), "cell_id", "decade_end", _mean(F.col("points"), value).alias("value"))


def decade_end_pvalues(v: Vectors, baseline: DataFrame, variability: DataFrame, land: DataFrame, decades: dict, decade_end: int) -> DataFrame:
    """(keys, cell_id, kind, p_value) of one decade, without and with the intervention."""
    inside = v.within(land)
    end = lambda d: d.filter(F.col("decade_end") == decade_end)
    p = lambda d, keys: P.decade_pvalues(end(d), baseline, variability, land, keys=keys).drop("decade_end")
    without = p(decade_means(inside, False, **decades), _BASE).join(v.pushed.select(*v.keys), _BASE)
    with_ = p(decade_means(inside, True, **decades), v.keys)
    return align.stack_dim({"no_sai": without.select(*v.keys, "cell_id", "p_value"), "with_sai": with_.select(*v.keys, "cell_id", "p_value")}, "kind")


def pattern_summary(v: Vectors, cells: DataFrame, start_year: int, decade: tuple[int, int], history: DataFrame | None = None, region: DataFrame | None = None,
                    obs: DataFrame | None = None, smooth: bool = True, history_window: tuple[int, int] = (1950, 1960), tests: dict | None = None,
                    natural: DataFrame | None = None, population: DataFrame | None = None, gap: DataFrame | None = None,
                    injection: DataFrame | None = None, splice_at: int | None = None) -> P.Summary:
    """The parts of ``products.scenario_summary`` from patterns and drivers.

    ``injection`` is the table that the summary shows (amounts by latitude and year).  With custom injections
    ``splice_at`` is the first year with any, and there is no gap.
    """
    here = v.within(region)
    past = history if history is None or region is None else spatial.clip_to_land(history, region)
    labels = v.pushed.select(*v.keys).join(v.patterns.filter(F.col("push").isNotNull()).select("variable").distinct(), "variable")

    def series() -> DataFrame:
        without, with_ = area_series(here, start_year)
        old = P.aggregate_series(past, cells, ["variable"]).select("variable", "year", "value") if past is not None else None
        return P.compose_series(without, with_, old, labels, start_year, v.keys, smooth, obs=obs, splice_at=splice_at)

    def histograms() -> DataFrame:
        old = past.filter(F.col("year").between(*history_window)) if past is not None else None
        return P.compose_histograms(without_rows(here, decade), with_rows(here, decade), old, labels, v.keys)

    parts = {"maps": lambda: map_means(v, decade, region), "series": series, "histograms": histograms}
    if tests is not None:
        parts["pvalues"] = lambda: decade_end_pvalues(v, **tests)
    if natural is not None:
        names = lambda: [r["variable"] for r in v.patterns.select("variable").distinct().collect()]
        parts["variability"] = lambda: P.variability_summary(natural, names(), population, region)
    if gap is not None:
        parts["gap"] = lambda: gap
    if injection is not None:
        parts["injection"] = lambda: injection
    return P.Summary(**parts)


def custom_summary(coef: DataFrame, series: DataFrame, variables: Sequence[str], cells: DataFrame, land: DataFrame, baseline: DataFrame | None,
                   injection: DataFrame, aod_params: DataFrame, climate_params: DataFrame, patterns: DataFrame, first_year: int, start_year: int,
                   decade: tuple[int, int], model: str | None = None, first_projected: int = FIRST_PROJECTED_YEAR, last_year: int = LAST_YEAR, **kw) -> P.Summary:
    """The summary of custom injections (band, year, value): their response in place of the path to a target.

    Variables are tas, pr and p-e.  Before the first year with an injection the series follows the one without; injections
    of zero leave it there throughout.
    """
    other = set(variables) - {"tas", "pr", "p-e"}
    if other:
        raise ValueError(f"no response of {sorted(other)} to custom injections")
    pushes, gates = injection_gates(injection, aod_params, climate_params, patterns, first_year, variables)
    first = align.first_nonzero_year(injection).first()["first_year"]
    v = vectors(coef, series, variables, cells, land, None, baseline, pushes, gates, model, first_projected, last_year)
    return pattern_summary(v, cells, start_year, decade, injection=injection, splice_at=first if first is not None else LAST_YEAR + 1, **kw)
