"""Spatial means, variability, fits, tests, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions.columns import lat_weight
from gridspark.functions.statistics import ttest_pvalue
from gridspark.operators.align import blocked_product
from gridspark.operators.timeops import decadal_means
from gridspark.schema import REPLICATES, SAMPLES_PER_GROUP, VARIABILITY_FIT, VARIABILITY_WINDOW
from gridspark.scratch import settle


# -- spatial -----------------------------------------------------------------------------------

def area_weighted_mean(df: DataFrame, cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """cos(latitude)-weighted mean over cells; missing values leave numerator and denominator."""
    return regional_aggregate(df, cells, keys, "mean", value)


def regional_aggregate(df: DataFrame, cells: DataFrame, keys: Sequence[str], op: str, value: str = "value",
                       weighted: bool = True) -> DataFrame:
    """mean, sum, max or min over cells; the extremes ignore the weights."""
    v = F.col(value)
    w = lat_weight("lat") if weighted else F.lit(1.0)
    aggs = {
        "mean": F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))),
        "sum": F.coalesce(F.sum(v * w), F.lit(0.0)),
        "max": F.max(v),
        "min": F.min(v),
    }
    if op not in aggs:
        raise ValueError(f"unknown operation {op!r}")
    return df.join(cells.select("cell_id", "lat"), "cell_id").groupBy(*keys).agg(aggs[op].alias(value))


def population_variability(variability: DataFrame, population: DataFrame, cells: DataFrame | None = None,
                           value: str = "value") -> DataFrame:
    """Scalar variability times persons (of the given cells, or all), in millions."""
    people = population.join(cells.select("cell_id").distinct(), "cell_id", "left_semi") if cells is not None else population
    total = people.agg(F.coalesce(F.sum("persons"), F.lit(0.0)).alias("_persons"))
    weighted = blocked_product(variability, total, value)
    return weighted.withColumn(value, F.col(value) * F.col("_persons") / 1e6).drop("_persons")


# -- variability -------------------------------------------------------------------------------

def natural_variability(df: DataFrame, cells: DataFrame, keys: Sequence[str] = ("variable",), member: str = "member",
                        window: tuple[int, int] = VARIABILITY_FIT, year: str = "year", value: str = "value") -> DataFrame:
    """Population std over (member, year) of the detrended area mean.

    Residuals of a least-squares line sum to zero, so the pooled variance is the members' residual sums
    of squares over all points: no joining back of fitted lines.
    """
    means = area_weighted_mean(df.filter(F.col(year).between(*window)), cells, [*keys, member, year], value)
    per = means.groupBy(*keys, member).agg(
        F.regr_syy(value, year).alias("_syy"), F.regr_sxy(value, year).alias("_sxy"),
        F.regr_sxx(value, year).alias("_sxx"), F.regr_count(value, year).alias("_n"))
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.coalesce(F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0)))
    return per.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(rss), F.sum("_n"))).alias(value))


def regional_variability(df: DataFrame, keys: Sequence[str] = ("variable", "cell_id"), member: str = "member",
                         fit: tuple[int, int] = VARIABILITY_FIT, window: tuple[int, int] = VARIABILITY_WINDOW,
                         year: str = "year", value: str = "value") -> DataFrame:
    """Per cell: detrend each member over ``fit``, population std of the residuals inside ``window``.

    One pass over the data: line and window moments are aggregated together, and the residual sums
    follow from the moments.
    """
    x = (F.col(year) - fit[0]).cast("double")
    v = F.col(value)
    used = F.when(F.col(year).between(*window) & v.isNotNull(), F.lit(1.0))
    per = df.filter(F.col(year).between(*fit)).groupBy(*keys, member).agg(
        F.coalesce(F.regr_slope(v, x), F.lit(0.0)).alias("b"),
        F.coalesce(F.regr_intercept(v, x), F.avg(v)).alias("a"),
        F.avg(v).alias("c"),
        F.sum(used).alias("n"), F.sum(used * x).alias("sx"), F.sum(used * x * x).alias("sxx"),
        F.avg(used * v).alias("my"), F.var_pop(used * v).alias("vy"), F.sum(used * x * v).alias("sxy"))
    n, a, b, sx, sxx, my, vy, sxy = (F.col(c) for c in ("n", "a", "b", "sx", "sxx", "my", "vy", "sxy"))
    # sums of residuals r = y - a - b x and of r^2, with y taken relative to a to keep digits
    sy0 = n * (my - a)
    syy0 = n * (vy + (my - a) * (my - a))
    sxy0 = sxy - a * sx
    per = per.select(*keys, n.alias("_n"), (sy0 - b * sx).alias("_r"), (syy0 + b * b * sxx - 2 * b * sxy0).alias("_rr"))
    mean = F.try_divide(F.sum("_r"), F.sum("_n"))
    var = F.try_divide(F.sum("_rr"), F.sum("_n")) - mean * mean
    return per.groupBy(*keys).agg(F.sqrt(F.when(var > 0, var).otherwise(var * 0)).alias(value))


# -- tests -------------------------------------------------------------------------------------

def regional_pvalues(comparison: DataFrame, reference: DataFrame, std: DataFrame, land: DataFrame | None,
                     keys: Sequence[str] = ("variable",), n: int = SAMPLES_PER_GROUP, **decades) -> DataFrame:
    """p-value per cell and decade of the comparison's decadal mean against the reference map.

    ``reference`` and ``std`` are maps (keys, cell_id, value); ``comparison`` also has years.
    """
    if land is not None:
        comparison = comparison.join(land.select("cell_id").distinct(), "cell_id", "left_semi")
    return decade_pvalues(decadal_means(comparison, [*keys, "cell_id"], **decades), reference, std, None, keys, n)


def decade_pvalues(dec: DataFrame, reference: DataFrame, std: DataFrame, land: DataFrame | None,
                   keys: Sequence[str] = ("variable",), n: int = SAMPLES_PER_GROUP) -> DataFrame:
    """The same for decadal means that exist already (keys, cell_id, decade_end, value)."""
    shared = lambda d: [k for k in [*keys, "cell_id"] if k in d.columns]
    if land is not None:
        dec = dec.join(land.select("cell_id").distinct(), "cell_id", "left_semi")
    ref = reference.select(*shared(reference), F.col("value").alias("_ref"))
    dev = std.select(*shared(std), F.col("value").alias("_dev"))
    joined = dec.join(ref, shared(reference)).join(dev, shared(std))
    return ttest_pvalue(joined, F.col("_ref"), F.col("value"), F.col("_dev"), n).drop("_ref", "_dev", "value")


# -- fits --------------------------------------------------------------------------------------

def has_missing(df: DataFrame, keys: Sequence[str] = ("model", "scenario"), value: str = "value") -> DataFrame:
    """Key groups that contain a missing value."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("n_missing")).filter(F.col("n_missing") > 0)


def skip_missing(df: DataFrame, keys: Sequence[str] = ("model", "scenario"), value: str = "value") -> DataFrame:
    return df.join(settle(has_missing(df, keys, value).drop("n_missing"), "missing"), list(keys), "left_anti")


def bootstrap_draws(times: DataFrame, replicates: int = REPLICATES, scenario: str = "scenario",
                    year: str = "year", per_block: int = 10) -> DataFrame:
    """How often each replicate draws each (scenario, year), as (scenario, year, block, w0, w1, ..).

    Every scenario draws as many years as it has, with replacement and independently of the others.
    Draw i of replicate r is the year at position md5("b<r>-<scenario>-<i>") modulo n: reproducible on
    any engine and under any partitioning.
    """
    years = times.select(scenario, year).distinct()
    n = years.groupBy(scenario).agg(F.count("*").alias("_n"))
    pos = F.row_number().over(W.partitionBy(scenario).orderBy(year)) - 1
    placed = years.withColumn("_pos", pos.cast("bigint"))
    text = F.concat(F.lit("b"), F.col("replicate"), F.lit("-"), F.col(scenario), F.lit("-"), F.col("_i"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("_n")
    draws = n.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))) \
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1))) \
        .withColumn("_pos", draw)
    counts = draws.groupBy(scenario, "_pos", "replicate").agg(F.count("*").alias("w"))
    counts = counts.join(placed, [scenario, "_pos"])
    slots = [F.coalesce(F.max(F.when(F.col("replicate") % per_block == k, F.col("w"))), F.lit(0)).cast("double").alias(f"w{k}")
             for k in range(min(per_block, replicates))]
    block = F.floor(F.col("replicate") / per_block).cast("int").alias("block")
    return counts.groupBy(scenario, year, block).agg(*slots)


def bootstrap_ols(df: DataFrame, series: DataFrame, keys: Sequence[str] = ("variable", "model"),
                  replicates: int = REPLICATES, scenario: str = "scenario", year: str = "year",
                  value: str = "value", driver: str = "driver", per_block: int = 10) -> DataFrame:
    """Slope and intercept of value on the global series, per replicate and cell.

    Drawing with replacement is weighting.  Every cell of a complete series has the same weights and drivers, so the
    moments of the drivers are summed once per scenario, and a cell's rows only meet the draw matrix for their two
    products with it: sum(w y) and sum(w x y).  Rows are neither copied per draw nor per replicate, and scan tasks
    pre-aggregate to one row per cell and block of replicates.  Cells that lack rows of a year get moments of their own.
    A scenario with missing values is skipped for the variable and model that miss them only.
    A replicate that draws one driver value alone gets slope 0 and the mean, as least squares of least norm does.
    """
    state = settle(df.groupBy(*keys, scenario).agg(F.count_if(F.col(value).isNull()).alias("_missing")), "complete")
    used = state.filter("_missing = 0").drop("_missing")
    complete = df.join(used, [*keys, scenario], "left_semi")
    x = series.select(scenario, year, F.col(driver).cast("double").alias("_x"))
    width = min(per_block, replicates)
    draws = bootstrap_draws(x, replicates, scenario, year, per_block).join(x, [scenario, year])
    draws = settle(draws.withColumns({f"v{k}": F.col(f"w{k}") * F.col("_x") for k in range(width)}), "draws")

    def moments(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        sums = [a for k in range(width) for a in (F.sum(f"w{k}").alias(f"s{k}"), F.sum(f"v{k}").alias(f"x{k}"), F.sum(F.col(f"v{k}") * F.col("_x")).alias(f"xx{k}"))]
        return rows.groupBy(*by, "block").agg(*sums)

    per_scenario = moments(draws, [scenario])
    shared = used.join(per_scenario, scenario).groupBy(*keys, "block").agg(*[F.sum(f"{p}{k}").alias(f"{p}{k}") for k in range(width) for p in ("s", "x", "xx")])
    shared = settle(shared, "moments")
    # cells without a row for every year of their scenarios
    wanted = used.join(x.groupBy(scenario).agg(F.count("*").alias("_n")), scenario).groupBy(*keys).agg(F.sum("_n").alias("_wanted"))
    have = complete.join(x.select(scenario, year), [scenario, year], "left_semi").groupBy(*keys, "cell_id").agg(F.count("*").alias("_have"))
    partial = settle(have.join(wanted, list(keys)).filter(F.col("_have") != F.col("_wanted")).select(*keys, "cell_id"), "partial-cells")

    def products(rows: DataFrame) -> DataFrame:
        sums = [a for k in range(width) for a in (F.sum(F.col(f"w{k}") * F.col(value)).alias(f"y{k}"), F.sum(F.col(f"v{k}") * F.col(value)).alias(f"xy{k}"))]
        return rows.join(draws, [scenario, year]).groupBy(*keys, "cell_id", "block").agg(*sums)

    if partial.isEmpty():
        agg = products(complete).join(shared, [*keys, "block"])
    else:
        whole, rest = (complete.join(partial, [*keys, "cell_id"], how) for how in ("left_anti", "left_semi"))
        own = moments(rest.select(*keys, "cell_id", scenario, year).join(draws, [scenario, year]), [*keys, "cell_id"])
        both = products(rest).join(own, [*keys, "cell_id", "block"])
        agg = products(whole).join(shared, [*keys, "block"])
        agg = agg.unionByName(both.select(*agg.columns))
    fits = []
    for k in range(width):
        sw, sx, sy, sxx, sxy = (F.col(f"{p}{k}") for p in ("s", "x", "y", "xx", "xy"))
        spread = sw * sxx - sx * sx
        # rounding leaves about 1e-16 of the two terms where all draws are the same
        slope = F.when(F.abs(spread) <= 1e-13 * sw * sxx, F.lit(0.0)).otherwise(F.try_divide(sw * sxy - sx * sy, spread))
        fits.append(F.struct((F.col("block") * per_block + k).alias("replicate"), slope.alias("slope"),
                             F.try_divide(sy - slope * sx, sw).alias("intercept")))
    out = agg.select(*keys, "cell_id", F.inline(F.array(*fits)))
    return out.filter(F.col("replicate") < replicates)


def slope_through_origin(df: DataFrame, predictor: DataFrame, keys: Sequence[str] = ("variable", "cell_id"),
                         on: Sequence[str] = ("target",), x: str = "driver", value: str = "value") -> DataFrame:
    """Least squares without intercept per cell: sum(x*y) / sum(x*x) over the experiments."""
    joined = df.join(predictor.select(*on, F.col(x).alias("_x")), list(on))
    ok = F.col(value).isNotNull()
    slope = F.try_divide(F.sum(F.col("_x") * F.col(value)), F.sum(F.when(ok, F.col("_x") * F.col("_x"))))
    return joined.groupBy(*keys).agg(slope.alias("slope"))


# -- histograms --------------------------------------------------------------------------------

def histogram_equal(df: DataFrame, keys: Sequence[str], bins: int = 150, value: str = "value") -> DataFrame:
    """Equal-width bins over [min, max], right edge closed; shares of the counted total, empty bins kept."""
    v = F.col(value)
    span = df.filter(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    span = settle(span.select(*keys, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
                              F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b")), "span")
    width = (F.col("_b") - F.col("_a")) / bins
    edge = lambda i: F.when(i == bins, F.col("_b")).otherwise(F.col("_a") + i * width)
    guess = F.least(F.floor((v - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    # the scaled position can round across an edge: the edges themselves decide
    binned = df.filter(v.isNotNull()).join(span, list(keys)).withColumn("_g", guess)
    down, up = v < edge(F.col("_g")), (v >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1)
    binned = binned.withColumn("bin", F.when(down, F.col("_g") - 1).when(up, F.col("_g") + 1).otherwise(F.col("_g")))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = F.sum("n").over(W.partitionBy(*keys))
    full = frame.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
                       (F.col("n") / total).alias("frac"))


DAY_COUNT_EDGES = (1.0, 5.0, 10.0, 20.0, 50.0)  # the last bin is open to infinity


def histogram_edges(df: DataFrame, keys: Sequence[str], edges: Sequence[float] = DAY_COUNT_EDGES,
                    value: str = "value") -> DataFrame:
    """Fixed bins, the last one open; values below the first edge are not counted. Empty bins are kept.

    ``hi`` of the open bin is NULL.
    """
    v = F.col(value)
    bin_ = F.lit(None).cast("int")
    for i, lo in enumerate(edges):
        bin_ = F.when(v >= lo, F.lit(i)).otherwise(bin_)
    counts = df.filter(v.isNotNull()).withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    frame = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))))
    full = frame.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*keys))
    bounds = F.array(*[F.lit(float(e)) for e in edges], F.lit(None).cast("double"))
    return full.select(*keys, "bin", F.element_at(bounds, F.col("bin") + 1).alias("lo"),
                       F.element_at(bounds, F.col("bin") + 2).alias("hi"),
                       F.try_divide(F.col("n"), total).alias("frac"))


def histogram_arrays(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins of a histogram as two arrays, counts and edges (a histogram has at most a few hundred bins)."""
    rows = F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "frac")))
    return hist.groupBy(*keys).agg(rows.alias("_h")).select(
        *keys, F.col("_h.frac").alias("counts"),
        F.concat(F.col("_h.lo"), F.array(F.element_at("_h.hi", -1))).alias("bin_edges"))


# -- exact quantiles ---------------------------------------------------------------------------

def exact_median(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact median per key without gathering a key in one task.

    Distinct values are counted, range-partitioned by (key, value) and written with their partition
    number; only the partitions that hold the middle ranks are ranked row by row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = settle(counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
                    .withColumn("_part", F.spark_partition_id()), "ranks")
    per = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    order = W.partitionBy(*keys).orderBy("_part")
    per = per.withColumns({
        "_start": F.coalesce(F.sum("_in").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_in").over(W.partitionBy(*keys))})
    # 0-based middle ranks
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = (F.col("_start") <= high) & (F.col("_start") + F.col("_in") > low)
    wanted = per.filter(holds).select(*keys, "_part", "_start", low.alias("_low"), high.alias("_high"))
    run = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.join(wanted, [*keys, "_part"]).withColumn("_to", F.col("_start") + F.sum("_n").over(run))
    at = lambda r: F.max(F.when((F.col("_to") > r) & (F.col("_to") - F.col("_n") <= r), F.col(value)))
    return ranked.groupBy(*keys).agg(((at(F.col("_low")) + at(F.col("_high"))) / 2).alias(value))
