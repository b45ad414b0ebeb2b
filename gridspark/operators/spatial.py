"""Polygons, masks, countries and regridding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions.columns import lon_to_180, lon_wrap_180, population_lon
from gridspark.operators.align import blocked_product
from gridspark.scratch import settle

_LAT_BIN = 5.0
_LON_BIN = 10.0


def shift_lon(df: DataFrame, lon: str = "lon") -> DataFrame:
    return df.withColumn(lon, lon_to_180(lon))


def shift_population(population: DataFrame, lon: str = "lon") -> DataFrame:
    return population.withColumn(lon, population_lon(lon))


def point_in_polygon(cells: DataFrame, edges: DataFrame,
                     shift: Callable[[str], Column] = lon_to_180) -> DataFrame:
    """(region_id, region, cell_id) for the cell centres inside a (multi)polygon; holes count as outside.

    Even-odd rule per polygon part, with the half-open edge test (y1 > lat) <> (y2 > lat).  Instead of
    testing every cell against every edge: an edge meets only the grid latitudes of the latitude bins it
    spans, the sorted crossings of a part with one latitude pair up into inside intervals, and an
    interval meets only the cells of that latitude in the longitude bins it spans.
    """
    grid = cells.select("cell_id", "lat", shift("lon").alias("_lon"))
    rows = grid.select("lat").distinct().withColumn("_bin", F.floor(F.col("lat") / _LAT_BIN))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spans = edges.withColumn("_bin", F.explode(F.sequence(F.floor(low / _LAT_BIN), F.floor(high / _LAT_BIN))))
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    part = ["region_id", "region", "part_id", "lat"]
    crossings = spans.join(rows, "_bin").filter(crosses).select(*part, x.alias("x"))
    along = W.partitionBy(*part).orderBy("x")
    paired = crossings.withColumns({"_n": F.row_number().over(along), "_to": F.lead("x").over(along)})
    inside = paired.filter((F.col("_n") % 2 == 1) & (F.col("x") < F.col("_to")))
    lon_bin = F.sequence(F.floor(F.col("x") / _LON_BIN), F.floor(F.col("_to") / _LON_BIN))
    inside = inside.withColumn("_lbin", F.explode(lon_bin)).drop("_n", "part_id")
    binned = grid.withColumn("_lbin", F.floor(F.col("_lon") / _LON_BIN))
    hit = (F.col("_lon") >= F.col("x")) & (F.col("_lon") < F.col("_to"))
    return inside.join(binned, ["lat", "_lbin"]).filter(hit).select("region_id", "region", "cell_id").distinct()


def land_mask(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells inside any polygon."""
    return point_in_polygon(cells, edges).select("cell_id").distinct()


def region_mask(cells: DataFrame, edges: DataFrame, region: str) -> DataFrame:
    """Cells inside the polygons of one name."""
    return point_in_polygon(cells, edges.filter(F.col("region") == region)).select("cell_id").distinct()


def clip_to_land(df: DataFrame, land: DataFrame) -> DataFrame:
    """Keep land cells only: a masked cell never contributes, so its rows are dropped."""
    return df.join(land.select("cell_id").distinct(), "cell_id", "left_semi")


def assign_country(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cell -> region_id + 1, 0 where no polygon covers the cell; the lowest id wins where polygons overlap."""
    hits = point_in_polygon(cells, edges, lon_wrap_180)
    first = hits.groupBy("cell_id").agg((F.min("region_id") + 1).alias("country"))
    return cells.select("cell_id").join(first, "cell_id", "left").withColumn("country", F.coalesce("country", F.lit(0)))


def country_totals(df: DataFrame, countries: DataFrame, keys: Sequence[str] = ("year",), value: str = "value") -> DataFrame:
    """Sum per country and time, written back to every member cell; uncovered cells get 0.

    Totals are aggregated first and joined back, so one large country is never one task.
    """
    tagged = df.join(countries.select("cell_id", "country"), "cell_id")
    totals = tagged.filter(F.col("country") != 0).groupBy(*keys, "country") \
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_total"))
    back = tagged.join(settle(totals, "country-totals"), [*keys, "country"], "left")
    return back.withColumn(value, F.coalesce("_total", F.lit(0.0))).drop("_total")


# -- regridding --------------------------------------------------------------------------------

def axis_weights(source: DataFrame, target: DataFrame, periodic: float | None = None) -> DataFrame:
    """(dst, src, w): the one or two source points around each target point of one axis.

    ``source`` is (src, x) and ``target`` (dst, x).  With ``periodic`` the axis wraps around; otherwise a
    target outside the source range has no weights.

    The axis is cut into bins of even width, about as many as it has points.  Neighbours inside a bin come from a window
    over the bin; those in other bins from the ends of dyadic runs of bins, of which a target asks one per level.
    """
    points = source.select("x", "src")
    if periodic:
        ends = source.agg(F.min_by("src", "x").alias("s0"), F.min("x").alias("x0"),
                          F.max_by("src", "x").alias("s1"), F.max("x").alias("x1"))
        wrap = ends.select(F.inline(F.array(
            F.struct((F.col("x1") - periodic).alias("x"), F.col("s1").alias("src")),
            F.struct((F.col("x0") + periodic).alias("x"), F.col("s0").alias("src")))))
        points = points.unionByName(wrap.filter(F.col("src").isNotNull()))
    points = settle(points, "axis")
    low, high, n = points.agg(F.min("x"), F.max("x"), F.count("*")).first()
    levels = max(1, int(n).bit_length())
    last = (1 << levels) - 1
    share = (F.col("x") - F.lit(low)) / F.lit((high - low) or 1.0) if n else F.lit(0.0)
    bin_ = F.least(F.greatest(F.floor(share * (last + 1)), F.lit(0)), F.lit(last)).cast("long")
    here = F.struct(F.col("x").alias("x"), F.col("src").alias("src"))
    own = points.withColumn("_bin", bin_)
    asked = target.select("x", "dst").withColumn("_bin", bin_)
    # neighbours in the same bin
    both = own.select("_bin", "x", here.alias("_p"), F.lit(None).cast(target.schema["dst"].dataType).alias("dst")).unionByName(
        asked.select("_bin", "x", F.lit(None).cast(own.select(here.alias("p")).schema["p"].dataType).alias("_p"), "dst"))
    order = W.partitionBy("_bin").orderBy("x")
    near = both.withColumns({
        "_in_lo": F.last("_p", True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow)),
        "_in_hi": F.first("_p", True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing))}).filter(F.col("dst").isNotNull())
    # ends of runs of 2^level bins; the runs that make up all bins before (after) a bin, one per set (unset) digit
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    runs = own.withColumn("_level", level).groupBy("_level", F.expr("shiftright(_bin, _level)").alias("_run")).agg(F.min(here).alias("_first"), F.max(here).alias("_last"))
    bins = asked.select("_bin").distinct().withColumn("_level", level)
    digit = F.expr("shiftright(_bin, _level) & 1") == 1
    ask = bins.select("_bin", "_level", digit.alias("_before"), F.expr("shiftright(_bin, _level) ^ 1").alias("_run")).join(runs, ["_level", "_run"])
    carried = ask.groupBy("_bin").agg(F.max(F.when(F.col("_before"), F.col("_last"))).alias("_out_lo"), F.min(F.when(~F.col("_before"), F.col("_first"))).alias("_out_hi"))
    near = near.join(carried, "_bin", "left").select("dst", "x", F.coalesce("_in_lo", "_out_lo").alias("_lo"), F.coalesce("_in_hi", "_out_hi").alias("_hi"))
    near = near.filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    f = F.coalesce(F.try_divide(F.col("x") - F.col("_lo.x"), F.col("_hi.x") - F.col("_lo.x")), F.lit(0.0))
    pair = F.array(F.struct(F.col("_lo.src").alias("src"), (1 - f).alias("w")),
                   F.struct(F.col("_hi.src").alias("src"), f.alias("w")))
    return near.select("dst", F.inline(pair)).filter(F.col("w") > 0)


def even_axis(index: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """(src, x): evenly spaced replacement of an irregular axis, both ends included."""
    n = index.agg(F.max(key).alias("_n"))
    i = n.select(F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("src"), "_n")
    return i.select("src", (F.lit(low) + F.col("src") * F.try_divide(F.lit(high - low), F.col("_n"))).alias("x"))


def bilinear_regrid(df: DataFrame, cells: DataFrame, target_cells: DataFrame, keys: Sequence[str],
                    value: str = "value", period: float = 360.0, even: bool = False) -> DataFrame:
    """Rectilinear bilinear regrid, periodic in longitude; NULL where a needed source is missing or there is none.

    Every key of ``df`` gets a row for every target cell.

    The weights are separable: two short axis tables.  Every source value meets the (at most a few)
    target rows and columns that use it, and the weighted products are summed per target cell.
    """
    if even:
        src_lat = even_axis(cells, "lat_idx", -90.0, 90.0)
        src_lon = even_axis(cells, "lon_idx", 0.0, 360.0)
    else:
        src_lat = cells.select(F.col("lat_idx").alias("src"), F.col("lat").alias("x")).distinct()
        src_lon = cells.select(F.col("lon_idx").alias("src"), F.col("lon").alias("x")).distinct()
    dst_lat = target_cells.select(F.col("lat_idx").alias("dst"), F.col("lat").alias("x")).distinct()
    dst_lon = target_cells.select(F.col("lon_idx").alias("dst"), F.col("lon").alias("x")).distinct()
    lat_w = axis_weights(src_lat, dst_lat).select(F.col("src").alias("lat_idx"), F.col("dst").alias("_dlat"), F.col("w").alias("_wlat"))
    lon_w = axis_weights(src_lon, dst_lon, period).select(F.col("src").alias("lon_idx"), F.col("dst").alias("_dlon"), F.col("w").alias("_wlon"))
    weights = settle(
        cells.select("cell_id", "lat_idx", "lon_idx").join(lat_w, "lat_idx").join(lon_w, "lon_idx")
        .join(target_cells.select(F.col("lat_idx").alias("_dlat"), F.col("lon_idx").alias("_dlon"), F.col("cell_id").alias("_dst")), ["_dlat", "_dlon"])
        .select("cell_id", "_dst", (F.col("_wlat") * F.col("_wlon")).alias("_w")), "weights")
    # every key meets every target once without a source, so that none is left out
    frame = blocked_product(target_cells.select(F.col("cell_id").alias("_dst")).distinct(), df.select(*keys).distinct(), "_dst")
    frame = frame.select(*keys, "_dst", F.lit(0.0).alias("_w"), F.lit(None).cast("double").alias(value))
    parts = df.join(weights, "cell_id").select(*keys, "_dst", "_w", value).unionByName(frame)
    # a target is complete when its present sources carry the whole weight
    out = parts.groupBy(*keys, F.col("_dst").alias("cell_id")).agg(
        F.sum(F.col("_w") * F.col(value)).alias(value),
        F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))).alias("_have"))
    return out.withColumn(value, F.when(F.col("_have") > 1 - 1e-9, F.col(value))).drop("_have")
