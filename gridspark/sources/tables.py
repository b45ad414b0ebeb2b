"""Scenario, parameter, observation, polygon and population tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridspark.functions.columns import known, population_lon
from gridspark.scratch import settle

_POINTS = "array<array<double>>"
_SPECIES_FLAGS = ("greenhouse_gas", "aerosol_chemistry_from_emissions", "aerosol_chemistry_from_concentration")
_SPECIES_TEXT = ("specie", "type", "input_mode")


def _number(c: str) -> Column:
    return known(F.col(c).try_cast("double")).alias(c)


def scan_scenario_wide(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Wide scenario CSV: scenario, region, variable, unit and one double column per year."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnsRenamed({c: c.lower() for c in raw.columns})
    years = [c for c in raw.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    return raw.select("scenario", "region", "variable", "unit", *[_number(c) for c in years])


def scan_config_params(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Parameter ensemble CSV; the first (possibly unnamed) column is the config label."""
    raw = spark.read.csv(path, header=True)
    first = key or raw.columns[0]
    return raw.select(F.col(f"`{first}`").alias("config"), *[_number(c) for c in raw.columns if c != first])


def scan_species(spark: SparkSession, path: str, requested: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Species property CSV: 0/1 flags become booleans, nan becomes NULL; optionally a subset."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnRenamed(raw.columns[0], "specie")
    cols = []
    for c in raw.columns:
        if c in _SPECIES_TEXT:
            cols.append(F.col(c))
        elif c in _SPECIES_FLAGS:
            cols.append((F.col(c).try_cast("double") != 0).alias(c))
        else:
            cols.append(_number(c))
    out = raw.select(*cols)
    if requested is None:
        return out
    if isinstance(requested, DataFrame):
        return out.join(requested.select("specie"), "specie", "left_semi")
    return out.filter(F.col("specie").isin(list(requested)))


def scan_natural_forcing(spark: SparkSession, solar: str, volcanic: str, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, t, volcanic, solar) from (*keys, year, erf) and (*keys, timebounds, erf).

    There is no volcanic forcing past the end of its file (with ``keys``, of the key's rows in it); other times that only
    one file has keep NULL, and so do keys that only the solar file has.
    """
    def series(path: str, time: str, name: str) -> DataFrame:
        raw = spark.read.csv(path, header=True)
        return raw.select(*keys, F.col(time).try_cast("double").alias("t"), F.col("erf").try_cast("double").alias(name))

    eruptions = series(volcanic, "timebounds", "volcanic")
    both = eruptions.join(series(solar, "year", "solar"), [*keys, "t"], "full_outer")
    if keys:
        ends = eruptions.groupBy(*keys).agg(F.max("t").alias("_end"))
        past = both.join(ends, list(keys), "left")
        return past.withColumn("volcanic", F.when(F.col("t") > F.col("_end"), F.lit(0.0)).otherwise(F.col("volcanic"))).drop("_end")
    end = eruptions.agg(F.max("t")).first()[0]
    return both if end is None else both.withColumn("volcanic", F.when(F.col("t") > end, F.lit(0.0)).otherwise(F.col("volcanic")))


def scan_ws_table(spark: SparkSession, path: str | Sequence[str], columns: dict[str, str],
                  first: str = "Timestamp", years: tuple[int, int] | None = None) -> DataFrame:
    """Whitespace-separated tables with a header line: the wanted columns, renamed, with the file name.

    Every file has its own header, recognised by its first word, so columns may stand elsewhere in each.  Blank lines go.
    A file without a header, or whose header lacks a column, is an error.
    """
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), words.alias("w")) \
        .filter(F.element_at("w", 1) != "")
    heads = lines.filter(F.element_at("w", 1) == first).groupBy("file").agg(F.first("w").alias("_h"))
    files = lines.select("file").distinct().join(heads, "file", "left")
    lacking = files.withColumn("_m", F.filter(F.array(*map(F.lit, columns)), lambda c: ~F.coalesce(F.array_contains("_h", c), F.lit(False))))
    wrong = lacking.filter(F.size("_m") > 0).first()
    if wrong is not None:
        raise ValueError(f"{wrong['file']}: no header line starting with {first!r} has the columns {wrong['_m']}")
    rows = lines.filter(F.element_at("w", 1) != first).join(heads, "file")
    cell = lambda name: F.try_element_at("w", F.array_position("_h", name).cast("int")).try_cast("double")
    rows = rows.select("file", F.element_at("w", 1).try_cast("int").alias("year"), *[cell(c).alias(out) for c, out in columns.items()])
    return rows.filter(F.col("year").between(*years)) if years else rows


def scan_commented_text(spark: SparkSession, path: str, columns: Sequence[str] = ("year", "value"), mark: str = "%") -> DataFrame:
    """Whitespace-separated numbers below comment lines; the leading columns are kept, NaN becomes NULL."""
    text = F.trim("value")
    words = F.split(text, r"\s+")
    rows = spark.read.text(path).filter(~text.startswith(mark) & (text != "")).select(words.alias("w"))
    out = rows.select(*[known(F.try_element_at("w", F.lit(i + 1)).try_cast("double")).alias(c) for i, c in enumerate(columns)])
    return out.withColumn(columns[0], F.col(columns[0]).cast("int"))


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the features of GeoJSON documents as texts, numbered from 0 in each, read by many tasks.

    A document is cut at closing braces, so that its blocks are read like those of any text.  What a piece does to the
    state of the reader, inside or outside a string and how deep in brackets, is a small map for either start; the maps
    of whole blocks are composed over the blocks, and pieces are only ordered within their block.  A feature is what lies
    three brackets deep (document, list, feature) and says that it is one.
    """
    here = ["file", "block"]
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    raw = raw.withColumns({"_out": F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), ""), "_in": F.array_join(F.filter(parts, lambda x, i: i % 2 == 1), ""),
                           "flips": (F.size(parts) - 1) % 2})
    count = lambda c, signs: F.length(c) - F.length(F.translate(c, signs, ""))
    deeper = lambda c: count(c, "{[") - count(c, "]")
    # what a piece adds to the depth if it starts outside (inside) a string; its brace counts if it ends outside
    raw = raw.withColumns({"open0": deeper(F.col("_out")), "open1": deeper(F.col("_in"))}).drop("_out", "_in")
    rows = settle(raw, "pieces")
    order = W.partitionBy(*here).orderBy("i")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    by_state = lambda start, odd: F.when((F.col(start) + F.lit(odd)) % 2 == 0, F.col("open0") - (1 - F.col("flips"))).otherwise(F.col("open1") - F.col("flips"))
    flipped = rows.withColumn("_flips", total("flips"))
    blocks = flipped.groupBy(*here).agg(F.sum("flips").alias("flips"), F.sum(by_state("_flips", 0)).alias("d0"), F.sum(by_state("_flips", 1)).alias("d1"))
    along = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_state", F.coalesce(F.sum("flips").over(along), F.lit(0)) % 2)
    blocks = blocks.withColumn("_depth0", F.coalesce(F.sum(F.when(F.col("_state") == 0, F.col("d0")).otherwise(F.col("d1"))).over(along), F.lit(0)))
    placed = flipped.join(settle(blocks.select(*here, "_state", "_depth0"), "blocks"), here)
    placed = placed.withColumn("_s", (F.col("_flips") + F.col("_state")) % 2)
    opens = F.when(F.col("_s") == 0, F.col("open0")).otherwise(F.col("open1"))
    closes = ((F.col("_s") + F.col("flips")) % 2 == 0).cast("int")
    placed = placed.withColumns({"_opens": opens, "_step": opens - closes})
    placed = placed.withColumn("_depth", F.col("_depth0") + total("_step"))
    placed = placed.withColumn("_starts", ((F.col("_depth") < 3) & (F.col("_depth") + F.col("_opens") >= 3)).cast("int"))
    begin = F.when(F.col("_depth") == 2, F.locate("{", F.col("value"))).otherwise(_last_opening(F.col("value"), F.col("_depth")))
    text = F.when(F.col("_starts") == 1, F.substring("value", begin, F.length("value"))).when(F.col("_depth") >= 3, F.col("value"))
    placed = placed.withColumns({"_text": text, "_seen": F.sum("_starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    pieces = settle(placed.filter(F.col("_text").isNotNull()).select(*here, "i", "_starts", "_seen", "_text"), "feature-pieces")
    starts = pieces.groupBy(*here).agg(F.sum("_starts").alias("_n"))
    starts = starts.select(*here, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    own = pieces.join(settle(starts, "starts"), here).withColumn("number", F.col("_before") + F.col("_seen") - 1)
    texts = own.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "i", "_text"))).alias("_t"))
    texts = settle(texts.select("file", "number", F.concat(F.array_join("_t._text", "}"), F.lit("}")).alias("text")), "features")
    is_feature = F.coalesce(F.get_json_object("text", "$.type") == "Feature", F.lit(False))
    # other objects as deep, such as a coordinate system's, don't count; there are hardly any
    others = texts.filter(~is_feature).groupBy("file").agg(F.collect_list("number").alias("_others"))
    out = texts.filter(is_feature).join(settle(others, "other-objects"), "file", "left")
    number = F.col("number") - F.coalesce(F.size(F.filter("_others", lambda n: n < F.col("number"))), F.lit(0))
    return out.select("file", F.when(F.col("_others").isNull(), F.col("number")).otherwise(number).cast("int").alias("number"), "text")


def _last_opening(value: Column, depth: Column) -> Column:
    """Place (from 1) of the last brace outside strings that leads from two brackets deep to three; for the few first pieces."""
    start = F.struct(F.lit(1).alias("at"), depth.cast("int").alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(1).alias("found"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        outside = ~s["inside"]
        down = outside & c.isin("{", "[")
        return F.struct((s["at"] + 1).alias("at"), (s["depth"] + down.cast("int") - (outside & c.isin("}", "]")).cast("int")).alias("depth"),
                        F.when(quote, ~s["inside"]).otherwise(s["inside"]).alias("inside"), (s["inside"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
                        F.when(outside & (c == "{") & (s["depth"] == 2), s["at"]).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["found"])


def scan_regions(spark: SparkSession, path: str, name: str = "name", lines: bool = False) -> DataFrame:
    """GeoJSON polygons as edges: region_id, region, part_id, ring_id, x1, y1, x2, y2.

    Documents are read in blocks by many tasks, and a feature's number is its place in its document; ``lines`` reads one
    feature per line instead, with its number in the property ``region_id``.
    """
    properties, geometry = f"struct<`{name}`:string,region_id:int>", "struct<type:string,coordinates:string>"
    if lines:
        f = spark.read.schema(f"properties {properties}, geometry {geometry}").json(path) \
            .select(F.col("properties.region_id").alias("region_id"), F.struct("properties", "geometry").alias("f"))
    else:
        f = scan_features(spark, path).select(F.col("number").alias("region_id"), F.from_json("text", f"properties {properties}, geometry {geometry}").alias("f"))
    shape = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, f"array<{_POINTS}>"))) \
        .otherwise(F.from_json(shape, f"array<array<{_POINTS}>>"))
    parts = f.select("region_id", F.col("f.properties").getField(name).alias("region"), F.posexplode(polygons).alias("part_id", "rings"))
    rings = parts.select("region_id", "region", "part_id", F.posexplode("rings").alias("ring_id", "points"))
    p = F.col("points")
    edges = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.struct(
        p[i - 1][0].alias("x1"), p[i - 1][1].alias("y1"), p[i][0].alias("x2"), p[i][1].alias("y2")))
    return rings.filter(F.size(p) > 1).select("region_id", "region", "part_id", "ring_id", F.inline(edges))


def scan_population(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Population raster (lon, lat, persons), stored half a turn away, as persons per cell."""
    raster = spark.read.parquet(path).select(
        F.round(population_lon("lon"), 4).alias("_lon"), F.round("lat", 4).alias("_lat"), "persons")
    grid = cells.select("cell_id", F.round("lon", 4).alias("_lon"), F.round("lat", 4).alias("_lat"))
    return grid.join(raster, ["_lon", "_lat"]).select("cell_id", "persons")
