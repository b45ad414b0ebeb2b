"""Gridded fields and products on Parquet.

A field is a set of Parquet files whose names, or whose ``file=<name>`` partition folders, follow the
dotted convention ``<case>.<member>.<component>.<h0|h1>.<field>.<from>-<to>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.schema import EXPERIMENT_LABELS
from gridspark.scratch import settle
from gridspark.sources import ledger

DAILY_MARK = "h1"
BASELINE_DAILY_START = "50101"  # only the daily baseline files that start there are complete
#: Members whose baseline files are used, daily and monthly.
BASELINE_DAILY_MEMBERS, BASELINE_MONTHLY_MEMBERS = ("001",), ("001", "002", "003")


def file_experiment(name: Column) -> Column:
    """Experiment of a dotted file name; the aliases of the two lower targets are crossed over."""
    out = F.lit(None).cast("string")
    for label, experiment in reversed(EXPERIMENT_LABELS):
        out = F.when(name.contains(label), F.lit(experiment)).otherwise(out)
    return out


def file_keys(df: DataFrame, name: str = "file") -> DataFrame:
    """Add experiment, member, field and span, taken from the file name by position from its end."""
    stem = F.regexp_replace(F.col(name), r"\.(nc|parquet)$", "")
    parts = F.split(stem, r"\.")
    return df.withColumns({
        "experiment": file_experiment(F.col(name)),
        "member": F.try_element_at(parts, F.lit(-5)),
        "field": F.try_element_at(parts, F.lit(-2)),
        "span": F.try_element_at(parts, F.lit(-1)),
    })


def scan_grid(spark: SparkSession, root: str, field: str, daily: bool, members: Sequence[str] | None = None) -> DataFrame:
    """Rows of one field and stream; other files are pruned by name and never opened.

    Of the baseline only ``members`` are kept (as stated above, if not given); other experiments keep all.
    """
    df = spark.read.parquet(root)
    if "file" not in df.columns:
        df = spark.read.schema(df.schema).option("pathGlobFilter", f"*.{field}.*").parquet(root) \
            .withColumn("file", F.col("_metadata.file_name"))
    name = F.col("file")
    df = df.filter(name.contains(f".{field}."))
    used = members if members is not None else BASELINE_DAILY_MEMBERS if daily else BASELINE_MONTHLY_MEMBERS
    member = F.try_element_at(F.split(F.regexp_replace(name, r"\.(nc|parquet)$", ""), r"\."), F.lit(-5))
    df = df.filter((file_experiment(name) != "baseline") | member.isin(list(used)))
    if daily:
        whole = (file_experiment(name) != "baseline") | name.contains(BASELINE_DAILY_START)
        return df.filter(name.contains(DAILY_MARK) & whole)
    return df.filter(~name.contains(DAILY_MARK))


def concat_time(parts: Sequence[DataFrame]) -> DataFrame:
    """Consecutive pieces of a field as one table; order lives in the time column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once (overlapping pieces)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def write_grid(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write a product partitioned by its keys, replacing only the partitions that are present.

    The rebalance hint lets adaptive execution split a large partition over many files and merge
    small ones.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, by: Sequence[str], buckets: int, label: str = "product") -> DataFrame:
    """Write a product as a table of ``buckets`` buckets by the hash of ``by``, its files sorted by them, and return it.

    Products that are bucketed alike join on these keys where they lie, without an exchange.  The table lies in the
    warehouse under a name of its own; rows of a bucket are one file, however many tasks there were.
    """
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def read_grid(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A written product; of one with a ledger the finished keys. With ``schema`` key labels such as "1.0" or "001" stay text."""
    rows = ledger.read(spark, path)
    if rows is None:
        rows = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return rows


def read_labels(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """A written product whose partition folders named in ``labels`` are text, whatever they look like."""
    rows = ledger.read(spark, path)
    if rows is not None:
        return rows
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in labels else f.dataType) for f in found])).parquet(path)


def write_scenario_dataset(quantities: dict[str, DataFrame], path: str) -> None:
    """Several scenario arrays of different rank as one long table, one partition per quantity."""
    dims = ["scenario", "config", "specie", "layer"]
    long = []
    for name, df in quantities.items():
        have = [F.col(d).cast("string") if d in df.columns else F.lit(None).cast("string") for d in dims]
        long.append(df.select(F.lit(name).alias("quantity"), *[c.alias(d) for c, d in zip(have, dims)],
                              F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value")))
    write_grid(reduce(DataFrame.unionByName, long), path, ["quantity"])


def write_coefs(coefs: DataFrame, path: str) -> None:
    write_grid(coefs, path, ["variable", "model"])


def read_coefs(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """All replicates of all models, stacked; one variable prunes to its partitions. Labels such as "001" stay text."""
    df = read_labels(spark, path, ["variable", "model"])
    return df.filter(F.col("variable") == variable) if variable is not None else df


def existing_keys(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Finished key combinations (typed as in ``like``) by the product's ledger, or None when there is nothing yet."""
    done = finished_keys(spark, path, like, keys)
    return done.select(*keys) if done is not None else None


def finished_keys(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys, commit, rows) of the finished keys."""
    return ledger.finished(spark, path, {k: like.schema[k].dataType for k in keys})


def materialize_missing(work: DataFrame, done: DataFrame | None, keys: Sequence[str], ignore_existing: bool = False) -> DataFrame:
    """The part of a work list whose products do not exist yet."""
    if done is None or ignore_existing:
        return work
    return work.join(done.select(*keys), list(keys), "left_anti")


#: Estimated rows of one commit of ``write_missing``.
BATCH_ROWS = 500_000_000


def write_missing(spark: SparkSession, work: DataFrame, path: str, keys: Sequence[str],
                  build: Callable[[DataFrame], DataFrame], ignore_existing: bool = False,
                  rows: Column | None = None, batch_rows: int = BATCH_ROWS) -> bool:
    """Build and write the missing products; false when there was nothing to do.

    The finished keys come from the product's ledger, not from its rows.  With ``rows``, an estimate of what a key
    of the work list gives, keys are built in batches of about ``batch_rows`` (or one key), each a commit of its own:
    a stopped run goes on behind the last one.  One writer at a time works on a product.
    """
    todo = materialize_missing(work, None if ignore_existing else existing_keys(spark, path, work, keys), keys)
    todo = settle(todo.select(*keys, (rows if rows is not None else F.lit(0)).cast("double").alias("_rows")).distinct(), "work")
    batches = _batches(todo, keys, batch_rows)
    for batch in batches:
        part = todo.join(batch, list(keys), "left_semi").select(*keys)
        ledger.commit(build(part), path, keys, part)
    return bool(batches)


def _batches(todo: DataFrame, keys: Sequence[str], batch_rows: int) -> list[DataFrame]:
    """The work list cut into parts of about ``batch_rows`` estimated rows, in the order of the keys.

    Running totals are formed within the first key, and the driver only sees the cuts.
    """
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(keys[0]).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    cut = settle(todo.withColumn("_cut", F.floor(before / batch_rows).cast("long")), "cuts")
    runs: list[list[tuple]] = []
    size = 0.0
    for r in cut.groupBy(keys[0], "_cut").agg(F.sum("_rows").alias("_rows")).orderBy(keys[0], "_cut").collect():
        if not runs or size + r["_rows"] > batch_rows:
            runs.append([])
            size = 0.0
        runs[-1].append((r[0], r["_cut"]))
        size += r["_rows"]
    hit = lambda run: reduce(Column.__or__, [F.col(keys[0]).eqNullSafe(F.lit(k)) & (F.col("_cut") == c) for k, c in run])
    return [cut.filter(hit(run)).select(*keys) for run in runs]
