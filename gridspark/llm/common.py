"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python step handles at a time; a single longer text is a step of its own.
STEP_ROWS, STEP_BYTES = 512, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into steps of bounded rows and of at most ``most`` bytes of ``column`` (or one row)."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = np.zeros(len(sizes), np.int64)
        if len(sizes):
            import pyarrow.compute as pc
            lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, done + most, side="right"))
            to = min(max(to, at + 1), at + STEP_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def rank_in(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key`` (null: none), by a two-level search."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    all_of, some = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::width]))
    block = F.size(F.filter(some, lambda b: b <= key)) - 1
    fine = F.size(F.filter(F.slice(all_of, block * width + 1, F.lit(width)), lambda b: b <= key))
    return F.when(key.isNull() | (block < 0), F.lit(0)).otherwise(block * width + fine)


def order_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Values of ``key`` that cut the rows into about ``parts`` even ranges, from quantiles over all rows."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(1000, 20 * parts)).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def in_order(df: DataFrame, key: str, parts: int, ties: str | None = None) -> tuple[DataFrame, int]:
    """Rows dealt into ascending ranges of ``key``, sorted within each, with the range's number as ``_part``.

    Range i is partition i, and null keys come first.  A value of ``key`` lies in one range.
    """
    bounds = order_bounds(df, key, parts)
    dealt = df.withColumn("_part", rank_in(bounds, F.col(key)).cast("int")).repartitionById(len(bounds) + 1, F.col("_part"))
    return dealt.sortWithinPartitions("_part", key, *([ties] if ties else [])), len(bounds) + 1
