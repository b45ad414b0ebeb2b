"""Operator 3: shards by extendible hashing, with DataFrame functions only.

A bucket is a prefix of the bits of a key's hash.  A bucket over the byte limit is split on one more bit, others stay
as they are; the directory maps prefixes of some length to their buckets.  As a bucket holds no more than its parent,
the shards are the shortest prefixes within the limit.  They are found from sums of bytes per prefix, for a range of
depths at once; only rows of buckets that are still too large are aggregated for the next range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.scratch import settle

#: Bits of a hash, bytes of a shard at most, and bits of a directory at most.
BITS, LIMIT, DIRECTORY_BITS = 60, 1 << 20, 24


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 (a null key: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _bits(h: str, depth: str) -> Column:
    return F.expr(f"shiftright({h}, cast({BITS} - {depth} as int))")


def with_buckets(sized: DataFrame, limit: int) -> DataFrame:
    """Rows (_h, n_bytes, ...) with ``_b`` (depth, bytes, docs), null where all bits of the hash don't suffice."""
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    low, step = 0, min(DIRECTORY_BITS, 6 + max(0, math.ceil(math.log2(max(1, total / limit)))))
    left, done = sized, []
    while True:
        high = min(BITS, low + step)
        cell = _bits("_h", str(high))
        cells = left.groupBy(cell.alias("_cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
        nodes = cells.select("_cell", "b", "c", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_depth"))
        nodes = nodes.withColumn("_node", F.expr(f"shiftright(_cell, {high} - _depth)"))
        fitting = nodes.groupBy("_depth", "_node").agg(F.sum("b").alias("bytes"), F.sum("c").alias("docs")).filter(F.col("bytes") <= limit)
        found = nodes.select("_cell", "_depth", "_node").join(fitting, ["_depth", "_node"]) \
            .groupBy("_cell").agg(F.min(F.struct(F.col("_depth").alias("depth"), "bytes", "docs")).alias("_b"))
        found = settle(cells.select("_cell").join(found, "_cell", "left"), "directory")
        rows = left.withColumn("_cell", cell).join(found, "_cell").drop("_cell")
        over = not found.filter(F.col("_b").isNull()).isEmpty()
        if over and high < BITS:
            done.append(rows.filter(F.col("_b").isNotNull()))
            left, low = rows.filter(F.col("_b").isNull()).drop("_b"), high + 1
            continue
        for part in done:
            rows = rows.unionByName(part)
        return rows


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs) of every row; ``shard`` spells the bucket's bits.

    ``n_bytes`` are the UTF-8 bytes of the text (null: 0).  Rows with equal keys share a bucket; where they alone exceed
    the limit, they go to pages of it, each within the limit, numbered by row size and input partition, so that no task
    has to count all of them.  A row that exceeds the limit by itself has a page of its own.  Null keys hash as empty
    strings; other columns are ignored; an empty table gives no rows.
    """
    sized = docs.select(F.col(key).alias("_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        key_hash(F.col(key)).alias("_h"), F.spark_partition_id().alias("_from"))
    rows = with_buckets(sized, limit)
    spelt = F.lpad(F.bin("_h"), BITS, "0")
    inside = rows.filter(F.col("_b").isNotNull()).select(
        F.col("_key").alias(key), "n_bytes", F.substring(spelt, F.lit(1), F.col("_b.depth")).alias("shard"), "_b.depth",
        F.col("_b.bytes").alias("shard_bytes"), F.col("_b.docs").alias("shard_docs"))
    alike = Window.partitionBy("_h", "n_bytes", "_from")
    room = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
    over = rows.filter(F.col("_b").isNull()).withColumn("_page", F.expr(f"(row_number() over (partition by _h, n_bytes, _from order by _h) - 1) div greatest(1, {limit} div greatest(n_bytes, 1))"))
    held = F.least(room, F.count("*").over(alike) - F.col("_page") * room)
    pages = over.select(
        F.col("_key").alias(key), "n_bytes", F.concat(spelt, F.lit("/"), F.concat_ws(".", "n_bytes", "_from", "_page")).alias("shard"),
        F.lit(BITS).alias("depth"), (held * F.col("n_bytes")).alias("shard_bytes"), held.alias("shard_docs"))
    return inside.unionByName(pages)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write ``docs`` (unique, non-null keys) to one folder per shard."""
    shards = assign_shards(docs, limit, key).select(F.col(key).alias("_k"), "shard")
    rows = docs.join(shards, docs[key] == shards["_k"]).drop("_k")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = LIMIT, key: str = "doc_id") -> str:
    """The same shards of ``documents`` in SQL (keys few enough per shard that bits suffice)."""
    return f"""
with s as (select {key}, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, cast('0x' || substr(md5(cast({key} as varchar)), 1, 15) as bigint) as h from documents),
n as (select d, h >> ({BITS} - d) as p, sum(n_bytes) as b, count(*) as c from s, (select unnest(range(0, {BITS + 1})) as d) group by all),
f as (select s.{key}, s.n_bytes, s.h, n.d, n.b, n.c, row_number() over (partition by s.{key} order by n.d) as r
      from s join n on n.p = (s.h >> ({BITS} - n.d)) where n.b <= {limit})
select {key}, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, cast(d as int)) as shard, cast(d as int) as depth, cast(b as bigint) as shard_bytes, c as shard_docs
from f where r = 1"""
