"""Which keys of a product are finished, known without reading its rows.

A commit writes its rows below ``<keys>/commit=<id>`` and then one small file to ``_ledger``: for each key the number of
rows and the names and sizes of its files, and the columns' types.  A key is finished if its latest entry names only files that are there in
full, so what a stopped job left behind counts as missing and is never read.  Listing looks at file names and
sizes only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "_ledger"
COMMIT = "commit"


def _entries(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame | None:
    """(keys, commit, schema, rows, files) of all commits, or None before the first."""
    fields = [T.StructField(k, t) for k, t in types.items()]
    schema = T.StructType([*fields, T.StructField(COMMIT, T.StringType()), T.StructField("schema", T.StringType()), T.StructField("rows", T.LongType()),
                           T.StructField("files", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType())])))])
    try:
        return spark.read.schema(schema).json(f"{path}/{LEDGER}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def data_files(spark: SparkSession, path: str, below: str = "") -> DataFrame:
    """(name below the product's folder, size) of the data files, of all or of folders; their contents are not opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path + below)
    depth = len([x for x in path.split("/") if x and ":" not in x])
    parts = F.split(F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/+", ""), "/")
    # a store's authority (bucket, host) may or may not stand in the product's path
    own = F.slice(parts, F.greatest(F.lit(depth + 1), F.lit(1)), F.size(parts))
    keyed = F.filter(own, lambda x: x.contains("=") | x.endswith(".parquet"))
    return found.select(F.array_join(keyed, "/").alias("name"), F.col("length").alias("size"))


def finished(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame | None:
    """(keys, commit, rows) of the finished keys, or None before the first commit."""
    done = _finished(spark, path, types)
    return done.select(*types, COMMIT, "rows") if done is not None else None


def _finished(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame | None:
    entries = _entries(spark, path, types)
    if entries is None:
        return None
    keys = list(types)
    latest = entries.groupBy(*keys).agg(F.max_by(F.struct(COMMIT, "schema", "rows", "files"), COMMIT).alias("_e")).select(*keys, "_e.*")
    wanted = latest.select(*keys, COMMIT, F.explode("files").alias("_f")).select(*keys, COMMIT, "_f.name", "_f.size")
    try:
        torn = wanted.join(data_files(spark, path), ["name", "size"], "left_anti").select(COMMIT, *keys).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        torn = wanted.select(COMMIT, *keys).distinct()
    same = lambda k: F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    on = same(COMMIT)
    for k in keys:
        on = on & same(k)
    return latest.alias("a").join(torn.alias("b"), on, "left_anti")


def commit(df: DataFrame, path: str, keys: Sequence[str], expected: DataFrame, inner: Sequence[str] = ()) -> str:
    """Write ``df`` as one commit; every key of ``expected`` is finished by it, those without rows too.

    ``inner`` columns become folders below the commit, for pruning.
    """
    spark = df.sparkSession
    id_ = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    types = {k: expected.schema[k].dataType for k in keys}
    # the hint lets adaptive execution split a large partition over many files and merge small ones
    df.hint("rebalance", *keys, *inner).withColumn(COMMIT, F.lit(id_)).write.mode("append").partitionBy(*keys, COMMIT, *inner).parquet(path)
    label = lambda k: F.url_decode(F.replace(F.regexp_extract("name", f"(?:^|/){k}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    text = lambda names: [T.StructField(k, T.StringType()) for k in names]
    try:
        files = data_files(spark, path, "/" + "*/" * len(keys) + f"{COMMIT}={id_}")
        named = files.select(*[label(k).alias(k) for k in keys], F.struct("name", "size").alias("_f")).groupBy(*keys).agg(F.sort_array(F.collect_list("_f")).alias("files"))
        # row numbers stand in the files' footers
        columns = T.StructType([f for f in df.schema if f.name not in (*keys, *inner)] + text([*keys, COMMIT, *inner]))
        own = spark.read.schema(columns).option("basePath", path).parquet(path + "/" + "*/" * len(keys) + f"{COMMIT}={id_}")
        counts = own.groupBy(*keys).agg(F.count("*").alias("rows"))
    except AnalysisException as e:  # no rows at all
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = "array<struct<name:string,size:bigint>>"
        named = spark.createDataFrame([], T.StructType([*text(keys), T.StructField("files", T.DataType.fromDDL(files))]))
        counts = spark.createDataFrame([], T.StructType([*text(keys), T.StructField("rows", T.LongType())]))
    todo = expected.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    done = todo.join(named.join(counts, list(keys)), list(keys), "left").select(
        *[F.col(k).cast(t).alias(k) for k, t in types.items()], F.lit(id_).alias(COMMIT), F.lit(df.schema.json()).alias("schema"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("files", F.array().cast("array<struct<name:string,size:bigint>>")).alias("files"))
    done.coalesce(1).write.mode("append").json(f"{path}/{LEDGER}")
    return id_


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the finished keys, or None if the product has no ledger.

    Only their folders are opened, and the columns' types come from the ledger: labels such as "1.0" or "001" stay
    text, and what a stopped job left behind is not looked at.
    """
    if _entries(spark, path, {}) is None:
        return None
    keys = [c for c in spark.read.json(f"{path}/{LEDGER}").columns if c not in (COMMIT, "schema", "rows", "files")]
    done = _finished(spark, path, {k: T.StringType() for k in keys})
    folder = F.regexp_extract("name", f"^(.*{COMMIT}=[^/]*)/", 1)
    # the driver lists these folders in any case
    folders = sorted(r[0] for r in done.select(F.explode("files.name").alias("name")).select(folder).distinct().collect())
    schema = T.StructType.fromJson(json.loads(done.agg(F.max_by("schema", COMMIT)).first()[0] or _entries(spark, path, {}).first()["schema"]))
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    return rows.select(*[f.name for f in schema])
