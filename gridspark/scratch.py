"""Written intermediate tables.

A reduced table (fits per cell, baselines, totals) that goes back onto a large one is written once and
read back.  That computes it once, survives lost executors, and gives Catalyst its true size from the
files: a small one becomes a broadcast join under ``spark.sql.autoBroadcastJoinThreshold``, a large one
a shuffle join with adaptive skew handling.  No operator forces a broadcast of data of unknown size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local_roots[app] = tempfile.mkdtemp(prefix="gridspark-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
