"""gridspark: gridded climate ensembles as long, typed, partitioned Spark DataFrames."""

from gridspark.session import build_session

__all__ = ["build_session"]
