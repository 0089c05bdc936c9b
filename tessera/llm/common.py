"""Shared folders, tables written to them, and file access inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.scratch import removed, scope, shared_path, stored

__all__ = ["filesystem", "removed", "schema_of", "scope", "shared_path", "stored", "table"]


def filesystem(path: str):
    """(pyarrow filesystem, path in it) for a URI as Spark gives it; used inside tasks to reach the shared folder. ``file:`` alone is local, as is a path without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def schema_of(df: DataFrame, keep, more: str) -> T.StructType:
    """df's fields of the names in keep, then the fields of a DDL string."""
    return T.StructType([*(df.schema[n] for n in keep), *T.StructType.fromDDL(more).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
