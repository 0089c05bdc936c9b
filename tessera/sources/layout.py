"""Index-like layouts: how a table is stored so that point, range and key look-ups read little of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_range_layout(df: DataFrame, path: str, *keys: str) -> None:
    """Files that each hold a range of the keys, sorted: row-group statistics then answer point and range selections on the first keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def write_hash_layout(df: DataFrame, name: str, buckets: int, *keys: str) -> None:
    """A bucketed and sorted catalog table: equality selections read one bucket, and joins of tables bucketed alike on their keys don't shuffle."""
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def warm(spark: SparkSession, name: str) -> None:
    """Keeps a catalog table in executor memory from its next use on."""
    spark.catalog.cacheTable(name)
