"""Row changes as DataFrames: what a table holds after an insert, a delete or an update, how many rows that affects, and how the result takes the table's place."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.verify import BadSemantic, fields_exist, kind, same_kind, term


def _hit(df: DataFrame, terms: Sequence[Column | tuple]) -> Column:
    return F.coalesce(reduce(and_, [term(df, t) for t in terms], F.lit(True)), F.lit(False))


def affected_rows(df: DataFrame, *terms: Column | tuple) -> DataFrame:
    """One row, n_rows: how many rows a delete or an update with these terms affects; without terms, all."""
    return df.where(_hit(df, terms)).agg(F.count("*").alias("n_rows"))


def insert_rows(df: DataFrame, fields: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """df and the rows; every column must be named, in any order; numbers are cast to their column's type, strings go to varchar columns only."""
    if sorted(fields) != sorted(df.columns):
        fields_exist(df, *fields)
        raise BadSemantic("an insert names every column once")
    for row in rows:
        if len(row) != len(fields):
            raise BadSemantic("an insert has a value for every field")
        for f, value in zip(fields, row):
            if value is not None and isinstance(value, str) != (kind(df.schema[f].dataType) == "varchar") and kind(df.schema[f].dataType) in ("varchar", "number"):
                raise BadSemantic(f"field {f} doesn't take {value!r}")
    new = df.sparkSession.createDataFrame([tuple(r) for r in rows], list(fields)) if rows else df.limit(0)
    return df.unionByName(new.select(*(F.col(f.name).cast(f.dataType) for f in df.schema)))


def delete_where(df: DataFrame, *terms: Column | tuple) -> DataFrame:
    """df without the rows for which all terms hold; without terms, nothing."""
    return df.where(~_hit(df, terms)) if terms else df.limit(0)


def update_where(df: DataFrame, values: Mapping[str, Column], *terms: Column | tuple) -> DataFrame:
    """df with new values where all terms hold. All values are taken from the row as it was, must be of the column's kind, and are cast to its type."""
    fields_exist(df, *values)
    for f, value in values.items():
        same_kind(df, F.col(f), value, f"field {f}")
    hit = _hit(df, terms)
    return df.select(*(F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in df.schema))


def publish(spark: SparkSession, name: str, df: DataFrame) -> int:
    """Makes df the content of the catalog table name, which df may read, and returns its row count.

    The new content is written whole beside the old one; then the table's location is switched, in one step of the
    catalog. A crash before it leaves the old content, one after it the new. The old files stay for queries that
    still read them, until whoever runs the warehouse removes them.
    """
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    version = f"{detail.rstrip('/').split('/_version-')[0]}/_version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
    spark.catalog.refreshTable(name)
    return spark.table(name).count()


def delete_from(spark: SparkSession, name: str, *terms: Column | tuple) -> int:
    """Deletes from a catalog table; returns how many rows went."""
    table = spark.table(name)
    n = affected_rows(table, *terms).first()[0]
    if n:
        publish(spark, name, delete_where(table, *terms))
    return n


def update(spark: SparkSession, name: str, values: Mapping[str, Column], *terms: Column | tuple) -> int:
    """Updates a catalog table; returns how many rows it affected."""
    table = spark.table(name)
    changed = update_where(table, values, *terms)
    n = affected_rows(table, *terms).first()[0]
    if n:
        publish(spark, name, changed)
    return n
