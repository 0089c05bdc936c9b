"""Parquet tables, views over them, and the catalog's contents as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators.verify import BadSemantic
from tessera.sources.scratch import hadoop_path

#: The column types of the data model and the names they have there.
TYPE_NAMES = {"int": "int", "bigint": "long", "double": "double", "string": "varchar"}


_schemas: dict[str, tuple[tuple[int, int], T.StructType]] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A lazy scan; only the columns and row groups that a query needs are read.

    The schema is read from the files once and remembered for as long as the path's length and time of change stay,
    which saves a job for each further use.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    at = hadoop_path(spark, path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    stamp = (status.getLen(), status.getModificationTime())
    if _schemas.get(path, (None,))[0] != stamp:
        _schemas[path] = stamp, spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path][1]).parquet(path)


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet tables that lie in a folder, in order."""
    at = hadoop_path(spark, folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith(("_", ".")))


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """The tables, all of the folder's unless named, as temporary views, for spark.sql."""
    for name in names or table_names(spark, folder):
        read_table(spark, folder, name).createOrReplaceTempView(name)


def table_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """tblname of every table that lies in the folder."""
    return spark.createDataFrame([(t,) for t in table_names(spark, folder)], "tblname string")


def field_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """tblname, fldname and type of every field of the folder's tables, as their files have it; types outside the data model under their Spark names."""
    rows = [(t, f, TYPE_NAMES.get(kind, kind)) for t in table_names(spark, folder) for f, kind in read_table(spark, folder, t).dtypes]
    return spark.createDataFrame(rows, "tblname string, fldname string, type string")


class Views:
    """Named views over tables and other views; dropping a table drops the views that stand on it, however far."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables, self.made = dict(tables), {}

    def __getitem__(self, name: str) -> DataFrame:
        """A view's DataFrame if there is one of that name, else a table's."""
        return self.made[name][0] if name in self.made else self.tables[name]

    def create(self, name: str, build, *sources: str) -> DataFrame:
        """build gets the sources' DataFrames."""
        if name in self.made or name in self.tables:
            raise BadSemantic(f"{name} exists")
        self.made[name] = build(*(self[s] for s in sources)), sources
        return self[name]

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.made.pop(name, None)
        for view in [v for v, (_, sources) in self.made.items() if name in sources]:
            self.drop(view)
