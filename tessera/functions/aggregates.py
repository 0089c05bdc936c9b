"""The six aggregates, named by rule: ``sumofx``, ``avgofx``, ``countofx``, ``dstcountofx``, ``minofx``, ``maxofx``.

Sums and averages are double and take numbers alone. Counts are long: an int would fail beyond 2**31 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """An aggregate over a field; ``numeric`` ones take numbers only."""

    field: str
    column: Column
    numeric: bool = False


def count(field: str) -> Aggregate:
    return Aggregate(field, F.count(field).alias(f"countof{field}"))


def count_distinct(field: str) -> Aggregate:
    return Aggregate(field, F.count_distinct(field).alias(f"dstcountof{field}"))


def total(field: str) -> Aggregate:
    return Aggregate(field, F.sum(F.col(field).cast("double")).alias(f"sumof{field}"), True)


def exact_total(field: str, scale: int = 2) -> Aggregate:
    """A sum of decimals, given as double: the same whatever the order of the rows, for values of at most ``scale`` decimals."""
    return Aggregate(field, F.sum(F.col(field).cast(f"decimal(18,{scale})")).cast("double").alias(f"sumof{field}"), True)


def average(field: str) -> Aggregate:
    return Aggregate(field, F.avg(F.col(field).cast("double")).alias(f"avgof{field}"), True)


def least(field: str) -> Aggregate:
    return Aggregate(field, F.min(field).alias(f"minof{field}"))


def greatest(field: str) -> Aggregate:
    return Aggregate(field, F.max(field).alias(f"maxof{field}"))
