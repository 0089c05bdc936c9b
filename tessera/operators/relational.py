"""Scans, projections, conjunctive selections, joins, grouping and sorting over DataFrames.

Each is a plain logical plan: Catalyst pushes filters and columns into the scans, orders and picks the joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregates import Aggregate
from tessera.operators.ordered import running_totals
from tessera.operators.verify import BadSemantic, fields_disjoint, fields_exist, kind, term

#: A side of a join is broadcast only if it has no more rows than this, and no more bytes as text.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

_STRATEGIES = {"merge": "merge", "hash": "shuffle_hash", "loop": "shuffle_replicate_nl", "broadcast": "broadcast"}


def project(df: DataFrame, *fields: str) -> DataFrame:
    """The set of fields, in alphabetical order; ``*`` stands for all."""
    chosen = {c for f in fields for c in (df.columns if f == "*" else [f])}
    fields_exist(df, *chosen)
    return df.select(*sorted(chosen))


def select(df: DataFrame, *terms: Column | tuple) -> DataFrame:
    """Rows for which all terms hold; without terms, all rows. A term is a column or (left, operator, right), as in ``verify.term``."""
    return df.where(reduce(and_, [term(df, t) for t in terms])) if terms else df


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row with each, for tables of which one is small. Fields must be disjoint."""
    fields_disjoint(left, right)
    return left.crossJoin(right)


def theta_join(left: DataFrame, right: DataFrame, *terms: Column | tuple) -> DataFrame:
    """Pairs for which all terms hold; equalities become hash or merge joins, the rest is filtered on them. Fields must be disjoint."""
    fields_disjoint(left, right)
    both = left.crossJoin(right)
    return left.join(right, reduce(and_, [term(both, t) for t in terms]), "inner")


def count_greater(left: DataFrame, by: str, field: str, right: DataFrame, other: str, name: str) -> DataFrame:
    """(by, name): over the rows of left with a value of by, how many pairs with a row of right have field < other; groups without pairs are left out.

    A theta join makes every pair only to count it. Here each side's distinct values are counted first, and running
    totals over ranges of values tell how many of right's lie above each of left's, so work grows with the rows.
    """
    fields_exist(left, by, field)
    fields_exist(right, other)
    low = left.where(F.col(field).isNotNull()).groupBy(F.col(by), F.col(field).alias("_v")).agg(F.count("*").alias("_n"))
    steps = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("_v")).agg(F.count("*").alias("_n"))
    steps = steps.unionByName(low.select("_v").distinct().withColumn("_n", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    ranked = running_totals(steps, "_v", "_n")
    pairs = low.join(ranked.select("_v", (F.col("_all") - F.col("_up_to")).alias("_above")), "_v").where("_above > 0")
    return pairs.groupBy(by).agg(F.sum(F.col("_n") * F.col("_above")).alias(name))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and so many bytes as JSON; reads no more than one row beyond."""
    held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return held[0] <= rows and held[1] <= size


def equi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], strategy: str | None = None) -> DataFrame:
    """Inner join on pairs of fields of one kind. strategy: None (Catalyst's choice), ``merge``, ``hash``, ``loop`` or ``broadcast``; the last two check the right side's size and leave the choice open beyond it."""
    fields_disjoint(left, right)
    for a, b in pairs:
        fields_exist(left, a)
        fields_exist(right, b)
        if kind(left.schema[a].dataType) != kind(right.schema[b].dataType):
            raise BadSemantic(f"{a} and {b} can't be compared")
    if strategy and (strategy not in ("broadcast", "loop") or small_enough(right)):
        right = right.hint(_STRATEGIES[strategy])
    return left.join(right, reduce(and_, [left[a] == right[b] for a, b in pairs]), "inner")


def group_by(df: DataFrame, fields: Sequence[str], *aggregates: Aggregate) -> DataFrame:
    """Groups with their aggregates. Without aggregates, the distinct groups; without fields, one row, but none if df is empty."""
    fields_exist(df, *fields, *(a.field for a in aggregates))
    for a in aggregates:
        if a.numeric and kind(df.schema[a.field].dataType) != "number":
            raise BadSemantic(f"{a.field} has no sum or average")
    if not aggregates:
        return df.select(*fields).distinct()
    columns = [a.column for a in aggregates]
    if fields:
        return df.groupBy(*fields).agg(*columns)
    return df.agg(*columns, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """By keys in order, which must be fields of df; a leading ``-`` means descending."""
    fields_exist(df, *(k.removeprefix("-") for k in keys))
    return df.orderBy(*(F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys))


def explain(df: DataFrame) -> DataFrame:
    """One row, ``query-plan``: the plan with Catalyst's size estimates, and how many rows it gives when run."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "cost")
    return df.sparkSession.createDataFrame([(f"{text}\nActual #recs: {df.count()}",)], "`query-plan` string")
