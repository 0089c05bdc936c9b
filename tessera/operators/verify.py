"""Checks of statements against schemas, before anything runs."""

from __future__ import annotations

from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BadSemantic(ValueError):
    """A statement that its tables' schemas don't allow."""


def fields_exist(df: DataFrame, *fields: str) -> None:
    """Each field is there, and once."""
    held = Counter(df.columns)
    for f in fields:
        if held[f] != 1:
            raise BadSemantic(f"field {f} does not exist" if not held[f] else f"field {f} is ambiguous")


def fields_disjoint(left: DataFrame, right: DataFrame) -> None:
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise BadSemantic(f"ambiguous fields: {', '.join(sorted(clash))}")


def kind(data_type: T.DataType) -> str:
    """``number``, ``varchar``, or a type's own name, which is comparable with itself alone."""
    return "number" if isinstance(data_type, T.NumericType) else "varchar" if isinstance(data_type, T.StringType) else data_type.simpleString()


def type_of(df: DataFrame, side: Column) -> T.DataType:
    """A side's type over df, whose fields it may use."""
    try:
        return df.select(side).schema[0].dataType
    except AnalysisException as error:
        raise BadSemantic(str(error).splitlines()[0]) from error


def same_kind(df: DataFrame, left: Column, right: Column, what: str) -> None:
    a, b = kind(type_of(df, left)), kind(type_of(df, right))
    if a != b:
        raise BadSemantic(f"{what}: {a} against {b}")


_COMPARED = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def side(value: Column | str | float) -> Column:
    """A column as it is; a field by its name; anything else as a constant. Strings that are constants go through ``F.lit``."""
    return value if isinstance(value, Column) else F.col(f"`{value}`") if isinstance(value, str) else F.lit(value)


def term(df: DataFrame, given: Column | tuple) -> Column:
    """A term of a predicate: a column, which must be a truth value over df, or (left, operator, right) of one kind."""
    if isinstance(given, Column):
        if not isinstance(type_of(df, given), T.BooleanType):
            raise BadSemantic("a term must be a comparison")
        return given
    left, operator, right = given
    if operator not in _COMPARED:
        raise BadSemantic(f"unknown operator {operator}")
    left, right = side(left), side(right)
    same_kind(df, left, right, operator)
    return _COMPARED[operator](left, right)
