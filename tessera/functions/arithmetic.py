"""Binary arithmetic: whole numbers divide towards zero, doubles by zero give infinities or NaN, strings add up by concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.verify import BadSemantic, kind, type_of


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def div_whole(a: Column, b: Column, result: str = "long") -> Column:
    """Towards zero, exact over all 64 bits; a zero divisor is an error under ANSI rules."""
    return F.call_function("div", a, b).cast(result)


def div_double(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, by_zero)


def divide(df: DataFrame, a: Column, b: Column) -> Column:
    """a / b by the types that they have over df: two ints give an int, other whole numbers a long, the rest doubles."""
    types = [type_of(df, x) for x in (a, b)]
    if any(kind(t) != "number" for t in types):
        raise BadSemantic("only numbers divide")
    names = {t.simpleString() for t in types}
    if names <= {"tinyint", "smallint", "int"}:
        return div_whole(a, b, "int")
    return div_whole(a, b) if names <= {"tinyint", "smallint", "int", "bigint"} else div_double(a, b)
