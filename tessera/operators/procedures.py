"""Stored procedures: Python callables by number that run DataFrame work, change tables and give one row back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.changes import publish


class ManualAbort(Exception):
    """Raised by a procedure to give up."""


@dataclass
class Procedures:
    """A procedure takes (spark, changes, *arguments) and returns a DataFrame of at most one row, or None.

    It puts the new content of catalog tables into the dict ``changes``, by name.
    """

    known: dict[int, Callable[..., DataFrame | None]] = field(default_factory=dict)

    def register(self, number: int, procedure: Callable[..., DataFrame | None]) -> None:
        self.known[number] = procedure

    def call(self, spark: SparkSession, number: int, *arguments) -> tuple[bool, DataFrame | None]:
        """(committed, result). The changes are published when the procedure has ended well, one table after the other; one that gives up or fails has changed nothing. Errors are raised."""
        if number not in self.known:
            raise KeyError(f"no stored procedure {number}")
        changes: dict[str, DataFrame] = {}
        try:
            result = self.known[number](spark, changes, *arguments)
        except ManualAbort:
            return False, None
        if result is not None and len(result.take(2)) > 1:
            raise ValueError(f"stored procedure {number} gave more than one row")
        for name, df in changes.items():
            publish(spark, name, df)
        return True, result
