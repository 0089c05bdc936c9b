"""``python -m tessera.console FOLDER``: SQL statements over the Parquet tables of a folder, one per line, until ``exit``."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from tessera.session import session
from tessera.sources.tables import register


def run_statement(spark: SparkSession, statement: str) -> Iterator[str]:
    """The lines that a statement gives: its columns, all its rows one partition after the other, and their number; or its error's first line."""
    try:
        df = spark.sql(statement.rstrip().rstrip(";"))
        if not df.columns:
            yield "done"
            return
        yield "\t".join(df.columns)
        n = 0
        for row in df.toLocalIterator():
            n += 1
            yield "\t".join(map(str, row))
        yield f"{n} records"
    except Exception as error:  # shown to whoever typed the statement
        yield str(error).splitlines()[0]


def main(folder: str) -> None:
    spark = session()
    register(spark, folder)
    for line in sys.stdin:
        if line.strip().lower() == "exit":
            break
        if line.strip():
            for out in run_statement(spark, line):
                print(out, flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
