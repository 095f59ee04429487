"""The registry of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL.

    ``R2(x)`` (R0, R1, R4) in it is DuckDB's rounding of a sum or mean as a decimal of eight places; ``J2(x)`` is the
    domain's own rounding of a double, halves up.
    """

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _rounded(sql)
        return f

    return add


def _rounded(sql: str) -> str:
    for places in (0, 1, 2, 4):
        for kind in "RJ":
            mark = f"{kind}{places}("
            while (at := sql.find(mark)) >= 0:
                depth, i = 0, at + len(mark) - 1
                while True:
                    depth += {"(": 1, ")": -1}.get(sql[i], 0)
                    if not depth:
                        break
                    i += 1
                x = sql[at + len(mark) : i]
                shown = f"round(({x})::DECIMAL(38, 8), {places})::DOUBLE" if kind == "R" else f"(floor(({x}) * {10**places}.0::DOUBLE + 0.5::DOUBLE) / {10**places}.0::DOUBLE)"
                sql = f"{sql[:at]}{shown}{sql[i + 1 :]}"
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
