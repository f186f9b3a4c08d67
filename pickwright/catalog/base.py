"""Case registry and the common output shape of both engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    cols: str
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables hold times without a zone; both engines read them as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.fn(spark, sf_dir).select(*[_spark_col(c) for c in self.cols.split()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(_sql_col(c) for c in self.cols.split())} FROM ({self.sql}) q"


CASES: dict[str, Case] = {}


def case(name: str, cols: str, sql: str | None = None):
    """Register a query. ``cols`` lists ``column:kind``; kinds are l(ong), d(ouble, 6 digits
    or dN), s(tring), b(oolean), t (date as text), a (array of text)."""

    def deco(fn):
        if name in CASES:
            raise ValueError(f"duplicate case {name}")
        CASES[name] = Case(name, fn, cols, sql)
        return fn

    return deco


def _split(spec: str) -> tuple[str, str, int]:
    name, kind = spec.split(":")
    return name, kind[0], int(kind[1:] or 6)


def _spark_col(spec: str) -> Column:
    name, kind, digits = _split(spec)
    c = F.col(name)
    if kind == "d":
        # + 0.0 turns -0.0 into 0.0
        return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(name)
    if kind == "a":
        return F.array_join(c.cast("array<string>"), ",").alias(name)
    return c.cast({"l": "bigint", "s": "string", "b": "boolean", "t": "string"}[kind]).alias(name)


def _sql_col(spec: str) -> str:
    name, kind, digits = _split(spec)
    c = f'"{name}"'
    if kind == "d":
        return f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}"
    if kind == "a":
        return f"array_to_string({c}, ',') AS {c}"
    if kind == "t":
        return f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}"
    return f"CAST({c} AS {dict(l='BIGINT', s='VARCHAR', b='BOOLEAN')[kind]}) AS {c}"


def q(*parts: str) -> str:
    """Common table expressions and, last, the query."""
    *ctes, body = parts
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
