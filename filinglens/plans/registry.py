"""Registry of the checked queries: a Spark plan and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None, complete: bool = False):
    """Register ``fn(tables) -> DataFrame`` under a name, with its oracle SQL.

    ``complete`` SQL brings its own view definitions.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if complete else with_views(sql, views)
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Rounded to six places, away from ties (the SQL side does the same)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 1e-9, 6)


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Comparable output: rounded doubles, text dates, joined string lists."""
    df = df.select(*columns) if columns else df
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = r6(c)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def R(expr: str) -> str:
    """SQL counterpart of ``r6``."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"


def S(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def TS(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"

