"""Queries with their SQL, and one form for results that two engines compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, lists as text, timestamps as text, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DoubleType | T.FloatType):
            c = F.round(c, 6)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("long")
        elif isinstance(kind, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
