"""Registered queries: a Spark job and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `views` names the SQL views the twin reads."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            from rolewise.plans.sql_views import with_views

            ORACLES[name] = with_views(views.split(), sql)
        return function

    return register


def rounded(column: Column, digits: int = 6) -> Column:
    """Half-up rounding by the same double arithmetic as `sql_rounded`.

    The small constant sends exact ties and their neighbours the same way in
    both engines.
    """
    scale = float(10**digits)
    return F.floor(column * scale + 0.5000001) / scale


def sql_rounded(expression: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5000001::DOUBLE) / {scale})"


def day(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
