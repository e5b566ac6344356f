"""Registration of queries with their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Data, with_tables


@dataclass
class Query:
    build: Callable[[Data], DataFrame]
    check: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, check: str | None = None, **tables: str):
    """Register ``build(data)`` under ``name``; ``check`` is SQL over all derived tables.

    ``tables`` are further named tables the check may use.
    """

    def register(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, with_tables(check, **tables) if check else None)
        return build

    return register


def near(name: str) -> Column:
    """A computed score for comparison with its check.

    The order of sums is not fixed, so five digits are compared; the shift keeps exact
    half-way values, which are frequent in means of whole numbers, off the rounding boundary.
    """
    return F.round(F.col(name) + 0.000001, 5).alias(name)


def runner(build: Callable[[Data], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Data(spark, sf_dir))
