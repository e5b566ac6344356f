"""Joins on keys that may contain a null training step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key columns where null is a value ("no step").  All others use plain equality, which
#: keeps the cheaper hash keys.
NULL_SAFE = {"step"}


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which two null steps match; right-hand key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b,
        [
            F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k in NULL_SAFE else F.col(k) == F.col(f"_r_{k}")
            for k in keys
        ],
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys])
