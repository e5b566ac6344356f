"""Score rows as plain Parquet, as a view, and in the exchange form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import iso_utc
from ..schemas import KEY, SCORE
from ..session import path_missing


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows below ``path``; a missing path is an empty table."""
    try:
        return spark.read.schema(SCORE).parquet(path)
    except Exception as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], SCORE)


def write_scores(scores: DataFrame, path: str) -> None:
    """Write in key order.

    The range exchange makes file statistics selective on the leading key columns and
    spreads a hot model over several files, which partitioning by model would not.
    """
    order = [F.col(c).asc_nulls_first() for c in KEY]
    scores.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def publish_view(scores: DataFrame, name: str = "scores") -> None:
    """Register the score table for ad-hoc SQL."""
    scores.createOrReplaceTempView(name)


def export_form(scores: DataFrame) -> DataFrame:
    """Exchange form: the subtask tree as JSON text, the evaluation date as ISO-8601 text."""
    return scores.withColumns(
        {"subtask_tree": F.to_json("subtask_tree"), "eval_date": iso_utc("eval_date")}
    )
