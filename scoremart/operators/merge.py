"""Union, de-duplication and assembly of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schemas import KEY, SCORE

_TOKEN_COLUMNS = ("tokens_trained", "train_batch_size")


def repair_token_types(df: DataFrame) -> DataFrame:
    """Token counts back to bigint: numbers are rounded half-even, text is read leniently."""
    for name in _TOKEN_COLUMNS:
        if name not in df.columns or df.schema[name].dataType == T.LongType():
            continue
        if isinstance(df.schema[name].dataType, T.NumericType):
            df = df.withColumn(name, F.bround(name).cast("bigint"))
        else:
            df = df.withColumn(name, F.col(name).try_cast("bigint"))
    return df


def conform(df: DataFrame) -> DataFrame:
    """Project to the score schema; missing columns become null, others are cast."""
    df = repair_token_types(df)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCORE.fields
        ]
    )


def union_diagonal(*tables: DataFrame) -> DataFrame:
    """Concatenate by column name after projecting every side to the score schema."""
    result = conform(tables[0])
    for table in tables[1:]:
        result = result.unionByName(conform(table))
    return result


def row_hash(rows: DataFrame) -> Column:
    """A hash of whole rows; maps, which have none, count as their sorted entries."""
    return F.xxhash64(*[_hashable(f) for f in rows.schema.fields])


def _hashable(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.MapType):
        return F.sort_array(F.map_entries(field.name))
    text = field.dataType.simpleString()
    return F.to_json(F.col(field.name)) if "map<" in text or "variant" in text else F.col(field.name)


def dedup_latest(rows: DataFrame, rank: str | None = None, keys: list[str] = KEY) -> DataFrame:
    """Latest row per key: latest date first, no date last, then higher ``rank``, then content.

    The order ends with a hash of the remaining columns, so that a repeated run chooses the same row.

    The rank filter runs before the exchange too (window group limit), so at most one row
    per key leaves a task and a key with very many copies is no hot spot.
    """
    order = [F.col("eval_date").desc_nulls_last()]
    if rank:
        order.append(F.col(rank).desc())
    named = [c for c in ("result_source", "score", "n_samples") if c in rows.columns]
    order += [F.col(c).desc_nulls_last() for c in named]
    order.append(row_hash(rows.drop("eval_date", *named, *keys)))
    latest = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def merge_and_dedup(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of two score tables with the latest row per key; on equal dates incoming wins."""
    both = conform(existing).withColumn("_rank", F.lit(0)).unionByName(
        conform(incoming).withColumn("_rank", F.lit(1))
    )
    return dedup_latest(both, "_rank").drop("_rank")


def sort_by_key(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in KEY])


def restrict_models(rows: DataFrame, models: DataFrame, benchmarks_only: bool = True) -> DataFrame:
    """Rows of the given models, by default only benchmark rows."""
    if benchmarks_only:
        rows = rows.filter("task_type = 'benchmark'")
    return rows.join(models.select("model").distinct(), "model", "left_semi")


def other_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    return rows.join(models.select("model").distinct(), "model", "left_anti")


def drop_stale_aggregates(rows: DataFrame) -> DataFrame:
    """Only benchmark rows; aggregates are computed afresh."""
    return rows.filter("task_type = 'benchmark'")


def preserve_foreign_aggregates(existing: DataFrame, models: DataFrame, fresh: DataFrame) -> DataFrame:
    """Aggregate rows of the run's models whose task name is not computed afresh."""
    aggregates = restrict_models(existing.filter("task_type <> 'benchmark'"), models, benchmarks_only=False)
    return aggregates.join(fresh.select("task").distinct(), "task", "left_anti")


def reclassify_suites(rows: DataFrame, suites: DataFrame) -> DataFrame:
    """Configured suites that were parsed as plain groups become suites."""
    names = suites.select(F.col("task"), F.lit(True).alias("_suite")).distinct()
    marked = rows.join(names, "task", "left")
    return marked.withColumn(
        "task_type",
        F.when(F.col("_suite") & (F.col("task_type") == "task_group"), F.lit("eval_suite")).otherwise(F.col("task_type")),
    ).select(*rows.columns)
