"""Helpers shared by the operators: shared storage, text batches, fresh names."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremart.session import scratch_path

#: Bytes of text that numpy code works on at a time; a longer document is taken alone.
PIECE_BYTES = 1 << 20


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_thread_each(spark: SparkSession) -> None:
    """Python workers multiply matrices in one thread, unless set otherwise: a task has one core, while numpy would start
    as many threads in each as the executor has cores, which wait for each other."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    return f"{stem}_{uuid.uuid4().hex[:12]}"


def parts_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """So many partitions that one holds about ``each`` bytes, and no fewer than the cluster can run at once."""
    return max(spark.sparkContext.defaultParallelism, math.ceil((total_bytes or 0) / each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def task_block_id(number: int) -> int:
    """An id for the ``number``-th block of this task; unique within one written table."""
    return (TaskContext.get().partitionId() << 33) + number


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one row): first row, end row, bytes, offsets."""
    data, offsets = binary_column(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
