"""Raw result files: ``{root}/{model_key}/{label}/{dir}/results_*.json``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT_FILE
from ..session import path_missing, scratch_path

RESULT_GLOB = "results_*.json"

#: Model directories that :func:`stage_result_files` lists and copies at a time.
MODELS_AT_ONCE = 4096

_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def path_part(path: Column, from_end: int) -> Column:
    """Directory name of a plain path, counted from the file, as it is."""
    return F.element_at(F.split(path, "/"), -from_end)


def uri_part(uri: Column, from_end: int) -> Column:
    """Directory name of a file URI, counted from the file, with percent escapes decoded."""
    return F.url_decode(F.replace(path_part(uri, from_end), F.lit("+"), F.lit("%2B")))


def _three_below(root: str) -> Column:
    """Files exactly three directories below ``root``."""
    below = re.sub(r"^\w+://?[^/]*", "", root).rstrip("/")
    return F.col("path").rlike(rf"\Q{below}\E(/[^/]+){{4}}$")


def _as_result_files(raw: DataFrame, root: str) -> DataFrame:
    """Files exactly three directories below ``root``, with the directory names as columns."""
    path = F.col("path")
    return raw.filter(_three_below(root)).select(
        path_part(path, 4).alias("model_key"),
        path_part(path, 3).alias("label"),
        path_part(path, 2).alias("dir"),
        "path",
        F.col("modificationTime").alias("mtime"),
        F.decode("content", "UTF-8").alias("content"),
    )


def scan_result_files(spark: SparkSession, root: str, glob: str = RESULT_GLOB) -> DataFrame:
    """One row per result file, whole content included.

    The binary source opens a file only when its content is used, so a query on path and
    time alone works on the listing.
    """
    try:
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(root)
        )
    except Exception as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], RESULT_FILE)
    return _as_result_files(raw, root)


def _listing_tasks(spark: SparkSession) -> int:
    """Tasks that list paths: some for each core, where Spark starts one for each path up to 10000, which costs it more than listing."""
    return min(int(spark.conf.get(_LISTING_TASKS)), 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def _few_tasks(spark: SparkSession) -> Iterator[None]:
    """Small files are listed by few tasks, and read by tasks that take many of them; no listing is kept for later queries."""
    wanted = {
        _LISTING_TASKS: _listing_tasks(spark),
        "spark.sql.files.openCostInBytes": 256 * 1024,
        "spark.sql.hive.filesourcePartitionFileCacheSize": 0,
    }
    held = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def _paths_in(spark: SparkSession, root: str) -> list[str]:
    """Paths directly below ``root`` that Spark's listing would follow, in order; none if it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop
    folder = hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    paths = hadoop.fs.FileUtil.stat2Paths(fs.listStatus(folder))
    if not len(paths):
        return []
    # As one text, parted by commas: paths that are asked for one by one are round trips.
    held = hadoop.mapred.JobConf(False)
    hadoop.mapred.FileInputFormat.setInputPaths(held, paths)
    found = re.findall(r"(?:\\.|[^,\\])+", held.getRaw(hadoop.mapreduce.lib.input.FileInputFormat.INPUT_DIR), re.DOTALL)
    names = {path: path.rpartition("/")[2] for path in (re.sub(r"(?s)\\(.)", r"\1", x) for x in found)}
    shown = lambda name: "=" in name or not name.startswith("_") or name.startswith(("_metadata", "_common_metadata"))
    return sorted(path for path, name in names.items() if shown(name) and not name.startswith(".") and not name.endswith("._COPYING_"))


def stage_result_files(spark: SparkSession, root: str, glob: str = RESULT_GLOB, models_at_once: int = MODELS_AT_ONCE) -> DataFrame:
    """The rows of :func:`scan_result_files` as a written table.

    The binary source holds its listing in the driver, and once more for each scan of a plan.  Model directories are listed
    and copied so many at a time, so the driver holds the files of these, and the names of all models.
    """
    models, copy = _paths_in(spark, root), scratch_path(spark, "result-files")
    if not models:
        return spark.createDataFrame([], RESULT_FILE)
    for start in range(0, len(models), models_at_once):
        with _few_tasks(spark):
            raw = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", True)
                .option("pathGlobFilter", glob)
                # Names of models are no patterns.
                .option("__globPaths__", "false")
                .load(models[start : start + models_at_once])
            )
            raw.filter(_three_below(root)).write.mode("append").parquet(copy)
    return _as_result_files(spark.read.schema(_BINARY_FILE).parquet(copy), root)


def stream_result_files(
    spark: SparkSession, root: str, glob: str = RESULT_GLOB, max_files: int = 10_000
) -> DataFrame:
    """The same rows as a stream that delivers every new file once.

    Each batch lists its files again, by tasks of which the session's settings say how many; they are set here, because a
    stream takes them from the session when it starts.
    """
    spark.conf.set(_LISTING_TASKS, _listing_tasks(spark))
    raw = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return _as_result_files(raw, root)


def superseded_paths(files: DataFrame) -> DataFrame:
    """Paths of files that a newer file of the same directory replaces (metadata only)."""
    keys = ["model_key", "label", "dir"]
    meta = files.select(*keys, "path", F.struct("mtime", "path").alias("age"))
    newest = meta.groupBy(*keys).agg(F.max("age").alias("newest"))
    return meta.join(newest, keys).filter("age < newest").select("path")


def latest_per_dir(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Newest file of every result directory that belongs to a manifest job.

    The choice runs on the listing.  The few superseded paths are then anti-joined, which
    leaves the documents unshuffled as long as that list is small enough to broadcast.
    """
    jobs = manifest.select("model_key", "label").distinct()
    of_jobs = files.join(jobs, ["model_key", "label"], "left_semi")
    return of_jobs.join(superseded_paths(of_jobs), "path", "left_anti").select(*files.columns)
