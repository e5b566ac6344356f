"""Small control files of a run: manifest, task map, coverage, logs, queue snapshot.

Every reader keeps a ``run_id`` so that one job handles the control data of all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST_ENTRY
from ..session import path_missing
from .results import path_part, uri_part

# Queue states of a job that is not finished.
ACTIVE_STATES = ["PENDING", "RUNNING", "CONFIGURING", "COMPLETING"]

_DOC_COLUMNS = "run_id string, content string"
_LINE_COLUMNS = "run_id string, line string, line_order struct<path:string,block:bigint,seq:bigint>"


def _run_id() -> Column:
    """Control files live in ``{runs}/{run_id}/...``; the run is the directory of the file."""
    return uri_part(F.col("_metadata.file_path"), 2)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, content) of whole JSON control files; a missing file is an empty table."""
    try:
        raw = spark.read.format("binaryFile").load(path)
    except Exception as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], _DOC_COLUMNS)
    # The binary source opens a small file several times faster than the text source.
    return raw.select(path_part(F.col("path"), 2).alias("run_id"), F.col("content").cast("string").alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line, line_order) of log files; a missing file is an empty table.

    Ids grow along a partition, and a partition reads a file block in order, so
    (path, block start, id) sorts like the file without numbering lines globally.
    """
    try:
        raw = spark.read.text(path)
    except Exception as error:
        if not path_missing(error):
            raise
        return spark.createDataFrame([], _LINE_COLUMNS)
    return raw.select(
        _run_id().alias("run_id"),
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_order"),
    )


def manifest_rows(documents: DataFrame) -> DataFrame:
    """JSON object ``task_key -> entry`` to one row per job, in document order."""
    parsed = F.from_json("content", f"map<string, {MANIFEST_ENTRY.simpleString()}>")
    return documents.select("run_id", F.posexplode(F.map_entries(parsed)).alias("pos", "e")).select(
        "run_id", F.col("e.key").alias("task_key"), F.col("pos").cast("bigint").alias("pos"), "e.value.*"
    )


def task_map_rows(documents: DataFrame) -> DataFrame:
    """JSON object ``suite -> [task]`` to (run_id, suite, suite_pos, task, pos)."""
    parsed = F.from_json("content", "map<string, array<string>>")
    suites = documents.select("run_id", F.posexplode(F.map_entries(parsed)).alias("suite_pos", "e"))
    return suites.select(
        "run_id",
        F.col("e.key").alias("suite"),
        F.col("suite_pos").cast("bigint").alias("suite_pos"),
        F.posexplode("e.value").alias("pos", "task"),
    ).select("run_id", "suite", "suite_pos", "task", F.col("pos").cast("bigint").alias("pos"))


def covered_pairs(documents: DataFrame) -> DataFrame:
    """JSON object ``task_key -> [task]`` to (run_id, task_key, task)."""
    parsed = F.from_json("content", "map<string, array<string>>")
    return documents.select("run_id", F.explode(parsed).alias("task_key", "tasks")).select(
        "run_id", "task_key", F.explode("tasks").alias("task")
    )


def completed_keys(lines: DataFrame) -> DataFrame:
    """Distinct non-blank trimmed lines."""
    return (
        lines.select("run_id", F.regexp_replace("line", r"^\s+|\s+$", "").alias("task_key"))
        .filter("task_key <> ''")
        .distinct()
    )


def failed_jobs(lines: DataFrame) -> DataFrame:
    """Latest failure per job: key, date and time, reason, job id, free text.

    Lines with fewer than five fields are ignored; the last line of a job wins.
    """
    f = F.col("f")
    fields = lines.select(
        "run_id", "line_order", F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+").alias("f")
    ).filter(F.size("f") >= 5)
    parsed = fields.select(
        "run_id",
        "line_order",
        f[0].alias("task_key"),
        F.struct(
            F.concat_ws(" ", f[1], f[2]).alias("timestamp"),
            f[3].alias("reason"),
            f[4].alias("job_id"),
            F.array_join(F.slice("f", 6, F.size("f")), " ").alias("info"),
        ).alias("failure"),
    )
    return (
        parsed.groupBy("run_id", "task_key")
        .agg(F.max_by("failure", "line_order").alias("failure"))
        .select("run_id", "task_key", "failure.*")
    )


def queue_rows(documents: DataFrame) -> DataFrame:
    """Queue snapshot ``{"jobs": [...]}`` to (run_id, pos, name, job_id, states)."""
    schema = "jobs array<struct<name:string, job_id:variant, job_state:variant>>"
    jobs = documents.select("run_id", F.posexplode(F.from_json("content", schema)["jobs"]).alias("pos", "j"))
    state = F.col("j.job_state")
    return jobs.select(
        "run_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("j.name").alias("name"),
        F.try_variant_get("j.job_id", "$", "string").alias("job_id"),
        F.when(
            F.schema_of_variant(state).startswith("ARRAY"), F.try_variant_get(state, "$", "array<string>")
        )
        .otherwise(F.array(F.try_variant_get(state, "$", "string")))
        .alias("states"),
    )


def active_jobs(queue: DataFrame, job_name: str) -> DataFrame:
    """Unfinished jobs named ``{job_name}-{task_key}``; the state shown is the first one."""
    prefix = f"{job_name}-"
    return queue.filter(
        F.col("name").startswith(prefix)
        & (F.length("name") > len(prefix))
        & F.arrays_overlap("states", F.array(*[F.lit(s) for s in ACTIVE_STATES]))
    ).select(
        "run_id",
        "pos",
        F.substring("name", len(prefix) + 1, 2**31 - 1).alias("task_key"),
        "job_id",
        F.col("states")[0].alias("state"),
    )
