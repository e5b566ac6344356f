"""Progress of runs, jobs and suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planning import suite_tasks

_JOB = ["run_id", "task_key"]


def suite_progress(manifest: DataFrame, task_map: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Per job and suite: tasks done on disk and listed, repeated tasks counted each time.

    Done pairs meet the suites that list their task; a suite a job has not begun is added
    from the run's suites, of which there are few.
    """
    listed = task_map.groupBy("run_id", "suite", "task").agg(F.count("*").alias("times"))
    done = (
        on_disk.select(*_JOB, "task").distinct()
        .join(listed, ["run_id", "task"])
        .groupBy(*_JOB, "suite")
        .agg(F.sum("times").alias("done"))
    )
    totals = listed.groupBy("run_id", "suite").agg(F.sum("times").alias("total"))
    suites = totals.groupBy("run_id").agg(F.collect_list(F.struct("suite", "total")).alias("suites"))
    return (
        manifest.select(*_JOB)
        .join(suites, "run_id")
        .select(*_JOB, F.inline("suites"))
        .join(done, [*_JOB, "suite"], "left")
        .select(*_JOB, "suite", F.coalesce("done", F.lit(0)).alias("done"), "total")
    )


def unique_progress(job_cover: DataFrame) -> DataFrame:
    """Per job: tasks on disk, tasks only in the shared table, unique tasks in total."""
    return job_cover.select(
        *_JOB, F.col("n_disk").alias("local"), F.col("n_shared_only").alias("shared_only"), F.col("n_expected").alias("total")
    )


def latest_job_per_key(active: DataFrame) -> DataFrame:
    """The last queue row of every job key."""
    last = active.groupBy(*_JOB).agg(F.max_by(F.struct("job_id", "state"), "pos").alias("j"))
    return last.select(*_JOB, "j.job_id", "j.state")


def active_jobs_of_run(manifest: DataFrame, active: DataFrame) -> DataFrame:
    """Queue rows with an id that belong to jobs of the run; what a cancel would address."""
    return active.filter("job_id is not null").join(manifest.select(*_JOB), _JOB, "left_semi")


def job_states(
    job_cover: DataFrame, completed: DataFrame, active: DataFrame, failed: DataFrame
) -> DataFrame:
    """State and info text per job: completed, then queued, then failed, else not started."""
    flag = lambda df, name: df.select(*_JOB).distinct().withColumn(name, F.lit(True))
    queue = latest_job_per_key(active).select(*_JOB, F.col("job_id").alias("q_id"), F.col("state").alias("q_state"))
    joined = (
        job_cover.join(flag(completed, "logged"), _JOB, "left")
        .join(queue, _JOB, "left")
        .join(failed.select(*_JOB, "reason"), _JOB, "left")
    )
    all_done = F.col("n_disk") + F.col("n_shared_only") == F.col("n_expected")
    state = (
        F.when(F.col("logged") | all_done, F.lit("completed"))
        .when(F.col("q_state") == "PENDING", F.lit("pending"))
        .when(F.col("q_state").isNotNull(), F.lit("running"))
        .when(F.col("reason").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("not_started"))
    )
    queued_text = F.when(F.col("q_state").isNotNull(), F.concat_ws(" ", "q_id", "q_state"))
    return joined.withColumn("state", state).select(
        *_JOB,
        "state",
        F.coalesce(queued_text, F.when(F.col("state") == "failed", F.col("reason")), F.lit("")).alias("info"),
        F.col("n_disk").alias("local"),
        F.col("n_shared_only").alias("shared_only"),
        F.col("n_expected").alias("total"),
    )


def status_rollup(states: DataFrame) -> DataFrame:
    """Per run: tasks done, remaining and percent, jobs per state."""
    done = F.sum(F.col("local") + F.col("shared_only"))
    total = F.sum("total")
    kinds = ["completed", "running", "pending", "failed", "not_started"]
    return states.groupBy("run_id").agg(
        done.alias("tasks_done"),
        (total - done).alias("tasks_remaining"),
        F.when(total > 0, done / total * 100).otherwise(F.lit(0.0)).alias("pct"),
        *[F.count_if(F.col("state") == k).alias(k) for k in kinds],
    )
