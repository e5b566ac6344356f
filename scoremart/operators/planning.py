"""Work planning: coverage, what to submit, batches.

Control tables carry ``run_id`` and all runs are planned together.  The expected tasks of a
run are one ordered array per run, as in the run's task-map document; jobs are compared with
that array inside their own row.  So the grid (jobs x tasks) is never materialised: done
tasks are distinct pairs, counts follow from them, and only remaining tasks are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import null_safe_join, suffix_class

_NONE = "array<string>"


# ── expected tasks ───────────────────────────────────────────────────────────────────


def suite_tasks(task_map: DataFrame) -> DataFrame:
    """(run_id, suite, suite_pos, tasks): the task list of a suite in order."""
    return task_map.groupBy("run_id", "suite").agg(
        F.min("suite_pos").alias("suite_pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "task"))), lambda t: t["task"]).alias("tasks"),
    )


def expected_tasks(task_map: DataFrame) -> DataFrame:
    """(run_id, expected): unique tasks of a run in first-seen order over its suites."""
    lists = suite_tasks(task_map)
    ordered = F.sort_array(F.collect_list(F.struct("suite_pos", "suite", "tasks")))
    return lists.groupBy("run_id").agg(
        F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["tasks"]))).alias("expected")
    )


def task_pairs(task_map: DataFrame) -> DataFrame:
    """Distinct (run_id, task)."""
    return task_map.select("run_id", "task").distinct()


def first_seen_tasks(task_map: DataFrame) -> DataFrame:
    """(run_id, task, suite, suite_pos, pos) of the first place each task is listed."""
    first = task_map.groupBy("run_id", "task").agg(F.min(F.struct("suite_pos", "pos", "suite")).alias("at"))
    return first.select("run_id", "task", "at.suite", "at.suite_pos", "at.pos")


def suite_task_counts(task_map: DataFrame) -> DataFrame:
    """Per suite: listed, new and duplicate tasks, duplicates against earlier suites included."""
    new = first_seen_tasks(task_map).groupBy("run_id", "suite").agg(F.count("*").alias("n_new"))
    listed = task_map.groupBy("run_id", "suite").agg(F.count("*").alias("n_listed"))
    n_new = F.coalesce("n_new", F.lit(0))
    return listed.join(new, ["run_id", "suite"], "left").select(
        "run_id", "suite", "n_listed", n_new.alias("n_new"), (F.col("n_listed") - n_new).alias("n_duplicate")
    )


def with_sort_class(tasks: DataFrame) -> DataFrame:
    """Add ``sort_class`` and ``sort_suffix``, by which request types stay together."""
    rank, suffix = suffix_class("task")
    return tasks.withColumns({"sort_class": rank, "sort_suffix": suffix})


def order_tasks(tasks: DataFrame) -> DataFrame:
    """Slow generation types first, then by suffix and name."""
    return with_sort_class(tasks).orderBy("sort_class", "sort_suffix", "task")


def dataset_groups(tasks: DataFrame) -> DataFrame:
    """(task, dataset): a blank dataset makes a task its own group, a missing one is unknown."""
    dataset = (
        F.when(F.col("dataset_path").isNull(), F.lit("__unknown__"))
        .when(F.col("dataset_path") == "", F.concat(F.lit("__custom__"), "task"))
        .otherwise(F.col("dataset_path"))
    )
    return tasks.select("task", dataset.alias("dataset"))


def dataset_group_sizes(tasks: DataFrame) -> DataFrame:
    """(dataset, n_tasks), largest first."""
    sizes = dataset_groups(tasks).groupBy("dataset").agg(F.count("*").alias("n_tasks"))
    return sizes.orderBy(F.desc("n_tasks"), "dataset")


# ── coverage ─────────────────────────────────────────────────────────────────────────


def covered_in_scores(manifest: DataFrame, task_map: DataFrame, scores: DataFrame) -> DataFrame:
    """(run_id, task_key, task): expected tasks a job already has in the score table.

    Any metric counts, null scores included.  The score table is reduced to distinct
    (model, step, task) before it meets the jobs.
    """
    present = scores.select(F.col("model").alias("model_key"), "step", "task").distinct()
    jobs = manifest.select("run_id", "task_key", "model_key", "step")
    found = null_safe_join(present, jobs, ["model_key", "step"], "inner")
    return found.join(task_pairs(task_map), ["run_id", "task"], "left_semi").select("run_id", "task_key", "task").distinct()


def covered_on_disk(manifest: DataFrame, task_map: DataFrame, disk: DataFrame) -> DataFrame:
    """(run_id, task_key, task): expected tasks with a local result, from (model_key, label, task)."""
    jobs = manifest.select("run_id", "task_key", "model_key", "label")
    found = disk.select("model_key", "label", "task").distinct().join(jobs, ["model_key", "label"])
    return found.join(task_pairs(task_map), ["run_id", "task"], "left_semi").select("run_id", "task_key", "task").distinct()


def coverage_document(covered: DataFrame) -> DataFrame:
    """(run_id, task_key, tasks) with sorted tasks, the exchange form of the coverage."""
    return covered.groupBy("run_id", "task_key").agg(F.sort_array(F.collect_set("task")).alias("tasks"))


def _n_expected(task_map: DataFrame) -> DataFrame:
    return task_pairs(task_map).groupBy("run_id").agg(F.count("*").alias("n_expected"))


def fully_covered_keys(covered: DataFrame, task_map: DataFrame, completed: DataFrame) -> DataFrame:
    """(run_id, task_key) covered in full and not yet logged as completed."""
    counts = covered.groupBy("run_id", "task_key").agg(F.count_distinct("task").alias("n"))
    return (
        counts.join(_n_expected(task_map), "run_id")
        .filter("n = n_expected")
        .select("run_id", "task_key")
        .join(completed, ["run_id", "task_key"], "left_anti")
    )


def job_coverage(
    manifest: DataFrame, task_map: DataFrame, on_disk: DataFrame, shared: DataFrame
) -> DataFrame:
    """Per job: tasks expected, on disk, and only in the shared table.

    ``on_disk`` and ``shared`` are (run_id, task_key, task); both are counted in one
    pre-aggregated pass, disk taking precedence.
    """
    expected = task_pairs(task_map)
    side = lambda df, disk: df.select("run_id", "task_key", "task", F.lit(disk).alias("disk"))
    marks = side(on_disk, True).unionByName(side(shared, False)).join(expected, ["run_id", "task"], "left_semi")
    per_task = marks.groupBy("run_id", "task_key", "task").agg(F.bool_or("disk").alias("disk"))
    counts = per_task.groupBy("run_id", "task_key").agg(
        F.count_if("disk").alias("n_disk"), F.count_if(~F.col("disk")).alias("n_shared_only")
    )
    zero = F.lit(0).cast("bigint")
    return (
        manifest.join(_n_expected(task_map), "run_id", "left")
        .join(counts, ["run_id", "task_key"], "left")
        .withColumns(
            {
                "n_expected": F.coalesce("n_expected", zero),
                "n_disk": F.coalesce("n_disk", zero),
                "n_shared_only": F.coalesce("n_shared_only", zero),
            }
        )
    )


def coverage_counts(job_cover: DataFrame) -> DataFrame:
    """Per run: total, on disk, shared only, jobs covered, jobs remaining."""
    done = F.col("n_disk") + F.col("n_shared_only") == F.col("n_expected")
    return job_cover.groupBy("run_id").agg(
        F.sum("n_expected").alias("total"),
        F.sum("n_disk").alias("on_disk"),
        F.sum("n_shared_only").alias("shared_only"),
        F.count_if(done).alias("jobs_covered"),
        F.count_if(~done).alias("jobs_remaining"),
    )


def run_summary(job_cover: DataFrame) -> DataFrame:
    """Per run: jobs, tasks per job, tasks on disk and shared, jobs and tasks to evaluate."""
    counts = coverage_counts(job_cover)
    jobs = job_cover.groupBy("run_id").agg(F.count("*").alias("jobs"), F.max("n_expected").alias("tasks_per_job"))
    return jobs.join(counts, "run_id").select(
        "run_id",
        "jobs",
        "tasks_per_job",
        "on_disk",
        "shared_only",
        F.col("jobs_remaining").alias("jobs_to_evaluate"),
        (F.col("total") - F.col("on_disk") - F.col("shared_only")).alias("tasks_to_evaluate"),
    )


def locally_complete_keys(job_cover: DataFrame, completed: DataFrame) -> DataFrame:
    """Jobs covered by disk and shared table together that are not logged as completed."""
    return (
        job_cover.filter("n_expected > 0 and n_disk + n_shared_only = n_expected")
        .select("run_id", "task_key")
        .join(completed, ["run_id", "task_key"], "left_anti")
    )


# ── selection and batches ────────────────────────────────────────────────────────────


def keys_to_submit(
    manifest: DataFrame,
    completed: DataFrame,
    active: DataFrame,
    only: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Jobs neither completed nor in the queue, in manifest order.

    ``only(run_id, task_key)`` restricts the choice; names that are no job are an error.
    ``limit`` is the user's cap on jobs per cycle, for each run by itself.
    """
    keys = ["run_id", "task_key"]
    if only is not None:
        unknown = only.join(manifest, keys, "left_anti").select("task_key").limit(5).collect()
        if unknown:
            raise ValueError(f"unknown task keys: {', '.join(r['task_key'] for r in unknown)}")
    open_jobs = manifest.join(completed, keys, "left_anti").join(active, keys, "left_anti")
    if only is not None:
        open_jobs = open_jobs.join(only, keys, "left_semi")
    if limit:
        first = Window.partitionBy("run_id").orderBy("pos", "task_key")
        open_jobs = open_jobs.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= limit).drop("_rn")
    return open_jobs.orderBy("run_id", "pos")


def submit_summary(manifest: DataFrame, completed: DataFrame, active: DataFrame) -> DataFrame:
    """(run_id, measure, n): jobs in total, completed, queued per state, queued, to submit."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias("n")).select(
        "run_id", F.lit(name).alias("measure"), "n"
    )
    queued = active.join(manifest.select("run_id", "task_key"), ["run_id", "task_key"], "left_semi")
    per_state = queued.groupBy("run_id", F.concat(F.lit("queued "), F.lower("state")).alias("measure")).agg(
        F.count("*").alias("n")
    )
    keys = queued.groupBy("run_id").agg(F.count_distinct("task_key").alias("n"))
    return (
        count(manifest, "total")
        .unionByName(count(completed, "completed"))
        .unionByName(per_state)
        .unionByName(keys.select("run_id", F.lit("in queue").alias("measure"), "n"))
        .unionByName(count(keys_to_submit(manifest, completed, active), "to submit"))
    )


def remaining_tasks(
    manifest: DataFrame, task_map: DataFrame, on_disk: DataFrame, shared: DataFrame
) -> DataFrame:
    """(run_id, task_key, remaining): per job the ordered tasks still to evaluate.

    The done list of a job is at most its run's task list, because done pairs are reduced to
    distinct expected ones first.
    """
    pairs = on_disk.select("run_id", "task_key", "task").unionByName(shared.select("run_id", "task_key", "task"))
    done = (
        pairs.join(task_pairs(task_map), ["run_id", "task"], "left_semi")
        .groupBy("run_id", "task_key")
        .agg(F.collect_set("task").alias("done"))
    )
    return (
        manifest.select("run_id", "task_key")
        .join(expected_tasks(task_map), "run_id")
        .join(done, ["run_id", "task_key"], "left")
        .select(
            "run_id",
            "task_key",
            F.array_except("expected", F.coalesce("done", F.array().cast(_NONE))).alias("remaining"),
        )
    )


def batch_size(n: Column, parallel: int, batch: int) -> Column:
    """1 when every task gets its own slot, else capped so that all slots are filled."""
    return F.when(n <= parallel, F.lit(1)).otherwise(F.least(F.lit(batch), F.ceil(n / parallel).cast("int")))


def plan_batches(remaining: DataFrame, parallel: int, batch: int) -> DataFrame:
    """(run_id, task_key, batch_no, tasks): consecutive chunks of each job's remaining tasks.

    The chunks are cut inside the row of the job, without exchange or sort.
    """
    n = F.size("remaining")
    sized = remaining.filter(n > 0).withColumn("eff", batch_size(n, parallel, batch))
    starts = F.sequence(F.lit(1), n, F.col("eff"))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("remaining", i, F.col("eff")), ","))
    return sized.select("run_id", "task_key", F.posexplode(chunks).alias("batch_no", "tasks"))
