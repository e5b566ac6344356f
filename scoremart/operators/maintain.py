"""Table maintenance: compaction of result files, deletes, dimension updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY
from .parse import is_sentinel

# Document sections merged per (task, key), and per task.
DEEP_SECTIONS = ["results", "higher_is_better"]
FLAT_SECTIONS = ["group_subtasks", "configs", "versions", "n-shot", "n-samples", "task_hashes"]

_CHECKPOINT = ["model_key", "label"]
COMPACTED_DIR = "compacted"
_BATCH_DIR = r"^batch_(\d+)_\d+$"


# ── compaction ───────────────────────────────────────────────────────────────────────


def safe_files(files: DataFrame, active_job_ids: DataFrame) -> DataFrame:
    """Files outside batch directories of unfinished jobs; ``active_job_ids(job_id)``."""
    ids = active_job_ids.select(F.col("job_id").cast("string").alias("_job")).distinct()
    job = F.when(F.col("dir").rlike(_BATCH_DIR), F.regexp_extract("dir", _BATCH_DIR, 1))
    return files.withColumn("_job", job).join(ids, "_job", "left_anti").select(*files.columns)


def _task_entries(files: DataFrame) -> DataFrame:
    """Documents as (model_key, label, mtime, path, task, entries): all sections of a task, and all file-level fields, in one row."""
    parsed = F.from_json("content", "map<string,variant>")
    docs = files.select(*_CHECKPOINT, "mtime", "path", F.explode(F.array(parsed)).alias("d")).filter("d is not null")
    empty = F.create_map().cast("map<string,variant>")
    as_map = lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty)
    per_task = lambda e: e["key"].isin(DEEP_SECTIONS + FLAT_SECTIONS)
    sections = F.transform(F.filter(F.map_entries("d"), per_task), lambda e: F.struct(e["key"].alias("section"), as_map(e["value"]).alias("tasks")))
    fields = F.transform(F.filter(F.map_entries("d"), lambda e: ~per_task(e)), lambda e: F.struct(e["key"].alias("section"), e["value"].alias("v")))
    # Evaluated once per document, like the parse.
    split = docs.select(*_CHECKPOINT, "mtime", "path", F.explode(F.array(F.struct(sections.alias("sections"), fields.alias("fields")))).alias("d"))
    names = F.array_distinct(F.flatten(F.transform("d.sections", lambda s: F.map_keys(s["tasks"]))))
    tasks = split.select("*", F.explode(F.concat(names, F.array(F.lit(None).cast("string")))).alias("task"))
    of_task = F.transform(
        F.filter("d.sections", lambda s: F.map_contains_key(s["tasks"], F.col("task"))),
        lambda s: F.struct(s["section"].alias("section"), s["tasks"][F.col("task")].alias("v")),
    )
    return tasks.select(*_CHECKPOINT, "mtime", "path", "task", F.when(F.col("task").isNull(), F.col("d.fields")).otherwise(of_task).alias("entries"))


def _long_entries(files: DataFrame) -> DataFrame:
    """Documents as (model_key, label, mtime, path, section, task, key, value), with a checkpoint's rows of a task in one place."""
    # Tasks meet before their keys become rows: names, time and path are exchanged once per task, not with every key.
    gathered = _task_entries(files).repartition(*_CHECKPOINT, "task")
    per_task = gathered.select(*_CHECKPOINT, "mtime", "path", "task", F.explode("entries").alias("t"))
    empty = F.create_map().cast("map<string,variant>")
    as_map = lambda v: F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty)
    is_deep = F.col("t.section").isin(DEEP_SECTIONS)
    no_key = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))
    # An empty task object still names the task, hence the entry without a key; it carries the
    # value of a task that is no object.
    is_object = F.coalesce(F.schema_of_variant("t.v").startswith("OBJECT"), F.lit(False))
    plain = F.struct(F.lit(None).cast("string").alias("key"), F.col("t.v").alias("value"))
    deep = F.concat(
        F.transform(F.map_entries(as_map(F.col("t.v"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        F.array(F.when(is_object, no_key).otherwise(plain)),
    )
    flat = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("t.v").alias("value")))
    per_key = per_task.select(
        *_CHECKPOINT, "mtime", "path", "t.section", "task", F.explode(F.when(is_deep, deep).otherwise(flat)).alias("k")
    )
    sentinel = (F.col("section") == "results") & F.coalesce(is_sentinel(F.col("k.key"), F.col("k.value")), F.lit(False))
    return per_key.filter(~sentinel).select(*_CHECKPOINT, "mtime", "path", "section", "task", "k.key", "k.value")


def compact_entries(files: DataFrame) -> DataFrame:
    """One value per (model_key, label, section, task, key): that of the newest file.

    File-level fields have neither task nor key.  Sentinels never take part, so an older
    real value stays.  A checkpoint's files meet per task, so one with very many files is
    spread over its tasks.  This long form is the compacted table.
    """
    return (
        _long_entries(files)
        .groupBy(*_CHECKPOINT, "section", "task", "key")
        .agg(F.max_by(F.struct("value"), F.struct("mtime", "path")).alias("newest"))
        .select(*_CHECKPOINT, "section", "task", "key", "newest.value")
    )


def compact_documents(entries: DataFrame) -> DataFrame:
    """(model_key, label, content): the compacted entries as one JSON document per checkpoint.

    Each task's texts are put together where its entries are, and exchanged once, by checkpoint.
    """
    obj = lambda entries_: F.concat(
        F.lit("{"),
        F.array_join(F.transform(entries_, lambda e: F.concat(_quoted(e["name"]), F.lit(": "), e["json"])), ", "),
        F.lit("}"),
    )
    merged = entries.groupBy(*_CHECKPOINT, "section", "task").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", F.to_json("value").alias("json")))))).alias("m"),
        F.max(F.when(F.col("key").isNull(), F.to_json("value"))).alias("plain"),
    )
    # Keys win over a plain value: both mean that files disagree, and merging keeps the object.
    deep = F.when((F.size("m") == 0) & F.col("plain").isNotNull(), F.col("plain")).otherwise(
        obj(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("json"))))
    )
    json = F.when(F.col("section").isin(DEEP_SECTIONS), deep).otherwise(F.coalesce("plain", F.lit("null")))
    per_task = merged.groupBy(*_CHECKPOINT, "task").agg(F.collect_list(F.struct("section", json.alias("json"))).alias("sections"))
    gathered = per_task.repartition(*_CHECKPOINT).select(*_CHECKPOINT, "task", F.explode("sections").alias("s"))
    sections = gathered.groupBy(*_CHECKPOINT, "s.section").agg(
        F.sort_array(F.collect_list(F.when(F.col("task").isNotNull(), F.struct(F.col("task").alias("name"), "s.json")))).alias("tasks"),
        F.max(F.when(F.col("task").isNull(), F.col("s.json"))).alias("field"),
    )
    named = F.struct(F.col("section").alias("name"), F.coalesce("field", obj(F.col("tasks"))).alias("json"))
    return sections.groupBy(*_CHECKPOINT).agg(obj(F.sort_array(F.collect_list(named))).alias("content"))


def _quoted(name: Column) -> Column:
    """JSON string literal of a name."""
    return F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r'^\{"n":(.*)\}$', 1)


def compact_report(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Per checkpoint: tasks in the merged result and directories it replaces.

    Checkpoints that consist of the compacted directory alone have nothing to do.
    """
    dirs = (
        files.filter(F.col("dir") != COMPACTED_DIR)
        .groupBy(*_CHECKPOINT)
        .agg(F.count_distinct("dir").alias("dirs_superseded"))
    )
    tasks = entries.filter("section = 'results'").groupBy(*_CHECKPOINT).agg(F.count_distinct("task").alias("tasks_merged"))
    return dirs.join(tasks, _CHECKPOINT, "left").select(
        *_CHECKPOINT, F.coalesce("tasks_merged", F.lit(0)).alias("tasks_merged"), "dirs_superseded"
    )


# ── deletes ──────────────────────────────────────────────────────────────────────────


def invalid_rows() -> Column:
    """Fixed rule: rows of known-broken benchmarks."""
    task = F.col("task")
    return (
        (F.contains(task, F.lit("arc_challenge")) & (F.col("language") == "eng"))
        | F.contains(task, F.lit("gsm_symbolic"))
        | F.contains(task, F.lit("humaneval_fim"))
    )


def drop_rows(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows without those that satisfy the predicate; an unknown outcome keeps the row."""
    return rows.filter(~F.coalesce(predicate, F.lit(False)))


def drop_rows_preview(rows: DataFrame, predicate: Column) -> DataFrame:
    """Distinct (model, step, task, metric) that would go, in order."""
    keys = ["model", "step", "task", "metric"]
    return rows.filter(predicate).select(*keys).distinct().orderBy(*[F.col(c).asc_nulls_first() for c in keys])


def drop_rows_counts(rows: DataFrame, predicate: Column) -> DataFrame:
    """One row: rows before, dropped, after."""
    hit = F.coalesce(predicate, F.lit(False))
    return rows.agg(
        F.count("*").alias("before"), F.count_if(hit).alias("dropped"), F.count_if(~hit).alias("after")
    )


# ── dimension updates ────────────────────────────────────────────────────────────────


def display_name_mapping(entries: DataFrame) -> DataFrame:
    """(model, new_name) from ``entries(file, pos, model_key, display_name)``; the last entry wins."""
    usable = entries.filter("coalesce(model_key, '') <> '' and coalesce(display_name, '') <> ''")
    return usable.groupBy(F.col("model_key").alias("model")).agg(
        F.max_by("display_name", F.struct("file", "pos")).alias("new_name")
    )


def renamed_models(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(model, new_name, current_name) of models with at least one differing row.

    The current name is that of the first differing row in key order.
    """
    return (
        rows.select(*KEY, "model_display_name")
        .join(mapping, "model")
        .filter(F.col("model_display_name") != F.col("new_name"))
        .groupBy("model", "new_name")
        .agg(F.min(F.struct(*KEY[1:], "model_display_name"))["model_display_name"].alias("current_name"))
    )


def sync_dimension(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Overwrite the display name in every row of models that have a mismatch."""
    renamed = renamed_models(rows, mapping).select("model", "new_name")
    return (
        rows.join(renamed, "model", "left")
        .withColumn("model_display_name", F.coalesce("new_name", "model_display_name"))
        .select(*rows.columns)
    )


def sync_dimension_preview(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per renamed model: current and new name and the number of all its rows."""
    counts = rows.groupBy("model").agg(F.count("*").alias("affected_rows"))
    return renamed_models(rows, mapping).join(counts, "model").select(
        "model", "current_name", "new_name", "affected_rows"
    )
