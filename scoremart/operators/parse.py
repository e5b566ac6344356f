"""Nested result documents to score rows.

A document is exploded to tasks and these to metrics; facts are columns of the exploded rows, so that
a query pays for those it uses alone.  Nothing is shuffled: a document yields its rows where it was read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_display_name, detect_language
from ..schemas import RESULT_DOC, SCORE
from .lenient import counts_as_nothing, is_nested, kind, number, plain_text, rejects, truth_value, whole_number

# Evaluation output type -> task formulation.
FORMULATIONS = {
    "multiple_choice": "rank_choice",
    "loglikelihood_rolling": "bits_per_byte",
    "generate_until": "generative",
}

_TREE = "map<string,array<string>>"


# ── small expressions on one metric entry ────────────────────────────────────────────


def metric_name(key: Column) -> Column:
    return F.split(key, ",", 2)[0]


def is_stderr(key: Column) -> Column:
    return F.contains(key, F.lit("_stderr,"))


def is_sentinel(key: Column, value: Column) -> Column:
    """A context-length metric (all-digit name) of -1 means "not evaluated"."""
    number = F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))
    return F.coalesce(key.rlike("^[0-9]+(,|$)") & (number == -1), F.lit(False))


def is_score_key(key: Column, value: Column) -> Column:
    return (
        (key != "alias") & ~is_stderr(key) & F.contains(key, F.lit(",")) & ~is_sentinel(key, value)
    )


def numeric_or_null(value: Column) -> Column:
    """Numbers and booleans as double; text is null even when it looks like a number."""
    return F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _reported_names(metrics: Column) -> Column:
    """Metric names a task reports, metadata keys included."""
    keys = F.filter(F.map_keys(metrics), lambda k: (k != "alias") & ~is_stderr(k))
    return F.array_distinct(F.transform(keys, metric_name))


def formulation(output_type: Column, names: Column) -> Column:
    fixed = [F.when(output_type == kind, F.lit(form)) for kind, form in FORMULATIONS.items()]
    ambiguous = F.when(
        output_type == "loglikelihood",
        F.when(F.array_contains(names, "bits_per_byte"), F.lit("bits_per_byte")).otherwise(F.lit("rank_choice")),
    )
    return F.coalesce(*fixed, ambiguous)


def subtask_tree(groups: Column, reported: Column, root: Column, metric: Column) -> Column:
    """Adjacency of ``root`` limited to children that report ``metric``; null when empty.

    ``groups`` maps group -> children, ``reported`` maps task -> metric names.  A frontier
    walks down at most as many steps as the document has groups and stops costing anything
    once it is empty.
    """
    children = lambda g: F.filter(
        F.coalesce(groups[g], F.array().cast("array<string>")),
        lambda c: F.coalesce(F.array_contains(reported[c], metric), F.lit(False)),
    )
    start = F.struct(F.array(root).alias("seen"), F.array(root).alias("frontier"))

    def step(acc: Column, _: Column) -> Column:
        below = F.filter(
            F.flatten(F.transform(acc["frontier"], children)), lambda c: F.map_contains_key(groups, c)
        )
        fresh = F.array_except(below, acc["seen"])
        grown = F.struct(F.concat(acc["seen"], fresh).alias("seen"), fresh.alias("frontier"))
        return F.when(F.size(acc["frontier"]) == 0, acc).otherwise(grown)

    seen = F.aggregate(F.map_keys(groups), start, step)["seen"]
    entries = F.filter(
        F.transform(seen, lambda g: F.struct(g.alias("key"), children(g).alias("value"))),
        lambda e: F.size(e["value"]) > 0,
    )
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def derive_training_meta(rows: DataFrame) -> DataFrame:
    """tokens = batch x step when missing, then batch = tokens // step when missing."""
    tokens = F.coalesce("tokens_trained", F.col("train_batch_size") * F.col("step"))
    batch = F.coalesce("train_batch_size", F.when(F.col("step") > 0, F.expr("tokens_trained div step")))
    return rows.withColumn("tokens_trained", tokens).withColumn("train_batch_size", batch)


# ── documents ────────────────────────────────────────────────────────────────────────


#: Fields of a document that must be text or missing.
_TEXTS = (
    "lm_eval_version", "git_hash", "transformers_version", "model_name", "model_source", "chat_template", "chat_template_sha",
    "system_instruction", "system_instruction_sha",
)
_TOKENS = ("tokenizer_pad_token", "tokenizer_eos_token", "tokenizer_bos_token")


def _first(value: Column) -> Column:
    """The first member of a list, null for anything else."""
    return F.try_variant_get(value, "$[0]", "variant")


def _field(config: Column, name: str) -> Column:
    return F.try_variant_get(config, f"$.{name}", "variant")


def _first_reason(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()])


def _any_rejected(rule, values: list[Column]) -> Column:
    return reduce(operator.or_, [rejects(rule, v) for v in values])


def reject_reason(d: Column) -> Column:
    """Why a readable document is skipped whole, null if it is not: a value that its field has no place for.

    Task facts count only for tasks that have results, metric facts only for metrics that become rows.  One pass over
    tasks and metrics serves all rules.
    """

    def of_task(entry: Column) -> Column:
        task, metrics = entry["key"], entry["value"]
        config, alias, directions = d["configs"][task], metrics["alias"], d["higher_is_better"][task]

        def of_metric(m: Column) -> Column:
            stderr = metrics[F.concat(metric_name(m["key"]), F.lit("_stderr,"), F.split(m["key"], ",", 2)[1])]
            return _first_reason({
                "nested metric value": is_nested(m["value"]) | is_nested(stderr),
                "direction is no truth value": rejects(truth_value, directions[metric_name(m["key"])]),
            })

        rows = F.filter(F.map_entries(metrics), lambda m: is_score_key(m["key"], m["value"]))
        facts = _first_reason({
            "few-shot count is no integer": rejects(whole_number, d["n-shot"][task]),
            "sample count is no integer": rejects(whole_number, _field(d["n-samples"][task], "effective")),
            "direction is no truth value": F.coalesce(F.map_contains_key(d["higher_is_better"], task), F.lit(False)) & directions.isNull(),
        })
        listed = F.coalesce(F.map_contains_key(d["configs"], task), F.lit(False))
        of_config = _first_reason({
            "task config is no object": ~F.coalesce(kind(config).startswith("OBJECT"), F.lit(False)),
            "task config field is no text": _any_rejected(plain_text, [_field(config, n) for n in ("dataset_path", "output_type", "dataset_name")]),
            "repeats is no integer": rejects(whole_number, _field(config, "repeats")),
            "decontamination flag is no truth value": rejects(truth_value, _field(config, "should_decontaminate")),
            "task hash is no text": rejects(plain_text, d["task_hashes"][task]) & ~counts_as_nothing(config),
        })
        return F.coalesce(
            F.when(listed, of_config),
            F.when(rejects(plain_text, alias), F.when(~counts_as_nothing(alias), F.lit("alias is no text"))),
            _first_in(F.transform(rows, lambda m: F.coalesce(of_metric(m), facts))),
        )

    of_document = _first_reason({
        "text field is no text": _any_rejected(plain_text, [d[n] for n in _TEXTS]),
        "length or token id is no integer": _any_rejected(whole_number, [d["max_length"], d["eot_token_id"]]),
        "evaluation time is no number": rejects(number, d["total_evaluation_time_seconds"]),
        "token is no text": _any_rejected(plain_text, [_first(d[n]) for n in _TOKENS]),
    })
    return F.coalesce(of_document, _first_in(F.transform(F.map_entries(d["results"]), of_task)))


def _first_in(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


def parse_documents(files: DataFrame) -> DataFrame:
    """Add the typed document ``d`` and ``bad``, the reason to reject the whole file, if any.

    A file must hold one JSON object and nothing else.  The JSON reader stops at the end of the first value, so files are
    also read as members of a list, which has one member only if nothing follows.
    """
    parsed = F.from_json("content", RESULT_DOC, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    listed = F.from_json(F.concat(F.lit("["), "content", F.lit("]")), "array<string>")
    # The one-element explode keeps the optimizer from repeating the JSON parse in every
    # expression that uses the document.
    docs = files.select(
        *[c for c in files.columns if c != "content"], F.explode(F.array(F.struct(parsed.alias("d"), F.size(listed).alias("n")))).alias("read")
    )
    docs = docs.select("*", "read.d", (F.col("read.n") == 1).alias("_single")).drop("read")
    readable = F.col("d").isNotNull() & F.col("d._corrupt").isNull() & F.coalesce("_single", F.lit(False))
    reason = F.when(~readable, F.lit("unreadable")).otherwise(reject_reason(F.col("d")))
    # Evaluated once per document, like the parse.
    return docs.withColumn("bad", F.explode(F.array(reason))).drop("_single")


def quarantine(files: DataFrame) -> DataFrame:
    """Files that are skipped whole, with the reason."""
    parsed = parse_documents(files)
    return parsed.filter("bad is not null").drop("d").withColumnRenamed("bad", "reason")


def _eval_config(d: Column) -> Column:
    text = lambda name: plain_text(d[name]).alias(name)
    token = lambda name: plain_text(_first(d[name])).alias(name)
    whole = lambda name: whole_number(d[name]).alias(name)
    return F.struct(
        *[text(n) for n in ("lm_eval_version", "git_hash", "transformers_version", "model_name", "model_source")],
        whole("max_length"),
        number(d["total_evaluation_time_seconds"]).alias("total_eval_time_seconds"),
        *[token(n) for n in _TOKENS],
        whole("eot_token_id"),
        *[text(n) for n in ("chat_template", "chat_template_sha", "system_instruction", "system_instruction_sha")],
    )


def _as_text(config: Column, name: str) -> Column:
    """Text as it is, anything else as JSON, null stays null."""
    value = _field(config, name)
    return F.when(kind(value) == "STRING", _text(value)).when(kind(value) != "VOID", F.to_json(value))


def _task_config(config: Column, version: Column, task_hash: Column) -> Column:
    text = lambda name: plain_text(_field(config, name)).alias(name)
    built = F.struct(
        version.alias("task_version"),
        plain_text(task_hash).alias("task_hash"),
        *[text(n) for n in ("dataset_path", "output_type", "dataset_name")],
        whole_number(_field(config, "repeats")).alias("repeats"),
        *[_as_text(config, n).alias(n) for n in ("doc_to_text", "doc_to_target", "doc_to_choice", "generation_kwargs")],
        truth_value(_field(config, "should_decontaminate")).alias("should_decontaminate"),
    )
    # Configs of accepted documents are objects.
    present = F.size(F.map_keys(F.try_variant_get(config, "$", "map<string,variant>"))) > 0
    return F.when(config.isNotNull() & F.coalesce(present, F.lit(False)), built)


def eval_timestamp(date: Column) -> Column:
    """Epoch seconds to a zone-less UTC timestamp; anything but a number is null."""
    kind = F.schema_of_variant(date)
    seconds = F.when(
        (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(date, "$", "double")
    )
    micros = F.bround(seconds * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_results_long(files: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Score rows of all files that are not rejected; see :func:`parse_with_verdicts`."""
    return parse_with_verdicts(files, jobs).filter("reason is null").drop("reason")


def parse_with_verdicts(files: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Score rows of all files, and for each rejected file one row with its ``reason`` and no task, from one parse.

    ``files`` has the raw-file columns.  ``jobs`` (the manifest) adds step, paths and training
    facts per (model_key, label); files of unknown jobs are dropped.  A job that several runs
    list gives its rows once for each of them, with that run's facts and ``run_id``.  Without
    ``jobs`` these columns are taken from ``files`` when present.
    """
    job_columns = ["step", "model_path", "display_name", "train_batch_size", "tokens_trained"]
    if jobs is not None:
        run = [c for c in ("run_id",) if c in jobs.columns]
        facts = jobs.select(*run, "model_key", "label", *job_columns)
        files = files.drop(*run, *job_columns).join(facts, ["model_key", "label"])
    for name in job_columns:
        if name not in files.columns:
            dtype = "string" if name in ("model_path", "display_name") else "bigint"
            files = files.withColumn(name, F.lit(None).cast(dtype))

    d = F.col("d")
    no_map = lambda kind: F.create_map().cast(kind)
    groups = F.coalesce(d["group_subtasks"], no_map("map<string,array<string>>"))
    file_columns = [c for c in ("run_id", "label", "dir") if c in files.columns]
    of_file = [
        *file_columns, "model", "step", "model_path", "model_display_name", "is_checkpoint", "train_batch_size", "tokens_trained",
        "result_source", "eval_date", "eval_config", "reason",
    ]
    per_file = parse_documents(files).select(
        *file_columns,
        F.col("model_key").alias("model"),
        "step",
        "model_path",
        F.coalesce(F.nullif("display_name", F.lit("")), "model_key").alias("model_display_name"),
        F.col("step").isNotNull().alias("is_checkpoint"),
        "train_batch_size",
        "tokens_trained",
        F.col("path").alias("result_source"),
        eval_timestamp(d["date"]).alias("eval_date"),
        _eval_config(d).alias("eval_config"),
        F.col("bad").alias("reason"),
        *[d[name].alias(name) for name in ("results", "configs", "higher_is_better", "n-shot", "n-samples", "versions", "task_hashes")],
        groups.alias("groups"),
        F.transform_values("d.results", lambda _, metrics: _reported_names(metrics)).alias("reported"),
        # Later groups override earlier ones, so the last parent in document order wins.
        F.reverse(F.map_entries(groups)).alias("groups_last_first"),
    )

    # Facts are columns of exploded rows, not members of one value, so that those a query does not use are not computed.
    per_entry = per_file.select("*", F.explode(_or_one_null(F.col("reason"), F.map_entries("results"))).alias("entry"))
    task, metrics, is_good = F.col("entry.key"), F.col("entry.value"), F.col("reason").isNull()
    config = F.col("configs")[task]
    parents = F.filter("groups_last_first", lambda g: F.array_contains(g["value"], task))
    in_configs = F.coalesce(F.map_contains_key("configs", task), F.lit(False))
    is_group = F.map_contains_key("groups", task)
    of_task = {
        "task": task,
        "task_type": F.when(in_configs, F.lit("benchmark"))
        .when(is_group & (F.size(parents) == 0), F.lit("eval_suite"))
        .otherwise(F.lit("task_group")),
        "parent_task": F.get(parents, F.lit(0))["key"],
        "task_display_name": clean_display_name(
            F.when(F.map_contains_key(metrics, "alias"), _text(metrics["alias"])).otherwise(task), task
        ),
        "num_fewshot": whole_number(F.col("n-shot")[task]),
        "task_formulation": formulation(_text(config, "$.output_type"), F.col("reported")[task]),
        "language": detect_language(task),
        "n_samples": whole_number(_field(F.col("n-samples")[task], "effective")),
        "task_config": _task_config(config, F.col("versions")[task], F.col("task_hashes")[task]),
    }
    per_task = per_entry.select(
        *of_file,
        *[F.when(is_good, value).alias(name) for name, value in of_task.items()],
        metrics.alias("values"),
        F.col("higher_is_better")[task].alias("directions"),
        # Only trees of groups need the whole document's groups.
        F.when(is_group, F.col("groups")).alias("groups"),
        F.when(is_group, F.col("reported")).alias("reported"),
    )

    kept = F.filter(F.map_entries("values"), lambda m: is_score_key(m["key"], m["value"]))
    per_metric = per_task.select("*", F.explode(_or_one_null(F.col("reason"), kept)).alias("m"))
    name, of_filter = metric_name(F.col("m.key")), F.split(F.col("m.key"), ",", 2)[1]
    rows = per_metric.select(
        *of_file,
        *of_task,
        name.alias("metric"),
        of_filter.alias("metric_filter"),
        numeric_or_null(F.col("m.value")).alias("score"),
        numeric_or_null(F.col("values")[F.concat(name, F.lit("_stderr,"), of_filter)]).alias("score_stderr"),
        truth_value(F.col("directions")[name]).alias("higher_is_better"),
        F.when(F.col("groups").isNotNull(), subtask_tree(F.col("groups"), F.col("reported"), F.col("task"), name)).alias("subtask_tree"),
    )
    return derive_training_meta(rows).select(*file_columns, *SCORE.fieldNames(), "reason")


def _or_one_null(bad: Column, members: Column) -> Column:
    """``members``, or one null for a rejected file."""
    return F.when(bad.isNull(), members).otherwise(F.array(F.lit(None)))


def rejected_files(verdicts: DataFrame) -> DataFrame:
    """(model_key, label, dir, path, reason), each rejected file once, from :func:`parse_with_verdicts`."""
    names = [c for c in ("label", "dir") if c in verdicts.columns]
    bad = verdicts.filter("reason is not null")
    return bad.select(F.col("model").alias("model_key"), *names, F.col("result_source").alias("path"), "reason").distinct()


def filter_allowed_tasks(rows: DataFrame, task_map: DataFrame) -> DataFrame:
    """Rows whose task is configured; keyed by run where both sides carry one."""
    keys = ["run_id", "task"] if "run_id" in rows.columns and "run_id" in task_map.columns else ["task"]
    return rows.join(task_map.select(*keys).distinct(), keys, "left_semi")


def completed_tasks(files: DataFrame) -> DataFrame:
    """Distinct (model_key, label, task) named in the results of any readable file."""
    docs = files.select(
        "model_key", "label", F.from_json("content", "results map<string, variant>, _corrupt string",
                                          {"columnNameOfCorruptRecord": "_corrupt"}).alias("d")
    ).filter("d._corrupt is null")
    return docs.select("model_key", "label", F.explode(F.map_keys("d.results")).alias("task")).distinct()
