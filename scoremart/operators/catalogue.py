"""The model catalogue: checks, checkpoint resolution, manifest.

Entries: ``(run_id, config_key, path, model_key, checkpoint_pattern, steps array<bigint>,
display_name, train_batch_size, tokens_trained array<bigint>, tokens_is_list, step_offset)``.
A scalar token count is an array of one with ``tokens_is_list`` false.  Directory listings
are a table ``(base, name)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checkpoint_regex, format_tokens, manifest_key


def catalogue_checks(entries: DataFrame) -> DataFrame:
    """(run_id, config_key, severity, rule), one row per broken rule."""
    has = lambda name: F.col(name).isNotNull()
    listed = F.coalesce("tokens_is_list", F.lit(False))
    rules = [
        ("error", "steps without checkpoint_pattern", has("steps") & ~has("checkpoint_pattern")),
        ("error", "empty steps", has("steps") & (F.size("steps") == 0)),
        ("error", "tokens list without steps", listed & ~has("steps")),
        (
            "error",
            "tokens list length differs from steps",
            listed & has("steps") & (F.size("tokens_trained") != F.size("steps")),
        ),
        (
            "warning",
            "checkpoint model without token metadata",
            has("checkpoint_pattern") & ~has("train_batch_size") & ~has("tokens_trained"),
        ),
        ("warning", "model without token count", ~has("checkpoint_pattern") & ~has("tokens_trained")),
    ]
    broken = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule")))
                for severity, rule, test in rules
            ]
        )
    )
    return entries.select("run_id", "config_key", F.explode(broken).alias("b")).select("run_id", "config_key", "b.*")


def resolve_checkpoints(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per (entry, checkpoint) with ``label, raw_step, full_path``.

    Entries without a pattern are single models labelled ``main``; entries whose pattern
    matches nothing yield no row here and are reported by :func:`unmatched_patterns`.
    """
    series = entries.filter("checkpoint_pattern is not null").withColumn("rx", checkpoint_regex("checkpoint_pattern"))
    found = (
        series.join(listing.withColumnRenamed("base", "path"), "path")
        .filter("rlike(name, rx)")
        .withColumn("raw_step", F.expr("cast(regexp_extract(name, rx, 1) as bigint)"))
        .filter("steps is null or array_contains(steps, raw_step)")
        .withColumn("label", F.col("name"))
        .withColumn("full_path", F.concat_ws("/", "path", "name"))
        .drop("rx", "name")
    )
    single = (
        entries.filter("checkpoint_pattern is null")
        .withColumn("raw_step", F.lit(None).cast("bigint"))
        .withColumn("label", F.lit("main"))
        .withColumn("full_path", F.col("path"))
    )
    return found.unionByName(single)


def unmatched_patterns(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose checkpoint pattern matches no directory: configuration errors."""
    series = entries.filter("checkpoint_pattern is not null")
    resolved = resolve_checkpoints(series, listing).select("run_id", "config_key").distinct()
    return series.join(resolved, ["run_id", "config_key"], "left_anti").select(
        "run_id", "config_key", "path", "checkpoint_pattern"
    )


def _tokens_at(raw_step: Column) -> Column:
    """Per-step list entry, else the scalar, else batch x raw step."""
    index = F.array_position("steps", raw_step)
    listed = F.when(index > 0, F.expr("get(tokens_trained, cast(array_position(steps, raw_step) as int) - 1)"))
    given = F.when(F.coalesce("tokens_is_list", F.lit(False)), listed).otherwise(F.get("tokens_trained", F.lit(0)))
    return F.coalesce(given, F.col("train_batch_size") * raw_step)


def build_manifest(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows of all runs."""
    effective = F.coalesce("model_key", "config_key")
    return resolve_checkpoints(entries, listing).select(
        "run_id",
        manifest_key(effective, "label").alias("task_key"),
        effective.alias("model_key"),
        "label",
        (F.col("raw_step") + F.coalesce("step_offset", F.lit(0))).alias("step"),
        F.col("full_path").alias("model_path"),
        "display_name",
        "train_batch_size",
        _tokens_at(F.col("raw_step")).alias("tokens_trained"),
    )


def duplicate_manifest_keys(manifest: DataFrame) -> DataFrame:
    """(run_id, task_key, n) of keys that are not unique within their run."""
    return manifest.groupBy("run_id", "task_key").agg(F.count("*").alias("n")).filter("n > 1")


def require_unique_keys(manifest: DataFrame) -> DataFrame:
    """The manifest itself, or an error naming a few duplicate keys."""
    duplicates = [r["task_key"] for r in duplicate_manifest_keys(manifest).limit(5).collect()]
    if duplicates:
        raise ValueError(f"duplicate manifest keys, e.g. {', '.join(duplicates)}")
    return manifest


def require_valid_entries(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """The entries themselves, or an error naming a few that break a rule or whose pattern matches nothing."""
    broken = catalogue_checks(entries).filter("severity = 'error'").select("run_id", "config_key", "rule")
    lost = unmatched_patterns(entries, listing).select(
        "run_id", "config_key", F.concat(F.lit("no directory matches "), "checkpoint_pattern").alias("rule")
    )
    found = [f"{r['run_id']}/{r['config_key']}: {r['rule']}" for r in broken.unionByName(lost).limit(5).collect()]
    if found:
        raise ValueError(f"invalid catalogue entries, e.g. {'; '.join(found)}")
    return entries


def catalogue_report(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Display table of all jobs; ``found`` tells whether the path is in the listing."""
    jobs = build_manifest(entries, listing)
    paths = listing.select(F.concat_ws("/", "base", "name").alias("model_path")).unionByName(
        listing.select(F.col("base").alias("model_path"))
    ).distinct().withColumn("_found", F.lit(True))
    return jobs.join(paths, "model_path", "left").select(
        "run_id",
        "task_key",
        "display_name",
        "label",
        "model_path",
        F.coalesce("_found", F.lit(False)).alias("found"),
        F.coalesce(F.nullif("train_batch_size", F.lit(0)).cast("string"), F.lit("-")).alias("batch_size"),
        format_tokens("tokens_trained").alias("tokens_trained"),
    )
