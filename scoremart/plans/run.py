"""Planning and status of all runs from their control tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import planning as p
from ..operators import status as s
from ..operators.catalogue import build_manifest, require_unique_keys, require_valid_entries


@dataclass
class RunPlan:
    """What a planning round derives; every table is keyed by run."""

    manifest: DataFrame
    covered: DataFrame
    job_cover: DataFrame
    newly_completed: DataFrame
    summary: DataFrame
    to_submit: DataFrame
    batches: DataFrame


def plan_runs(
    entries: DataFrame,
    listing: DataFrame,
    task_map: DataFrame,
    scores: DataFrame,
    disk: DataFrame,
    completed: DataFrame,
    active: DataFrame,
    parallel: int = 1,
    batch: int = 8,
) -> RunPlan:
    """Catalogue, shared scores and local results to the work that is left.

    ``disk`` is (model_key, label, task); ``completed`` the completed log; ``active`` the
    unfinished queue rows.  Entries that break a rule, patterns that match nothing and
    duplicate keys are errors.
    """
    require_valid_entries(entries, listing)
    manifest = require_unique_keys(build_manifest(entries, listing))
    covered = p.covered_in_scores(manifest, task_map, scores)
    on_disk = p.covered_on_disk(manifest, task_map, disk)
    cover = p.job_coverage(manifest, task_map, on_disk, covered)
    fresh = p.locally_complete_keys(cover, completed)
    done = completed.select("run_id", "task_key").unionByName(fresh)
    positioned = manifest if "pos" in manifest.columns else _positioned(manifest)
    to_submit = p.keys_to_submit(positioned, done, active)
    remaining = p.remaining_tasks(to_submit, task_map, on_disk, covered)
    return RunPlan(
        manifest, covered, cover, fresh, p.run_summary(cover), to_submit, p.plan_batches(remaining, parallel, batch)
    )


def _positioned(manifest: DataFrame) -> DataFrame:
    """Manifest order of a catalogue without positions: by model, then step."""
    return manifest.withColumn("pos", F.struct("model_key", "step", "label"))


def run_status(
    manifest: DataFrame,
    task_map: DataFrame,
    on_disk: DataFrame,
    covered: DataFrame,
    completed: DataFrame,
    active: DataFrame,
    failed: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per job, per job and suite, per run) progress."""
    cover = p.job_coverage(manifest, task_map, on_disk, covered)
    states = s.job_states(cover, completed, active, failed)
    return states, s.suite_progress(manifest, task_map, on_disk), s.status_rollup(states)
