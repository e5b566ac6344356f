import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoremart.operators import catalogue as c
from scoremart.operators import planning as p
from scoremart.operators import status as s

ENTRY = """run_id string, config_key string, path string, model_key string, checkpoint_pattern string, steps array<long>,
    display_name string, train_batch_size long, tokens_trained array<long>, tokens_is_list boolean, step_offset long"""


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_manifest(spark):
    e = entries(
        spark,
        ("r", "stage", "/w", "a.b", "step{step}", [1000, 5000], "S", None, [5507, 5524], True, 656_000),
        ("r", "batch", "/v", None, "ck_{step}", None, "B", 4, None, False, 0),
        ("r", "plain", "/p", None, None, None, "P", None, [100], False, 7),
    )
    listing = spark.createDataFrame(
        [("/w", "step1000"), ("/w", "step3000"), ("/w", "step5000"), ("/w", "step5000x"), ("/v", "ck_0005")], "base string, name string")
    got = {r["task_key"]: (r["step"], r["tokens_trained"], r["model_path"]) for r in c.build_manifest(e, listing).collect()}
    assert got == {
        "a-b--step1000": (657_000, 5507, "/w/step1000"),
        "a-b--step5000": (661_000, 5524, "/w/step5000"),
        "batch--ck_0005": (5, 20, "/v/ck_0005"),
        "plain--main": (None, 100, "/p"),
    }
    missing = c.unmatched_patterns(e, listing.filter("base <> '/v'")).collect()
    assert [r["config_key"] for r in missing] == ["batch"]


def test_duplicate_keys(spark):
    e = entries(spark, ("r", "a.b", "/1", None, None, None, "A", None, None, False, 0), ("r", "a-b", "/2", None, None, None, "B", None, None, False, 0))
    manifest = c.build_manifest(e, spark.createDataFrame([], "base string, name string"))
    assert c.duplicate_manifest_keys(manifest).first()["n"] == 2
    with pytest.raises(ValueError, match="a-b--main"):
        c.require_unique_keys(manifest)


@pytest.mark.parametrize("n, parallel, batch, eff, batches", [(0, 8, 8, 1, 0), (4, 8, 8, 1, 4), (20, 8, 8, 3, 7), (200, 8, 8, 8, 25)])
def test_batch_sizes(spark, n, parallel, batch, eff, batches):
    df = spark.createDataFrame([("r", "k", [f"t{i}" for i in range(n)])], "run_id string, task_key string, remaining array<string>")
    out = p.plan_batches(df, parallel, batch).orderBy("batch_no").collect()
    assert len(out) == batches
    if out:
        assert len(out[0]["tasks"].split(",")) == eff
        assert ",".join(r["tasks"] for r in out) == ",".join(f"t{i}" for i in range(n))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 40), parallel=st.integers(1, 9), batch=st.integers(1, 9))
def test_batches_cover_everything_once(spark, n, parallel, batch):
    df = spark.createDataFrame([("r", "k", [str(i) for i in range(n)])], "run_id string, task_key string, remaining array<string>")
    out = p.plan_batches(df, parallel, batch).orderBy("batch_no").collect()
    sizes = [len(r["tasks"].split(",")) for r in out]
    assert sum(sizes) == n and all(x <= batch for x in sizes)
    assert n <= parallel or max(sizes) == min(batch, math.ceil(n / parallel))


@pytest.fixture
def plan(spark):
    manifest = spark.createDataFrame(
        [("r", f"m{i}--main", f"m{i}", "main", None, i) for i in range(4)],
        "run_id string, task_key string, model_key string, label string, step long, pos long")
    task_map = spark.createDataFrame(
        [("r", "s1", 0, "b", 0), ("r", "s1", 0, "a", 1), ("r", "s2", 1, "a", 0), ("r", "s2", 1, "c", 1)],
        "run_id string, suite string, suite_pos long, task string, pos long")
    disk = spark.createDataFrame([("m0", "main", t) for t in "abcx"] + [("m1", "main", "a")], "model_key string, label string, task string")
    scores = spark.createDataFrame([("m1", None, "b"), ("m1", None, "a"), ("m2", 5, "a")], "model string, step long, task string")
    return manifest, task_map, p.covered_on_disk(manifest, task_map, disk), p.covered_in_scores(manifest, task_map, scores)


def test_coverage(plan):
    manifest, task_map, disk, shared = plan
    cover = p.job_coverage(manifest, task_map, disk, shared)
    assert p.coverage_counts(cover).first().asDict() == dict(
        run_id="r", total=12, on_disk=4, shared_only=1, jobs_covered=1, jobs_remaining=3)
    left = {r["task_key"]: r["remaining"] for r in p.remaining_tasks(manifest, task_map, disk, shared).collect()}
    assert left == {"m0--main": [], "m1--main": ["c"], "m2--main": ["b", "a", "c"], "m3--main": ["b", "a", "c"]}
    suites = {(r["task_key"], r["suite"]): (r["done"], r["total"]) for r in s.suite_progress(manifest, task_map, disk).collect()}
    assert suites["m0--main", "s1"] == (2, 2) and suites["m1--main", "s2"] == (1, 2) and suites["m3--main", "s1"] == (0, 2)


def test_no_grid_of_jobs_and_tasks(plan):
    manifest, task_map, disk, shared = plan
    for df in (p.coverage_counts(p.job_coverage(manifest, task_map, disk, shared)), p.remaining_tasks(manifest, task_map, disk, shared)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_states(spark, plan):
    manifest, task_map, disk, shared = plan
    cover = p.job_coverage(manifest, task_map, disk, shared)
    empty = spark.createDataFrame([], "run_id string, task_key string")
    active = spark.createDataFrame(
        [("r", 0, "m1--main", "7", "PENDING"), ("r", 1, "m1--main", "8", "RUNNING"), ("r", 2, "m0--main", "9", "PENDING")],
        "run_id string, pos long, task_key string, job_id string, state string")
    failed = spark.createDataFrame([("r", "m1--main", "why"), ("r", "m2--main", "why")], "run_id string, task_key string, reason string")
    got = {r["task_key"]: (r["state"], r["info"]) for r in s.job_states(cover, empty, active, failed).collect()}
    assert got == {"m0--main": ("completed", "9 PENDING"), "m1--main": ("running", "8 RUNNING"), "m2--main": ("failed", "why"), "m3--main": ("not_started", "")}
    todo = p.keys_to_submit(manifest, empty, active).collect()
    assert [r["task_key"] for r in todo] == ["m2--main", "m3--main"]
    assert p.keys_to_submit(manifest, empty, active, limit=1).count() == 1
    both = manifest.unionByName(manifest.withColumn("run_id", F.lit("r2")))
    assert [(r["run_id"], r["task_key"]) for r in p.keys_to_submit(both, empty, active, limit=2).collect()] == [
        ("r", "m2--main"), ("r", "m3--main"), ("r2", "m0--main"), ("r2", "m1--main")]
    with pytest.raises(ValueError):
        p.keys_to_submit(manifest, empty, active, only=spark.createDataFrame([("r", "zz")], "run_id string, task_key string"))


def test_no_expected_tasks(spark, plan):
    manifest, task_map, disk, shared = plan
    cover = p.job_coverage(manifest, task_map.limit(0), disk, shared)
    empty = spark.createDataFrame([], "run_id string, task_key string")
    nothing = spark.createDataFrame([], "run_id string, pos long, task_key string, job_id string, state string")
    failed = spark.createDataFrame([], "run_id string, task_key string, reason string")
    assert {r["state"] for r in s.job_states(cover, empty, nothing, failed).collect()} == {"completed"}
    assert p.locally_complete_keys(cover, empty).count() == 0


def test_datasets(spark):
    tasks = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", ""), ("e", None)], "task string, dataset_path string")
    assert [tuple(r) for r in p.dataset_group_sizes(tasks).collect()] == [("d", 2), ("__custom__c", 1), ("__unknown__", 1)]


def test_task_order(spark):
    tasks = spark.createDataFrame([(t,) for t in ("z_rc", "a_rc", "b_code", "q_zz", "plain", "c_gen")], "task string")
    assert [r["task"] for r in p.order_tasks(tasks).collect()] == ["b_code", "c_gen", "a_rc", "z_rc", "plain", "q_zz"]
    assert p.order_tasks(tasks).filter(F.col("sort_class") == 5).count() == 2


def test_invalid_entries_are_errors(spark):
    entry = ("r", "e", "/w", None, "checkpoint_{step}", None, None, None, None, False, 0)
    listing = spark.createDataFrame([("/w", "checkpoint_10")], "base string, name string")
    assert c.require_valid_entries(spark.createDataFrame([entry], ENTRY), listing).count() == 1
    lost = spark.createDataFrame([("r", "e", "/elsewhere", *entry[3:])], ENTRY)
    with pytest.raises(ValueError, match="r/e: no directory matches"):
        c.require_valid_entries(lost, listing)
    broken = spark.createDataFrame([(*entry[:4], None, [1], *entry[6:])], ENTRY)
    with pytest.raises(ValueError, match="steps without checkpoint_pattern"):
        c.require_valid_entries(broken, listing)
