from datetime import datetime

from pyspark.sql import functions as F

from scoremart.operators import diff as d
from scoremart.operators import maintain as k
from scoremart.operators import merge as m
from scoremart.schemas import KEY

SCHEMA = "model string, step long, task string, metric string, metric_filter string, score double, eval_date timestamp_ntz"
D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def table(spark, *rows):
    return m.conform(spark.createDataFrame([("m", s, t, "acc", "none", v, when) for s, t, v, when in rows], SCHEMA))


def scores(df):
    return {(r["step"], r["task"]): r["score"] for r in df.collect()}


def test_latest_wins(spark):
    old = table(spark, (1, "a", 1.0, None), (1, "b", 1.0, D2), (1, "c", 1.0, D1), (None, "d", 1.0, D1), (1, "old", 9.0, D1))
    new = table(spark, (1, "a", 2.0, D1), (1, "b", 2.0, D1), (1, "c", 2.0, D1), (None, "d", 2.0, D2))
    merged = m.merge_and_dedup(old, new)
    assert scores(merged) == {(1, "a"): 2.0, (1, "b"): 1.0, (1, "c"): 2.0, (None, "d"): 2.0, (1, "old"): 9.0}
    assert scores(m.merge_and_dedup(merged, merged)) == scores(merged)


def test_diff_with_itself_is_empty(spark):
    t = table(spark, (1, "a", 1.0, D1), (None, "b", None, D1))
    assert d.diff_summary(t, t).first().asDict() == dict(
        old_rows=2, new_rows=2, net=0, churned=0, genuine_added=0, genuine_removed=0, changed=0)
    assert d.diff_added_removed(t, t).count() == 0 and d.diff_changed_values(t, t).count() == 0
    # The other counting: a null step never matches.
    assert d.diff_summary(t, t, null_keys_equal=False).first()["churned"] == 1


def test_diff_counts(spark):
    old = table(spark, (1, "a", 1.0, D1), (1, "b", None, D1), (1, "c", 1.0, D1), (1, "gone", 1.0, D1), (1, "gone2", 1.0, D1))
    new = table(spark, (1, "a", 1.0, D1), (1, "b", 2.0, D1), (1, "c", 3.0, D1), (1, "in", 1.0, D1))
    assert d.diff_summary(old, new).first().asDict() == dict(
        old_rows=5, new_rows=4, net=-1, churned=1, genuine_added=0, genuine_removed=1, changed=2)


def test_token_repair(spark):
    df = spark.createDataFrame([(36e12 + 0.0, "12"), (2.5, "x")], "tokens_trained double, train_batch_size string")
    assert [tuple(r) for r in m.repair_token_types(df).collect()] == [(36_000_000_000_000, 12), (2, None)]


def test_hot_key_leaves_one_row_per_task(spark):
    """A third of all rows share one key: the rank filter runs before the exchange."""
    rows = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("model"),
        F.lit(None).cast("long").alias("step"), F.lit("t").alias("task"), F.lit("acc").alias("metric"),
        F.lit("none").alias("metric_filter"), F.col("id").cast("double").alias("score"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("eval_date"),
    )
    latest = m.dedup_latest(m.conform(rows))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert latest.filter("model = 'hot'").first()["score"] == 29_997.0
    assert latest.count() == 20_001


def test_diff_and_compaction_combine_before_the_exchange(spark):
    t = table(spark, (1, "a", 1.0, D1))
    plan = d.key_diff(t, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_drop_rows_keeps_unknown(spark):
    df = spark.createDataFrame(
        [("arc_challenge", "eng"), ("arc_challenge", None), ("arc_challenge", "deu"), ("x_gsm_symbolic", None), ("ok", None)],
        "task string, language string")
    kept = k.drop_rows(df, k.invalid_rows())
    assert sorted((r["task"], r["language"] or "") for r in kept.collect()) == [("arc_challenge", ""), ("arc_challenge", "deu"), ("ok", "")]
    assert k.drop_rows_counts(df, k.invalid_rows()).first().asDict() == {"before": 5, "dropped": 2, "after": 3}


def test_display_names(spark):
    entries = spark.createDataFrame(
        [("a", 0, "m", "Old"), ("b", 0, "m", "New"), ("b", 1, "m", ""), ("b", 2, "n", "Same")],
        "file string, pos long, model_key string, display_name string")
    mapping = k.display_name_mapping(entries)
    assert {r["model"]: r["new_name"] for r in mapping.collect()} == {"m": "New", "n": "Same"}
    rows = m.conform(spark.createDataFrame(
        [("m", 1, "a", "Old"), ("m", 2, "a", "New"), ("m", 3, "a", None), ("n", 1, "a", None), ("n", 2, "a", "Same")],
        "model string, step long, task string, model_display_name string"))
    synced = {(r["model"], r["step"]): r["model_display_name"] for r in k.sync_dimension(rows, mapping).collect()}
    assert synced == {("m", 1): "New", ("m", 2): "New", ("m", 3): "New", ("n", 1): None, ("n", 2): "Same"}
    assert [tuple(r) for r in k.sync_dimension_preview(rows, mapping).collect()] == [("m", "Old", "New", 3)]
    assert len(KEY) == 5
