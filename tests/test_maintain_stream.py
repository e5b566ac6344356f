import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from scoremart.operators import maintain as k
from scoremart.operators.merge import conform, merge_and_dedup
from scoremart.operators.parse import parse_results_long
from scoremart.operators.rollup import rollup
from scoremart.plans.collect import assemble_into, collect_run
from scoremart.schemas import KEY
from scoremart.sources import ScoreTable, scan_result_files, stream_result_files
from scoremart.streaming import ScoreStream, completion_index, parse_stream
from scoremart.streaming.incremental import runs_to_merge
from workloads.q_stream import BATCHES, landed_documents, landed_scores, run_to_table, score_stream

FILES = "model_key string, label string, dir string, path string, mtime timestamp, content string"


def day(n):
    return datetime(2024, 1, n)


def test_compaction(spark):
    old = {"results": {"r": {"4096,none": 0.9, "8192,none": 0.8}, "t": {"acc,none": 1}, "empty": {}}, "configs": {"r": {"a": 1, "b": 2}},
           "higher_is_better": {"r": {"x": True}}, "date": 1, "only_old": "q\"uote"}
    new = {"results": {"r": {"4096,none": -1, "8192,none": 0.7}, "neg": {"acc,none": -1}}, "configs": {"r": {"a": 3}},
           "higher_is_better": {"r": {"y": False}}, "date": 2}
    files = spark.createDataFrame(
        [("m", "l", "batch_7_0", "p2", day(2), json.dumps(new)), ("m", "l", "batch_7_1", "p1", day(1), json.dumps(old)),
         ("m", "l", "batch_9_0", "p3", day(3), json.dumps(new)), ("m", "l", "batch_9_1", "p4", day(4), "{torn")], FILES)
    safe = k.safe_files(files, spark.createDataFrame([("9",)], "job_id string"))
    assert safe.count() == 2
    entries = k.compact_entries(safe)
    merged = json.loads(k.compact_documents(entries).first()["content"])
    assert merged == {
        "results": {"r": {"4096,none": 0.9, "8192,none": 0.7}, "t": {"acc,none": 1}, "empty": {}, "neg": {"acc,none": -1}},
        "configs": {"r": {"a": 3}}, "higher_is_better": {"r": {"x": True, "y": False}}, "date": 2, "only_old": "q\"uote"}
    assert k.compact_report(safe, entries).first().asDict() == dict(model_key="m", label="l", tasks_merged=4, dirs_superseded=2)


def test_compaction_keeps_values_that_are_no_objects(spark):
    old = {"higher_is_better": {"t": True, "u": {"x": True}, "w": 1}, "configs": {"t": "text"}}
    new = {"higher_is_better": {"t": False, "v": None}}
    files = spark.createDataFrame(
        [("m", "l", "d2", "p2", day(2), json.dumps(new)), ("m", "l", "d1", "p1", day(1), json.dumps(old))], FILES)
    merged = json.loads(k.compact_documents(k.compact_entries(files)).first()["content"])
    assert merged == {"higher_is_better": {"t": False, "u": {"x": True}, "v": None, "w": 1}, "configs": {"t": "text"}}


def test_compaction_exchanges_tasks_not_keys(spark):
    """Any files of a checkpoint give what merging them one after the other gives; two exchanges, none with a row for each key."""
    rng = random.Random(7)
    files, expected = [], {}
    for i in range(40):
        doc = {
            "results": {f"t{rng.randrange(6)}": {f"{m},none": rng.randrange(9) for m in rng.sample(["acc", "f1", "em", "512"], 2)} for _ in range(3)},
            "higher_is_better": {f"t{rng.randrange(6)}": {"acc": rng.random() < 0.5}}, "n-shot": {f"t{rng.randrange(8)}": i}, "versions": {}, "date": i}
        files.append((f"m{i % 2}", None if i % 4 < 2 else "l", "d", f"p{i:02d}", day(1 + i // 4), json.dumps(doc)))
        merged = expected.setdefault(files[-1][:2], {"results": {}, "higher_is_better": {}, "n-shot": {}})
        for section in ("results", "higher_is_better"):
            for task, keys in doc[section].items():
                merged[section].setdefault(task, {}).update(keys)
        merged["n-shot"].update(doc["n-shot"])
        merged["date"] = i
    rng.shuffle(files)
    documents = k.compact_documents(k.compact_entries(spark.createDataFrame(files, FILES)))
    exchanges = [line for line in documents._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line]
    assert {(r["model_key"], r["label"]): json.loads(r["content"]) for r in documents.collect()} == expected
    assert len(exchanges) == 2 and not any("section#" in line for line in exchanges)


def write_results(root, model, batch, scores, date):
    folder = root / model / "main" / batch
    folder.mkdir(parents=True)
    doc = {"results": {t: {"acc,none": s, "alias": t} for t, s in scores.items()}, "configs": {t: {"output_type": "generate_until"} for t in scores}, "date": date}
    (folder / "results_1.json").write_text(json.dumps(doc))


def graph(spark):
    return (
        spark.createDataFrame([("g", 0, "a", 0), ("g", 0, "b", 1)], "grp string, grp_pos long, child string, child_pos long"),
        spark.createDataFrame([("g", "acc", False)], "grp string, metric string, weight_by_size boolean"),
        spark.createDataFrame([("g",)], "task string"),
    )


def test_micro_batches_equal_batch(spark, tmp_path):
    root = tmp_path / "results"
    write_results(root, "m0", "b0", {"a": 1.0, "b": 2.0}, 200)
    write_results(root, "m1", "b0", {"a": 3.0}, 200)
    table = ScoreStream(spark, str(tmp_path / "stream"), graph(spark))

    def run():
        table.start(parse_stream(stream_result_files(spark, str(root), max_files=1))).awaitTermination()

    run()
    assert {r["model"]: r["score"] for r in table.aggregates().collect()} == {"m0": 1.5}
    write_results(root, "m1", "b1", {"b": 5.0, "a": 9.0}, 100)  # late and older: only b is new
    write_results(root, "m0", "b1", {"a": 3.0}, 300)
    run()
    batch = merge_and_dedup(conform(parse_results_long(scan_result_files(spark, str(root)))).limit(0),
                            conform(parse_results_long(scan_result_files(spark, str(root)))))
    same = lambda df: sorted((r["model"], r["task"], r["score"]) for r in df.collect())
    assert same(table.scores()) == same(batch) == [("m0", "a", 3.0), ("m0", "b", 2.0), ("m1", "a", 3.0), ("m1", "b", 5.0)]
    assert {r["model"]: r["score"] for r in table.aggregates().collect()} == {"m0": 2.5, "m1": 4.0}
    # Replaying a batch changes nothing, before and after a fold; folding neither.
    before, mark = same(table.scores()), table.mark()
    wrong = conform(batch).withColumn("score", F.lit(-5.0)).withColumn("eval_date", F.lit(day(9)).cast("timestamp_ntz"))
    table.apply(wrong, 1)
    assert same(table.scores()) == before and table.mark() == mark
    assert table.fold() == mark.batch and table.mark().score_runs == ()
    table.apply(wrong, mark.batch)
    assert same(table.scores()) == before and same(table.base.read()) == before
    index = completion_index(stream_result_files(spark, str(root)))
    out = str(tmp_path / "index")
    index.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_runs_stay_few():
    runs = ()
    for batch in range(1000):
        n = runs_to_merge(runs)
        first = int(runs[len(runs) - n].split("_")[0]) if n else batch
        runs = (*runs[: len(runs) - n], f"{first:012d}_{batch:012d}")
        assert len(runs) <= (batch + 1).bit_length()
        assert sum(int(r.split("_")[1]) - int(r.split("_")[0]) + 1 for r in runs) == batch + 1


NESTED = (
    [("top", 9, "g", 0), ("top", 9, "h", 1), ("top", 9, "c", 2), ("g", 1, "a", 0), ("g", 1, "b", 1), ("h", 2, "b", 0), ("h", 2, "d", 1)],
    [(x, m, w) for x, w in (("top", False), ("g", True), ("h", False)) for m in ("acc", "f1")],
    [("top",)],
)


def random_rows(rng, n, tasks):
    pick = rng.choice
    return [
        (f"m{rng.randrange(3)}", pick([None, 1]), pick(tasks), pick(["acc", "f1"]), pick(["none", "none", "none", "strict"]),
         pick([None, float("nan"), float("inf"), *map(float, range(20))]), pick([None, 0, 1, 5, 9]), day(rng.randrange(1, 28)) if rng.random() < 0.9 else None,
         pick([None, "eng", "eng", "deu"]), pick([None, True, False]), pick([None, "", "/a", "/b"]), f"s{rng.randrange(10**9)}")
        for _ in range(n)
    ]


def test_aggregates_follow_any_batches(spark, tmp_path):
    """Replaced, late and odd rows, a task that appears later, and folds between: equal to a roll-up of all rows."""
    rng = random.Random(5)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(
        NESTED, ("grp string, grp_pos long, child string, child_pos long", "grp string, metric string, weight_by_size boolean", "task string"), strict=True)]
    stream = ScoreStream(spark, str(tmp_path / "stream"), tuple(frames))
    schema = ("model string, step long, task string, metric string, metric_filter string, score double, n_samples long, eval_date timestamp, "
              "language string, higher_is_better boolean, model_path string, result_source string")
    seen = []
    columns = [*KEY, "score", "n_samples", "eval_date", "language", "higher_is_better", "model_path", "task_type", "parent_task"]
    view = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*columns).collect())
    signed = 0
    for batch in range(6):
        # A task is new in the second batch; the last one brings a task named like a group, which has rows of its own then.
        tasks = ["a", "b", "d"] if batch < 1 else ["a", "b", "c", "d"] if batch < 5 else ["a", "g"]
        rows = random_rows(rng, 60 if batch < 2 else 8, tasks)
        seen += rows
        edges = stream.mark().edges
        stream.apply(spark.createDataFrame(rows, schema).withColumn("task_type", F.lit("benchmark")), batch)
        signed += edges == stream.mark().edges
        if batch == 3:
            stream.fold()
        if batch < 2:
            continue
        every = conform(spark.createDataFrame(seen, schema).withColumn("task_type", F.lit("benchmark")))
        latest = merge_and_dedup(every.limit(0), every)
        assert view(stream.aggregates()) == view(rollup(latest, *frames)), batch
    assert signed >= 2 and len(stream.mark().cell_runs) <= 3


def test_collect_leaves_other_models_files_alone(spark, tmp_path):
    """Only buckets of the run's models, and of groups that have become suites, get new files."""
    scores = conform(spark.createDataFrame(
        [(f"m{i}", t, float(i), kind) for i in range(30) for t, kind in (("a", "benchmark"), ("b", "benchmark"), ("h", "task_group"))]
        + [("m7", "g", 99.0, "task_group"), ("m8", "g", 99.0, "task_group")],
        "model string, task string, score double, task_type string").selectExpr("*", "'acc' AS metric", "'none' AS metric_filter"))
    table = ScoreTable(spark, str(tmp_path / "table"))
    table.lay_out(16, 2)
    table.rewrite(scores)
    local = conform(spark.createDataFrame([("m7", "a", 20.0, day(1))], "model string, task string, score double, eval_date timestamp").selectExpr(
        "*", "'acc' AS metric", "'none' AS metric_filter", "'benchmark' AS task_type"))
    models = spark.createDataFrame([("m7",)], "model string")
    child, metric, suites = graph(spark)
    change = assemble_into(table, local, models, child, metric, suites.unionByName(spark.createDataFrame([("x",)], "task string")))
    found = {(r["model"], r["task"]): (r["score"], r["task_type"]) for r in table.read().collect()}
    assert found[("m7", "g")] == ((20.0 + 7.0) / 2, "eval_suite") and found[("m7", "h")] == (7.0, "task_group")
    # Another model's group that is a suite now is reclassified, its score kept.
    assert found[("m8", "g")] == (99.0, "eval_suite") and len(found) == 92
    own = set(table.buckets_of_models(spark.createDataFrame([("m7",), ("m8",)], "model string")))
    assert set(change.buckets) <= own and 0 < len(change.buckets) < 32
    assert change.diff.first().asDict() == dict(old_rows=92, new_rows=92, net=0, churned=0, genuine_added=0, genuine_removed=0, changed=2)
    assert assemble_into(table, local, models, child, metric, suites).buckets == []


def test_collect(spark, tmp_path):
    root = tmp_path / "results"
    write_results(root, "m0", "b0", {"a": 1.0, "b": 2.0, "extra": 7.0}, 200)
    (root / "m0" / "main" / "torn").mkdir()
    (root / "m0" / "main" / "torn" / "results_1.json").write_text("{")
    manifest = spark.createDataFrame(
        [("m0", "main", None, "/w", "M 0", None, 5)],
        "model_key string, label string, step long, model_path string, display_name string, train_batch_size long, tokens_trained long")
    task_map = spark.createDataFrame([("a",), ("b",)], "task string")
    table = str(tmp_path / "table")
    first = collect_run(scan_result_files(spark, str(root)), manifest, task_map, *graph(spark), table)
    assert [(r["task"], r["score"], r["task_type"]) for r in first.scores.collect()] == [
        ("a", 1.0, "benchmark"), ("b", 2.0, "benchmark"), ("g", 1.5, "eval_suite")]
    assert first.rejected.count() == 1 and first.diff.first()["genuine_added"] == 3
    again = collect_run(scan_result_files(spark, str(root)), manifest, task_map, *graph(spark), table)
    assert again.diff.first()["net"] == 0 and again.diff.first()["changed"] == 0
    empty = collect_run(scan_result_files(spark, str(tmp_path / "none")), manifest, task_map, *graph(spark), table)
    assert empty.scores.count() == 3 and ScoreTable(spark, table).read().select(*KEY).count() == 3


class Made:
    """Derived tables of a query, given as they are."""

    def __init__(self, spark, **tables):
        self.spark = spark
        self.__dict__.update(tables)


def test_landed_documents_come_in_few_batches(spark):
    text = F.concat(F.lit('{"results": {"t'), F.col("id").cast("string"), F.lit('": {}}}'))
    docs = spark.range(0, 60, 1, 20).select(F.lit("m").alias("model_key"), F.lit("l").alias("label"), text.alias("content"), F.lit(1).alias("step"))
    stream = landed_documents(Made(spark, documents=lambda: docs))
    seen = []
    stream.writeStream.foreachBatch(lambda rows, i: seen.append(rows.count())).trigger(availableNow=True).start().awaitTermination()
    assert 1 < len(seen) <= BATCHES and sum(seen) == 60
    assert run_to_table(Made(spark), completion_index(stream), "index").count() == 60


def test_landed_scores_lie_in_many_files_and_ties_in_one(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("m"), (F.col("id") % 40).cast("string")).alias("model"), F.lit("t").alias("task"), F.lit("acc").alias("metric"),
        F.lit("none").alias("metric_filter"), F.col("id").cast("double").alias("score"), F.lit("2024-01-01").cast("timestamp_ntz").alias("eval_date"))
    d = Made(spark, scores=rows, lineitem=spark.range(1_000_000))
    stream = landed_scores(d)
    batches = []
    stream.writeStream.foreachBatch(
        lambda b, i: batches.append({(r["model"], r["n"]) for r in b.groupBy("model").agg(F.count("*").alias("n")).collect()})
    ).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 2 and all(n == 10 for b in batches for _, n in b)
    tasks = stream.select(F.input_file_name().alias("f")).writeStream.format("memory").queryName("landed_files").trigger(availableNow=True).start()
    tasks.awaitTermination()
    assert spark.table("landed_files").distinct().count() > 2
    assert score_stream(Made(spark, lineitem=spark.range(40_000_000))).base.layout[0] == 16
    assert score_stream(d).base.layout[0] == 4
