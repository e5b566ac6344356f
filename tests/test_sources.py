import glob
import json
import os

from pyspark.sql import functions as F

from scoremart import sources as src
from workloads.fixtures import lay_out_files
from workloads.q_parse import from_files


def put(path, text, mtime=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_result_files_and_latest(spark, tmp_path):
    root = str(tmp_path)
    for d, name, when in [("b0", "results_1.json", 100), ("b0", "results_2.json", 200), ("b1", "results_1.json", 50), ("b1", "other.json", 900)]:
        put(f"{root}/m 0/main/{d}/{name}", f'{{"results": {{"{d}{name[8]}": {{}}}}}}', when)
    put(f"{root}/m 0/main/results_9.json", "{}")
    put(f"{root}/m 0/main/b0/deeper/results_9.json", "{}")
    put(f"{root}/gone/main/b0/results_1.json", "{}")
    files = src.scan_result_files(spark, root)
    assert files.count() == 4
    manifest = spark.createDataFrame([("m 0", "main")], "model_key string, label string")
    newest = src.latest_per_dir(files, manifest)
    assert sorted((r["model_key"], r["dir"], r["content"]) for r in newest.collect()) == [
        ("m 0", "b0", '{"results": {"b02": {}}}'), ("m 0", "b1", '{"results": {"b11": {}}}')]
    assert src.scan_result_files(spark, root + "/nowhere").count() == 0


def test_result_files_are_listed_some_models_at_a_time(spark, tmp_path):
    names = ["m 0", "m[1]", "m{a,b}", "m,2", "_m", "_k=1", ".m", "m*", "m%20x", "m\\3"]
    for name in names:
        for d in ("b0", "b1"):
            put(f"{tmp_path}/{name}/main/{d}/results_1.json", f'{{"{d}": 1}}', 100)
    put(f"{tmp_path}/m 0/main/results_9.json", "{}")
    put(f"{tmp_path}/m 0/main/b0/other.json", "{}")
    put(f"{tmp_path}/results_9.json", "{}")
    os.makedirs(f"{tmp_path}/nothing/in it")
    settings = {name: spark.conf.get(name) for name in (
        "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes", "spark.sql.hive.filesourcePartitionFileCacheSize")}
    files = src.stage_result_files(spark, str(tmp_path), models_at_once=3)
    found = sorted(map(tuple, files.collect()))
    assert found == sorted(map(tuple, src.scan_result_files(spark, str(tmp_path)).collect())) and len(found) == 16
    # No listing of result files stays with the table, and settings are as before.
    assert "binaryFile" not in files._jdf.queryExecution().executedPlan().toString()
    assert settings == {name: spark.conf.get(name) for name in settings}
    for empty in ("nowhere", "nothing", "nothing/in it"):
        assert src.stage_result_files(spark, f"{tmp_path}/{empty}").count() == 0


def test_collect_query_scans_no_listing_of_all_files(spark, monkeypatch):
    """The collect's plan reads a written table: the driver holds no listing of all result files."""
    from workloads import q_runs
    from workloads.catalog import QUERIES, runner

    plans = []

    def seen(files, *args):
        plans.append(files._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(q_runs, "collect_run", seen)
    try:
        runner(QUERIES["collect_run"].build)(spark, "/root/testdata/sf0.001")
    except InterruptedError:
        pass
    assert len(plans) == 1 and "binaryFile" not in plans[0]


def test_streams_list_with_few_tasks(spark, tmp_path):
    """A batch lists its files by some tasks for each core, where each file had one."""
    for i in range(60):
        put(f"{tmp_path}/m{i}/main/b/results_1.json", '{"results": {}}')
    tracker, tasks = spark.sparkContext.statusTracker(), []
    stream = src.stream_result_files(spark, str(tmp_path), max_files=60)

    def counted(rows, batch):
        assert rows.count() == 60
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    before = {j for j in tracker.getJobIdsForGroup(None)}
    query = stream.writeStream.foreachBatch(counted).trigger(availableNow=True).start()
    query.awaitTermination()
    for job in {*tracker.getJobIdsForGroup(None), *tracker.getJobIdsForGroup(str(query.runId))} - before:
        for stage in tracker.getJobInfo(job).stageIds:
            if info := tracker.getStageInfo(stage):
                tasks.append(info.numTasks)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism


def test_listing_opens_no_content(spark, tmp_path):
    put(f"{tmp_path}/m/l/d/results_1.json", "{}")
    plan = src.scan_result_files(spark, str(tmp_path)).select("path", "mtime")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_control_files(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/r1/manifest.json", '{"m0--main": {"model_key":"m0","label":"main","step":null,"tokens_trained":100000000000}}')
    put(f"{root}/r1/map.json", '{"suite_a":["t_code","t_rc"],"suite_b":["t_rc"]}')
    put(f"{root}/r1/covered.json", '{"m0--main":["t_rc"]}')
    job = src.manifest_rows(src.read_documents(spark, f"{root}/*/manifest.json")).first()
    assert (job["run_id"], job["task_key"], job["step"], job["tokens_trained"]) == ("r1", "m0--main", None, 100_000_000_000)
    tasks = src.task_map_rows(src.read_documents(spark, f"{root}/*/map.json")).collect()
    assert sorted((r["suite"], r["suite_pos"], r["task"], r["pos"]) for r in tasks) == [
        ("suite_a", 0, "t_code", 0), ("suite_a", 0, "t_rc", 1), ("suite_b", 1, "t_rc", 0)]
    assert src.covered_pairs(src.read_documents(spark, f"{root}/*/covered.json")).first()["task"] == "t_rc"
    assert src.covered_pairs(src.read_documents(spark, f"{root}/none/covered.json")).count() == 0


def test_logs(spark, tmp_path):
    put(f"{tmp_path}/r1/completed.log", "m0--main\n\n   \n m1--x \nm0--main\n")
    put(f"{tmp_path}/r1/failed.log",
        "m1--ckpt 2025-01-01 00:00:01 eval_failures 17 2 evaluation(s)  failed\n\n"
        "m1--ckpt 2025-01-02 00:00:01 health_check_failed 18\nbad line\nm2--a 2025-01-02 00:00:01 r 19 some  info\n")
    keys = src.completed_keys(src.read_lines(spark, f"{tmp_path}/*/completed.log")).collect()
    assert sorted(r["task_key"] for r in keys) == ["m0--main", "m1--x"]
    failed = {r["task_key"]: r for r in src.failed_jobs(src.read_lines(spark, f"{tmp_path}/*/failed.log")).collect()}
    assert (failed["m1--ckpt"]["reason"], failed["m1--ckpt"]["job_id"], failed["m1--ckpt"]["info"]) == ("health_check_failed", "18", "")
    assert failed["m2--a"]["info"] == "some info" and len(failed) == 2


def test_queue(spark):
    snapshot = {"jobs": [
        {"name": "eval-m0--main", "job_id": 1, "job_state": ["RUNNING", "COMPLETING"]},
        {"name": "eval-m1--main", "job_id": 2, "job_state": "PENDING"},
        {"name": "eval-", "job_id": 3, "job_state": ["RUNNING"]},
        {"name": "eval-m2--main", "job_id": 4, "job_state": ["COMPLETED"]},
        {"name": "eval-m3--main", "job_id": 5, "job_state": ["COMPLETED", "COMPLETING"]}]}
    docs = spark.createDataFrame([("r", json.dumps(snapshot))], "run_id string, content string")
    got = [(r["task_key"], r["job_id"], r["state"]) for r in src.active_jobs(src.queue_rows(docs), "eval").orderBy("pos").collect()]
    assert got == [("m0--main", "1", "RUNNING"), ("m1--main", "2", "PENDING"), ("m3--main", "5", "COMPLETED")]


def test_group_definitions(spark, tmp_path):
    put(f"{tmp_path}/b.yaml", "group: suite_a\ntask: [g_x, {task: t_code}, 7]\naggregate_metric_list:\n"
        "  - {metric: acc, weight_by_size: true}\n  - {aggregation: mean}\n")
    put(f"{tmp_path}/a/z.yaml", "group: suite_a\ntask: [t_new]\n")
    put(f"{tmp_path}/a.yaml", "group: first\ntask: [t_1]\naggregate_metric_list: [{metric: f1, aggregation: max}]\n")
    put(f"{tmp_path}/c.yaml", "group: no_list\ntask: t\n")
    put(f"{tmp_path}/d.yaml", "task: only\n")
    put(f"{tmp_path}/e.yaml", "x: !function f.g\n")
    put(f"{tmp_path}/f.yaml", "- a\n- b\n")
    child, metric = src.read_group_defs(spark, [str(tmp_path)])
    rows = child.orderBy("grp_pos", "child_pos").collect()
    # The later definition of suite_a counts, at the place of the earlier one.
    assert [(r["grp"], r["child"]) for r in rows] == [("first", "t_1"), ("suite_a", "t_new")]
    assert [tuple(r) for r in metric.select("grp", "metric", "aggregation", "weight_by_size").collect()] == [("first", "f1", "max", False)]


def test_documents_are_read_as_by_the_safe_loader():
    import yaml

    from scoremart.sources.groups import read_document

    def outcome(load, text):
        try:
            return json.dumps(load(text), default=str)
        except (yaml.YAMLError, ValueError, TypeError) as e:
            return type(e)

    values = ["word", "yes", "Off", "~", "", "7", "-08", "0x1F", "1_000", "190:20", "1.5", ".5", "-.inf", "1e3", "2024-01-31", "2024-13-45",
              "'7'", '"a\\tb"', "!!str 7", "!!int '7'", "!!set {a, b}", "!!map x", "!!binary aGk=", "!own x", "&a [1, 2]", "*a", "&r [*r]", "=", "<<",
              "[a, {k: v, 2: w}, -]", "{a: 1, a: 2}", "{<<: {a: 1}, b: 2}", "{[a]: b}", "|\n  text\n  more", "a b # c", "a: b", "[a", "\ufeff", "\x01"]
    for value in values:
        for text in (f"{value}", f"k: {value}", f"{value}: k", f"- {value}\n- x", f"k:\n  - {value}\n  - j: {value}", f"k: {value}\n---\nl: 1"):
            assert outcome(read_document, text) == outcome(yaml.safe_load, text), text


def test_definitions_are_parsed_once_and_for_what_a_table_holds(spark):
    docs = [("a", "group: g\ntask: [x, {task: y}, 7, [z]]\naggregate_metric_list: [{metric: acc}]"), ("b", "group: h\ntask: one"),
            ("c", "group: i\ntask: {a: b}"), ("d", "task: [x]"), ("e", "group: g\ntask: [w]\naggregate_metric_list: 7"), ("f", "group: [")]
    child, metric = src.parse_group_defs(spark.createDataFrame(docs, "path string, content string"))
    assert [tuple(r) for r in child.collect()] == [("g", "a", "w", 0)] and metric.isEmpty()
    first = src.parse_group_defs(spark.createDataFrame(docs[:4], "path string, content string"))
    assert sorted(tuple(r) for r in first[0].collect()) == [("g", "a", "x", 0), ("g", "a", "y", 1)]
    assert [tuple(r) for r in first[1].select("grp", "metric", "metric_pos", "aggregation", "weight_by_size").collect()] == [("g", "acc", 0, "mean", False)]
    plan = child._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "weight_by_size" not in plan


def score_rows(spark, rows):
    from scoremart.operators.merge import conform

    return conform(spark.createDataFrame(rows, "model string, step long, task string, score double, day int").selectExpr(
        "model", "step", "task", "'acc' AS metric", "'none' AS metric_filter", "score", "'benchmark' AS task_type",
        "cast(date_add(date'2024-01-01', day) as timestamp_ntz) AS eval_date", "map('g', array(task)) AS subtask_tree"))


def bucket_files(root):
    import os

    found = {}
    for folder, _, names in os.walk(f"{root}/data"):
        if "bucket=" in folder:
            found[int(folder.rsplit("=", 1)[1])] = sorted(n for n in names if n.endswith(".parquet"))
    return found


def test_merge_writes_only_buckets_that_change(spark, tmp_path):
    from scoremart.sources import ScoreTable

    table = ScoreTable(spark, f"{tmp_path}/table")
    assert table.read().count() == 0
    table.lay_out(4, 2)
    rows = [(f"m{i % 23}", None if i % 2 else i, f"t{i % 13}", float(i), i % 5) for i in range(400)]
    assert table.merge(score_rows(spark, rows)).buckets == list(range(8))
    held, files = {tuple(r) for r in table.read().select("model", "step", "task", "score").collect()}, bucket_files(tmp_path / "table")
    change = table.merge(score_rows(spark, [("m3", 1000, "t5", 7.0, 1), ("m3", 2000, "t5", 8.0, 1)]))
    assert len(change.buckets) == 1
    diff = change.diff.first()
    assert (diff["old_rows"], diff["new_rows"], diff["genuine_added"], diff["changed"]) == (len(held), len(held) + 2, 2, 0)
    after = bucket_files(tmp_path / "table")
    assert {b for b in files if files[b] != after[b]} == set(change.buckets)
    assert {tuple(r) for r in table.read().select("model", "step", "task", "score").collect()} == held | {
        ("m3", 1000, "t5", 7.0), ("m3", 2000, "t5", 8.0)}
    # The same rows again, and older ones, change nothing and write nothing.
    assert table.merge(score_rows(spark, [("m3", 1000, "t5", 7.0, 1), ("m3", 2000, "t5", 9.0, 0)])).buckets == []
    assert bucket_files(tmp_path / "table") == after
    # A model is read from its own directories only.
    few = table.buckets_of_models(spark.createDataFrame([("m3",)], "model string"))
    assert len(few) == 2 and {r["model"] for r in table.read(few).collect()} >= {"m3"}
    # A bucket that loses its last row is emptied.
    rest = table.read().filter("model <> 'm3'")
    gone = table.rewrite(rest)
    assert gone.diff.first()["genuine_removed"] > 0 and table.read().filter("model = 'm3'").isEmpty()
    table.rewrite(rest.limit(0))
    assert table.read().count() == 0 and ScoreTable(spark, f"{tmp_path}/table").layout == (4, 2)
    assert src.read_scores(spark, f"{tmp_path}/missing").count() == 0


def test_layout(spark, tmp_path):
    import pytest
    from scoremart.sources import ScoreTable

    table = ScoreTable(spark, f"{tmp_path}/table")
    assert table.rewrite(score_rows(spark, [("m", 1, "t", 1.0, 1)])).buckets and table.layout == (4, 4)
    for size in (0, 1 << 20):
        with pytest.raises(ValueError):
            ScoreTable(spark, f"{tmp_path}/other").lay_out(size)
    with pytest.raises(ValueError):
        table.lay_out(2)


def test_export(spark):
    from scoremart.operators.merge import conform

    row = spark.sql("SELECT 'm' AS model, map('g', array('a','b')) AS subtask_tree, timestamp_ntz'2024-01-02 03:04:05.5' AS eval_date")
    out = src.export_form(conform(row)).first()
    assert out["subtask_tree"] == '{"g":["a","b"]}' and out["eval_date"] == "2024-01-02T03:04:05.500000+00:00"


def test_directory_names_stay_as_they_are(spark, tmp_path):
    """Signs that mean something in URLs, and an equals sign, are part of a name."""
    names = ("llama+sft", "lr=0.1", "a%41b")
    put(f"{tmp_path}/{'/'.join(names)}/results_1.json", "{}")
    row = src.scan_result_files(spark, str(tmp_path)).first()
    assert (row["model_key"], row["label"], row["dir"]) == names
    put(f"{tmp_path}/runs/a+b %41=1/completed.log", "k--main\n")
    assert src.completed_keys(src.read_lines(spark, f"{tmp_path}/runs/*/completed.log")).first()["run_id"] == "a+b %41=1"


def test_shared_folder_is_required_off_the_local_machine(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from scoremart import session

    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master, applicationId=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master))
    assert session.shared_dir(fake("local[4]")) and session.shared_dir(fake("local"))


def _laid_out(root):
    found = {}
    for path in glob.glob(f"{root}/*/*/*.txt"):
        with open(path, encoding="utf-8") as f:
            found.setdefault(os.path.relpath(os.path.dirname(path), root), []).append(f.read())
    return {k: sorted("".join(v).splitlines()) for k, v in found.items()}


def test_files_are_laid_out_like_a_partitioned_write(spark, tmp_path):
    rows = [("a", "x", "1"), ("a", "x", "ü2"), ("a", None, None), (None, "", "4"), ("p:q/r=%", "[s]", '{"k": 5}'), ("a", "x", "6")]
    df = spark.createDataFrame(rows, "m string, l string, content string").repartition(3, "m")
    lay_out_files(df, f"{tmp_path}/own", "content", "m", "l")
    df.write.partitionBy("m", "l").text(f"{tmp_path}/spark")
    assert _laid_out(f"{tmp_path}/own") == _laid_out(f"{tmp_path}/spark") and len(_laid_out(f"{tmp_path}/own")) == 4
    assert not glob.glob(f"{tmp_path}/own/*/*/.*")


def test_small_files_are_laid_out_by_several_tasks(spark):
    class Made:
        def __init__(self):
            self.spark = spark

    documents = spark.createDataFrame([(f"r{i}", f'{{"t{i}": ["x"]}}') for i in range(40)], "run_id string, content string")
    read = from_files(Made(), documents, "many")
    assert sorted(read.collect()) == sorted(documents.withColumn("content", F.concat("content", F.lit("\n"))).collect())
    tasks = {os.path.basename(p)[:10] for p in read.inputFiles()}
    assert len(tasks) > 1
