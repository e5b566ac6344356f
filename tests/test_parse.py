import json
import math

import pytest

from scoremart.operators import parse as p

DOC = r"""{"results": {
   "deu_arc": {"alias": " - deu_arc", "acc,none": 0.5, "acc_stderr,none": "N/A", "sample_len": 10},
   "ruler":   {"alias": "ruler", "4096,none": 0.9, "8192,none": -1, "delta,none": -1},
   "code":    {"alias": "", "pass@1,create_test": 0.25, "pass@1_stderr,create_test": 0.05},
   "bpb":     {"bits_per_byte,none": 0.8},
   "odd":     {"acc,a,b": "0.5", "x,none": NaN, "flag,none": true, "nothing,none": null},
   "suite":   {"alias": "suite", "acc,none": 0.5}},
 "configs": {"deu_arc": {"output_type": "multiple_choice", "doc_to_choice": ["A", "B"]},
             "ruler": {"output_type": "generate_until", "generation_kwargs": {"until": ["\n"]}},
             "code": {"output_type": "generate_until"}, "bpb": {"output_type": "loglikelihood"}, "odd": {}},
 "group_subtasks": {"suite": ["deu_arc", "inner"], "inner": ["code"]},
 "higher_is_better": {"deu_arc": {"acc": true}, "bpb": {"bits_per_byte": false}},
 "n-shot": {"deu_arc": 5}, "n-samples": {"deu_arc": {"original": 12, "effective": 10}},
 "versions": {"deu_arc": 1.0}, "task_hashes": {}, "date": 1700000000.5, "tokenizer_pad_token": ["<pad>", 0]}"""


@pytest.fixture(scope="module")
def files(spark):
    bad = ['{"results": {"arc"', "[1]", '{"results": {"a": {"x,none": [1]}}}', '{"results": {"a": {"x,none": 1}}, "n-shot": {"a": 1.5}}']
    rows = [("m0", "main", "d", "/p/0", DOC)] + [("m0", "main", "d", f"/p/{i}", c) for i, c in enumerate(bad, 1)]
    return spark.createDataFrame(rows, "model_key string, label string, dir string, path string, content string")


@pytest.fixture(scope="module")
def rows(files):
    return {(r["task"], r["metric"], r["metric_filter"]): r for r in p.parse_results_long(files).collect()}


def test_rows_found(rows):
    assert set(rows) == {
        ("deu_arc", "acc", "none"), ("ruler", "4096", "none"), ("ruler", "delta", "none"), ("code", "pass@1", "create_test"),
        ("bpb", "bits_per_byte", "none"), ("odd", "acc", "a,b"), ("odd", "x", "none"), ("odd", "flag", "none"),
        ("odd", "nothing", "none"), ("suite", "acc", "none"),
    }


def test_values(rows):
    arc = rows["deu_arc", "acc", "none"]
    assert (arc["score"], arc["score_stderr"], arc["n_samples"], arc["num_fewshot"]) == (0.5, None, 10, 5)
    assert (arc["task_formulation"], arc["language"], arc["parent_task"], arc["task_display_name"]) == (
        "rank_choice", "deu", "suite", "deu_arc")
    assert arc["higher_is_better"] is True and arc["task_type"] == "benchmark"
    assert arc["task_config"]["task_version"] == "1.0" and arc["task_config"]["doc_to_choice"] == '["A","B"]'
    assert arc["eval_config"]["tokenizer_pad_token"] == "<pad>"
    assert arc["eval_date"].isoformat() == "2023-11-14T22:13:20.500000"
    assert rows["ruler", "delta", "none"]["score"] == -1
    assert rows["code", "pass@1", "create_test"]["score_stderr"] == 0.05
    assert rows["code", "pass@1", "create_test"]["task_display_name"] == "code"
    assert rows["bpb", "bits_per_byte", "none"]["task_formulation"] == "bits_per_byte"
    assert rows["odd", "acc", "a,b"]["score"] is None
    assert math.isnan(rows["odd", "x", "none"]["score"])
    assert rows["odd", "flag", "none"]["score"] == 1.0 and rows["odd", "nothing", "none"]["score"] is None
    assert rows["odd", "x", "none"]["task_config"] is None
    suite = rows["suite", "acc", "none"]
    assert (suite["task_type"], suite["subtask_tree"]) == ("eval_suite", {"suite": ["deu_arc"]})


def test_quarantine(files):
    got = {r["path"]: r["reason"] for r in p.quarantine(files).collect()}
    assert got == {
        "/p/1": "unreadable", "/p/2": "unreadable", "/p/3": "nested metric value", "/p/4": "few-shot count is no integer",
    }


def test_jobs_give_step_and_training_facts(spark, files):
    jobs = spark.createDataFrame(
        [("m0", "main", 10, "/w", "", 100, None)],
        "model_key string, label string, step long, model_path string, display_name string, train_batch_size long, tokens_trained long",
    )
    r = p.parse_results_long(files, jobs).first()
    assert (r["step"], r["tokens_trained"], r["is_checkpoint"], r["model_display_name"]) == (10, 1000, True, "m0")


def test_one_parse_of_the_document(files):
    """The document is read once, and once more as a list member to see whether anything follows it."""
    plan = p.parse_with_verdicts(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 2 and "Exchange" not in plan
    verdicts = p.parse_with_verdicts(files)
    assert {(r["path"], r["reason"]) for r in p.rejected_files(verdicts).collect()} == {
        (r["path"], r["reason"]) for r in p.quarantine(files).collect()}
    assert verdicts.filter("reason is null").count() == 10


def document(**changes):
    doc = {"results": {"a": {"acc,none": 1, "acc_stderr,none": 0.5, "alias": "a"}}, "configs": {"a": {"output_type": "generate_until"}},
           "higher_is_better": {"a": {"acc": True}}, "n-shot": {"a": 1}, "n-samples": {"a": {"effective": 9}}, "task_hashes": {"a": "h"}}
    for path, value in changes.items():
        at, *keys = path.split("__")
        place = doc
        for key in [at, *keys][:-1]:
            place = place.setdefault(key, {})
        place[[at, *keys][-1]] = value
    return json.dumps(doc)


REJECTED = [
    (document() + " tail", "unreadable"), (document() + "{}", "unreadable"), (document()[:-1], "unreadable"), ("", "unreadable"), ("null", "unreadable"),
    (document(git_hash=5), "text field is no text"), (document(chat_template={"a": "b"}), "text field is no text"),
    (document(max_length="4k"), "length or token id is no integer"), (document(eot_token_id=1.5), "length or token id is no integer"),
    (document(total_evaluation_time_seconds="soon"), "evaluation time is no number"), (document(tokenizer_eos_token=[7]), "token is no text"),
    (document(results={"a": {"acc,none": {"x": 1}}}), "nested metric value"), (document(results={"a": {"acc,none": 1, "acc_stderr,none": []}}), "nested metric value"),
    (document(configs={"a": "text"}), "task config is no object"), (document(configs={"a": None}), "task config is no object"),
    (document(configs__a__dataset_path=3), "task config field is no text"), (document(configs__a__repeats="many"), "repeats is no integer"),
    (document(configs__a__should_decontaminate="perhaps"), "decontamination flag is no truth value"), (document(task_hashes={"a": 4}), "task hash is no text"),
    (document(results={"a": {"acc,none": 1, "alias": 5}}), "alias is no text"), (document(**{"n-shot": {"a": 1.5}}), "few-shot count is no integer"),
    (document(**{"n-samples": {"a": {"effective": 3.5}}}), "sample count is no integer"), (document(higher_is_better={"a": {"acc": "perhaps"}}), "direction is no truth value"),
    (document(higher_is_better={"a": None}), "direction is no truth value"),
]
ACCEPTED = [
    (document(max_length="4096", eot_token_id="1_0.0"), "eval_config.max_length = 4096 and eval_config.eot_token_id = 10"),
    (document(max_length=2.0), "eval_config.max_length = 2"), (document(max_length=True), "eval_config.max_length = 1"),
    (document(max_length=2**40), f"eval_config.max_length = {2**40}"),
    (document(total_evaluation_time_seconds=" 1e3 "), "eval_config.total_eval_time_seconds = 1000"),
    (document(tokenizer_pad_token="x", tokenizer_bos_token=[], tokenizer_eos_token=[None]), "eval_config.tokenizer_pad_token is null"),
    (document(configs__a__repeats="3", configs__a__should_decontaminate="YES"), "task_config.repeats = 3 and task_config.should_decontaminate"),
    (document(configs__a__should_decontaminate=0.0), "not task_config.should_decontaminate"),
    (document(configs={}), "task_config is null and task_type = 'task_group'"), (document(configs={"a": {}}), "task_config is null and task_type = 'benchmark'"),
    (document(**{"n-samples": {"a": 7}}), "n_samples is null"), (document(**{"n-samples": {"a": {"effective": "8"}}, "n-shot": {"a": False}}), "n_samples = 8 and num_fewshot = 0"),
    (document(higher_is_better={"a": {"acc": "off", "other": "perhaps"}}), "not higher_is_better"),
    # Facts of tasks without results, and of metrics that are no rows, are not looked at.
    (document(**{"n-shot": {"a": 1, "b": 1.5}}, configs__b=5), "score = 1"), (document(results={"a": {"acc,none": 1, "8192,none": -1, "len": []}}), "score = 1"),
    (document(results={"a": {"acc,none": True, "acc_stderr,none": "N/A", "alias": None}}), "score = 1 and score_stderr is null and task_display_name = 'a'"),
    ("  " + document() + " \n", "score = 1"),
]


def test_rules_of_every_field(spark):
    cases = REJECTED + ACCEPTED
    rows = [("m", "l", "d", str(i), text) for i, (text, _) in enumerate(cases)]
    files = spark.createDataFrame(rows, "model_key string, label string, dir string, path string, content string")
    verdicts = p.parse_with_verdicts(files).cache()
    found = {r["path"]: r["reason"] for r in p.rejected_files(verdicts).collect()}
    assert found == {str(i): reason for i, (_, reason) in enumerate(REJECTED)}
    for i, (text, condition) in enumerate(ACCEPTED, len(REJECTED)):
        mine = verdicts.filter(f"result_source = '{i}'")
        assert mine.count() == 1 == mine.filter(condition).count(), (text, condition)


def test_deep_tree(spark):
    doc = """{"results": {"a": {"m,none": 1}, "g1": {"m,none": 1}, "g2": {"m,none": 1}, "g3": {"m,none": 1}, "b": {"k,none": 1}},
              "configs": {"a": {"x": 1}}, "group_subtasks": {"g3": ["g2", "b"], "g2": ["g1", "a"], "g1": ["a"]}}"""
    files = spark.createDataFrame([("m", "l", "d", "p", doc)], "model_key string, label string, dir string, path string, content string")
    trees = {r["task"]: r["subtask_tree"] for r in p.parse_results_long(files).filter("metric = 'm'").collect()}
    assert trees["g3"] == {"g3": ["g2"], "g2": ["g1", "a"], "g1": ["a"]} and trees["a"] is None


def test_job_of_two_runs(spark, files):
    """Each run gets the rows with its own facts, and keeps only its own tasks."""
    jobs = spark.createDataFrame(
        [("r1", "m0", "main", 1, "/a", "A", 1, 1), ("r2", "m0", "main", 1, "/b", "B", 1, 1)],
        "run_id string, model_key string, label string, step long, model_path string, display_name string, train_batch_size long, tokens_trained long",
    )
    tasks = spark.createDataFrame([("r1", "deu_arc"), ("r2", "bpb")], "run_id string, task string")
    rows = p.filter_allowed_tasks(p.parse_results_long(files, jobs), tasks).collect()
    assert sorted((r["run_id"], r["task"], r["model_path"]) for r in rows) == [("r1", "deu_arc", "/a"), ("r2", "bpb", "/b")]


def test_facts_that_are_not_used_are_not_computed(spark):
    good = json.dumps({"results": {"t": {"acc,none": 1}}, "configs": {"t": {"doc_to_text": "x"}}})
    rows = [("m", "l", "d", "p1", None, good), ("m", "l", "d", "p2", None, "{")]
    files = spark.createDataFrame(rows, "model_key string, label string, dir string, path string, mtime timestamp, content string")
    parsed = p.parse_with_verdicts(files)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_to_text" in plan(parsed.select("task_config")) and "doc_to_text" not in plan(parsed.select("language"))
    bad = parsed.filter("reason is not null").first().asDict()
    facts = ["task", "task_type", "parent_task", "task_display_name", "language", "n_samples", "task_config", "metric", "score", "subtask_tree"]
    assert [bad[c] for c in facts] == [None] * len(facts) and bad["reason"] == "unreadable" and bad["result_source"] == "p2"
