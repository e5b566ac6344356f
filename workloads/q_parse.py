"""Result files, control files and the document parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoremart import sources as src
from scoremart.operators import maintain as k
from scoremart.operators import parse as p
from scoremart.session import scratch_path
from scoremart.sources.results import latest_per_dir, scan_result_files

from .fixtures import lay_out_files, plain_names
from .registry import query

_FILE = "model, label, dir"

# What the parser must find, from the rows the documents were built of.
PARSED = dict(
    file_ok="SELECT model, label, dir, max(eval_date) AS mtime FROM file_rows GROUP BY model, label, dir HAVING count(*) % 7 <> 0",
    in_file="""SELECT r.*, f.mtime, max(r.n_samples) OVER (PARTITION BY r.model, r.label, r.dir, r.task) AS n FROM file_rows r
        JOIN file_ok f ON r.model = f.model AND r.label = f.label AND r.dir = f.dir""",
    tasks="SELECT DISTINCT model, label, step, dir, task, k, n, mtime FROM in_file",
    leaves="""SELECT model, label, step, dir, task, k, n, mtime, metric, metric_filter, score,
            CASE WHEN score_stderr IS NULL THEN NULL ELSE CAST(score_stderr AS DOUBLE) END AS score_stderr FROM in_file
        UNION ALL SELECT model, label, step, dir, task, k, n, mtime, 'delta', 'none', -1, NULL FROM tasks WHERE k = 3
        UNION ALL SELECT model, label, step, dir, task, k, n, mtime, 'bits_per_byte', 'none', 0.5, NULL FROM tasks WHERE k = 9
        UNION ALL SELECT model, label, step, dir, task, k, n, mtime, 'text', 'a,b', NULL, NULL FROM tasks WHERE k = 4""",
    parsed="""SELECT model, label, step, dir, task, k, n, mtime, metric, metric_filter, score, score_stderr, 'benchmark' AS task_type,
            concat('region_', CAST(k % 5 AS VARCHAR)) AS parent_task FROM leaves
        UNION ALL SELECT model, label, step, dir, concat('region_', CAST(k % 5 AS VARCHAR)), NULL, NULL, any_value(mtime), 'acc', 'none',
            count(*), NULL, 'task_group', 'world' FROM tasks GROUP BY model, label, step, dir, k % 5
        UNION ALL SELECT model, label, step, dir, 'world', NULL, NULL, any_value(mtime), 'acc', 'none',
            count(DISTINCT k % 5), NULL, 'eval_suite', NULL FROM tasks GROUP BY model, label, step, dir""",
)

_ID = ["model", "label", "dir", "task", "metric", "metric_filter"]
_ID_SQL = "model, label, dir, task, metric, metric_filter"


def rows(d, jobs=None):
    return p.parse_results_long(d.documents(), jobs)


def parsed(name: str, sql: str, *columns):
    """A query that projects parsed rows, for one aspect of the parser."""

    @query(name, f"SELECT {_ID_SQL}, {sql} FROM parsed", **PARSED)
    def _(d):
        return rows(d).selectExpr(*_ID, *columns)


parsed("parse_results_long", "step, score", "step", "score")
parsed("pair_stderr", "score_stderr", "score_stderr")
parsed("classify_task_type", "task_type", "task_type")
parsed("child_parent_map", "parent_task", "parent_task")
parsed(
    "derive_formulation",
    """CASE k % 4 WHEN 0 THEN 'rank_choice' WHEN 2 THEN 'generative' WHEN 3 THEN 'bits_per_byte'
       WHEN 1 THEN CASE WHEN k = 9 THEN 'bits_per_byte' ELSE 'rank_choice' END END AS task_formulation""",
    "task_formulation",
)
parsed(
    "detect_language",
    "CASE WHEN task LIKE 'deu%' THEN 'deu' WHEN task LIKE 'fin%' THEN 'fin' ELSE 'eng' END AS language",
    "language",
)
parsed("display_name", "CASE k % 5 WHEN 1 THEN concat('The - ', task) ELSE task END AS task_display_name", "task_display_name")
parsed(
    "task_attribute_lookup",
    """k AS num_fewshot, n AS n_samples, CASE WHEN k IS NOT NULL THEN '1.0' END AS version,
       CASE WHEN k IS NULL THEN NULL WHEN metric = 'acc' THEN true WHEN metric = 'em' THEN false END AS higher_is_better""",
    "num_fewshot",
    "n_samples",
    "task_config.task_version AS version",
    "higher_is_better",
)
parsed(
    "eval_config_struct",
    """'0.4.10' AS harness, CAST(4096 AS BIGINT) AS max_length, CAST(12.5 AS DOUBLE) AS seconds, '<pad>' AS pad,
       CAST(NULL AS VARCHAR) AS eos, CAST(NULL AS VARCHAR) AS bos, CAST(NULL AS BIGINT) AS eot, model AS model_name, true AS others_null""",
    "eval_config.lm_eval_version AS harness",
    "eval_config.max_length",
    "eval_config.total_eval_time_seconds AS seconds",
    "eval_config.tokenizer_pad_token AS pad",
    "eval_config.tokenizer_eos_token AS eos",
    "eval_config.tokenizer_bos_token AS bos",
    "eval_config.eot_token_id AS eot",
    "eval_config.model_name",
    """coalesce(eval_config.git_hash, eval_config.transformers_version, eval_config.model_source, eval_config.chat_template,
       eval_config.chat_template_sha, eval_config.system_instruction, eval_config.system_instruction_sha) IS NULL AS others_null""",
)
parsed(
    "task_config_struct",
    """CASE WHEN k IS NOT NULL THEN concat('d', k) END AS dataset_path, CASE k % 4 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'loglikelihood' WHEN 2 THEN 'generate_until'
       WHEN 3 THEN 'loglikelihood_rolling' END AS output_type, k AS repeats, CASE WHEN k IS NOT NULL THEN 'x' END AS doc_to_text,
       CASE WHEN k IS NOT NULL THEN '["A","B"]' END AS doc_to_choice, task_type <> 'benchmark' AS no_config,
       CASE WHEN k IS NOT NULL THEN '1.0' END AS task_version, true AS others_null""",
    "task_config.dataset_path",
    "task_config.output_type",
    "task_config.repeats",
    "task_config.doc_to_text",
    "task_config.doc_to_choice",
    "task_config IS NULL AS no_config",
    "task_config.task_version",
    """coalesce(task_config.task_hash, task_config.dataset_name, task_config.doc_to_target, task_config.generation_kwargs,
       CAST(task_config.should_decontaminate AS STRING)) IS NULL AS others_null""",
)
parsed(
    "eval_date",
    "strftime(mtime, '%Y-%m-%d 00:00:00.500') AS evaluated",
    "date_format(eval_date, 'yyyy-MM-dd HH:mm:ss.SSS') AS evaluated",
)


@query("filter_metric_keys", "SELECT model, label, dir, count(*) AS n_rows, count(DISTINCT task) AS n_tasks FROM parsed GROUP BY model, label, dir", **PARSED)
def _(d):
    return rows(d).groupBy("model", "label", "dir").agg(
        F.count("*").alias("n_rows"), F.count_distinct("task").alias("n_tasks")
    )


@query("drop_sentinel", "SELECT model, label, dir, task, metric, score FROM parsed", **PARSED)
def _(d):
    return rows(d).select("model", "label", "dir", "task", "metric", "score")


@query("split_metric_key", "SELECT DISTINCT task, metric, metric_filter FROM parsed", **PARSED)
def _(d):
    return rows(d).select("task", "metric", "metric_filter").distinct()


@query("null_string_values", f"SELECT {_ID_SQL}, score IS NULL AS no_score, score_stderr IS NULL AS no_stderr FROM parsed", **PARSED)
def _(d):
    return rows(d).select(*_ID, F.col("score").isNull().alias("no_score"), F.col("score_stderr").isNull().alias("no_stderr"))


@query("subtask_tree_filtered", f"""
    SELECT t.model, t.label, t.dir, r.root AS task, r.node, r.child FROM (SELECT DISTINCT {_FILE} FROM tasks) t JOIN (
        SELECT DISTINCT {_FILE}, concat('region_', k % 5) AS root, concat('region_', k % 5) AS node, task AS child FROM leaves WHERE metric = 'acc'
        UNION SELECT DISTINCT {_FILE}, 'world', concat('region_', k % 5), task FROM leaves WHERE metric = 'acc'
        UNION SELECT DISTINCT {_FILE}, 'world', 'world', concat('region_', k % 5) FROM tasks
    ) r ON t.model = r.model AND t.label = r.label AND t.dir = r.dir""", **PARSED)
def _(d):
    trees = rows(d).select("model", "label", "dir", "task", F.explode("subtask_tree").alias("node", "children"))
    return trees.select("model", "label", "dir", "task", "node", F.explode("children").alias("child"))


@query("derive_training_meta", """SELECT model, step, result_source, coalesce(train_batch_size, CASE WHEN step > 0 THEN
        coalesce(tokens_trained, train_batch_size * step) // step END) AS train_batch_size,
        coalesce(tokens_trained, train_batch_size * step) AS tokens_trained FROM scores""")
def _(d):
    return p.derive_training_meta(d.scores).select("model", "step", "result_source", "train_batch_size", "tokens_trained")


# What is done to the documents of each seventeenth model, and why the file is rejected then; the last one is accepted.
_WORLD = '{"alias": "world", "acc,none": '
DAMAGE = [
    ("}", "}", None),
    ('"n-shot": {', '"n-shot": {"world": 1.5, ', "few-shot count is no integer"),
    ('"lm_eval_version": "0.4.10"', '"lm_eval_version": 0.4', "text field is no text"),
    ('"max_length": 4096', '"max_length": "4k"', "length or token id is no integer"),
    ('"total_evaluation_time_seconds": "12.5"', '"total_evaluation_time_seconds": "soon"', "evaluation time is no number"),
    ('"tokenizer_pad_token": ["<pad>", 0]', '"tokenizer_pad_token": [7]', "token is no text"),
    (_WORLD, '{"alias": "world", "x,none": [1], "acc,none": ', "nested metric value"),
    ('"configs": {', '"configs": {"world": "text", ', "task config is no object"),
    ('{"output_type": ', '{"dataset_name": 5, "output_type": ', "task config field is no text"),
    ('"repeats": ', '"repeats": "many", "others": ', "repeats is no integer"),
    ('"doc_to_text": "x"', '"doc_to_text": "x", "should_decontaminate": "perhaps"', "decontamination flag is no truth value"),
    (_WORLD, '{"alias": 5, "acc,none": ', "alias is no text"),
    ('"n-samples": {', '"n-samples": {"world": {"effective": 3.5}, ', "sample count is no integer"),
    ('"higher_is_better": {', '"higher_is_better": {"world": {"acc": "perhaps"}, ', "direction is no truth value"),
    ('"tokenizer_eos_token": "</s>"', '"tokenizer_eos_token": ["</s>"], "chat_template": {}', "text field is no text"),
    ('"task_hashes": {}', '"task_hashes": {}} {', "unreadable"),
    ('"max_length": 4096', '"max_length": " 4_096.0 ", "eot_token_id": true', None),
]
_REASONS = " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, _, reason) in enumerate(DAMAGE) if reason)


def damaged(d):
    number = F.substring("model_key", 2, 20).cast("bigint") % len(DAMAGE)
    content = F.col("content")
    for i, (old, new, _) in enumerate(DAMAGE):
        content = F.when(number == i, F.replace("content", F.lit(old), F.lit(new))).otherwise(content)
    return d.documents().withColumn("content", content)


@query("parse_quarantine", f"""SELECT * FROM (SELECT model AS model_key, label, dir, CASE WHEN count(*) % 7 = 0 THEN 'unreadable' ELSE
        CASE CAST(substring(model, 2) AS BIGINT) % {len(DAMAGE)} {_REASONS} END END AS reason FROM file_rows GROUP BY model, label, dir) f WHERE reason IS NOT NULL""")
def _(d):
    return p.rejected_files(p.parse_with_verdicts(damaged(d))).select("model_key", "label", "dir", "reason")


@query("filter_allowed_tasks", f"""SELECT m.run_id, {', '.join('p.' + c.strip() for c in _ID_SQL.split(','))}, p.score FROM parsed p
        JOIN manifest m ON p.model = m.model_key AND p.label = m.label JOIN (SELECT DISTINCT run_id, task FROM task_map) t
        ON t.run_id = m.run_id AND t.task = p.task""", **PARSED)
def _(d):
    return p.filter_allowed_tasks(rows(d, d.manifest), d.task_map).select("run_id", *_ID, "score")


@query("row_defaults", f"""SELECT {', '.join('p.' + c.strip() for c in _ID_SQL.split(','))}, p.step, p.step IS NOT NULL AS is_checkpoint,
        CASE WHEN m.display_name = '' THEN m.model_key ELSE m.display_name END AS model_display_name, m.train_batch_size,
        coalesce(m.tokens_trained, m.train_batch_size * m.step) AS tokens_trained
        FROM parsed p JOIN manifest m ON p.model = m.model_key AND p.label = m.label""", **PARSED)
def _(d):
    return rows(d, d.manifest).select(
        *_ID, "step", "is_checkpoint", "model_display_name", "train_batch_size", "tokens_trained"
    )


# ── files ────────────────────────────────────────────────────────────────────────────


def write_result_files(d, root):
    """Lay the documents out as files, one directory per (model, label, dir)."""
    lay_out_files(d.documents(for_files=True), root, "content", "model_key", "label", "dir")
    return root


@query("scan_result_files", "SELECT model AS model_key, label, dir, count(*) % 7 <> 0 AS whole FROM file_rows GROUP BY model, label, dir")
def _(d):
    root = write_result_files(d, scratch_path(d.spark, "results"))
    # Spark wrote the fixture, so names end in .txt; real result files match the default pattern.
    files = plain_names(scan_result_files(d.spark, root, glob="*.txt"), "model_key", "label", "dir")
    return files.select("model_key", "label", "dir", F.rlike("content", F.lit(r"\}\s*$")).alias("whole"))


_DIRS = """SELECT model AS model_key, label, concat('batch_', CAST(k AS STRING), '_0') AS dir,
    concat('/out/', model, '/', label, '/', CAST(k AS STRING), result_source, '/', CAST(n_samples AS STRING)) AS path,
    eval_date AS mtime, CAST(NULL AS STRING) AS content FROM scores"""


@query("latest_file_per_dir", """SELECT model_key, label, dir, path FROM dirs WHERE (model_key, label) IN
        (SELECT (model_key, label) FROM manifest WHERE display_name <> '')
        QUALIFY rank() OVER (PARTITION BY model_key, label, dir ORDER BY mtime DESC NULLS LAST, path DESC) = 1""", dirs=_DIRS)
def _(d):
    jobs = d.manifest.filter("display_name <> ''")
    return latest_per_dir(d.sql(_DIRS), jobs).select("model_key", "label", "dir", "path")


# ── control files ────────────────────────────────────────────────────────────────────


def _file_tasks(d):
    """Tasks that lay out files: a number of their own, since the many files of a run's control data hold few bytes."""
    return int(d.spark.conf.get("spark.sql.shuffle.partitions"))


def from_files(d, documents, name):
    """The documents written as one file per run, and read back as control files."""
    root = scratch_path(d.spark, name)
    lay_out_files(documents.select("run_id", "content").repartition(_file_tasks(d), "run_id"), root, "content", "run_id")
    return plain_names(src.read_documents(d.spark, f"{root}/*/*.txt"), "run_id")


def _documents(df, key, value):
    """One JSON object per run; a run's control data is bounded by its own configuration."""
    entries = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col(key).alias("key"), value.alias("value")).alias("e")))), lambda x: x["e"]))
    return df.groupBy("run_id").agg(F.to_json(entries).alias("content"))


def manifest_documents(d):
    entry = F.struct("model_key", "label", "step", "model_path", "display_name", "train_batch_size", "tokens_trained")
    return _documents(d.manifest, "task_key", entry)


@query("scan_manifest", """SELECT run_id, task_key, model_key, label, step, model_path, display_name, train_batch_size, tokens_trained,
        row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS pos FROM manifest""")
def _(d):
    return src.manifest_rows(from_files(d, manifest_documents(d), "manifest"))


def suite_documents(d):
    lists = d.task_map.groupBy("run_id", "suite").agg(
        F.min("suite_pos").alias("pos"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "task"))), lambda t: t["task"]).alias("tasks"),
    )
    return _documents(lists, "suite", F.col("tasks"))


@query("scan_task_map", """SELECT run_id, suite, dense_rank() OVER (PARTITION BY run_id ORDER BY suite_pos) - 1 AS suite_pos, task,
        row_number() OVER (PARTITION BY run_id, suite ORDER BY pos) - 1 AS pos FROM task_map""")
def _(d):
    return src.task_map_rows(from_files(d, suite_documents(d), "task-map"))


@query("scan_covered", "SELECT DISTINCT run_id, concat(model, '--', label) AS task_key, task FROM scores WHERE side = 'O' AND metric = 'acc'")
def _(d):
    pairs = d.sql("SELECT DISTINCT run_id, concat(model, '--', label) AS task_key, task FROM scores WHERE side = 'O' AND metric = 'acc'")
    lists = pairs.groupBy("run_id", "task_key").agg(F.sort_array(F.collect_set("task")).alias("tasks"))
    return src.covered_pairs(from_files(d, _documents(lists.withColumn("pos", F.col("task_key")), "task_key", F.col("tasks")), "covered"))


def completed_from_files(d):
    root = scratch_path(d.spark, "completed")
    lay_out_files(d.completed_lines.repartition(_file_tasks(d), "run_id"), root, "line", "run_id")
    return src.completed_keys(plain_names(src.read_lines(d.spark, f"{root}/*/*.txt"), "run_id"))


@query("scan_completed_log", "SELECT run_id, task_key FROM completed")
def _(d):
    return completed_from_files(d)


def failed_from_files(d):
    root = scratch_path(d.spark, "failed")
    lines = d.failed_lines.select("run_id", "line_order", "line").repartition(_file_tasks(d), "run_id").sortWithinPartitions("run_id", "line_order")
    lay_out_files(lines, root, "line", "run_id")
    return src.failed_jobs(plain_names(src.read_lines(d.spark, f"{root}/*/*.txt"), "run_id"))


@query("scan_failed_log", """SELECT run_id, job_key AS task_key, concat(day, ' 00:00:00') AS timestamp,
        CASE o_orderstatus WHEN 'P' THEN 'eval_failures' WHEN 'O' THEN 'health_check_failed' ELSE 'manual_cancellation' END AS reason,
        CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 'some info' ELSE '' END AS info
        FROM (SELECT * FROM failed_lines WHERE o_orderpriority <> '4-NOT SPECIFIED') f
        QUALIFY row_number() OVER (PARTITION BY run_id, job_key ORDER BY line_order DESC) = 1""")
def _(d):
    return failed_from_files(d)


def queue_documents(d):
    """Queue snapshots, one JSON document per run, with job_state as text or as a list."""
    job = F.concat(
        F.lit('{"name": "'), "name", F.lit('", "job_id": '), "job_id", F.lit(', "job_state": '),
        F.when(F.col("two_states"), F.concat(F.lit('["'), "state", F.lit('", "COMPLETING"]'))).otherwise(F.concat(F.lit('"'), "state", F.lit('"'))),
        F.lit("}"),
    )
    jobs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", job.alias("j")))), lambda x: x["j"]), ", ")
    return d.queue.groupBy("run_id").agg(F.concat(F.lit('{"jobs": ['), jobs, F.lit("]}")).alias("content"))


def active_from_files(d):
    return src.active_jobs(src.queue_rows(from_files(d, queue_documents(d), "queue")), "eval")


@query("scan_job_queue", "SELECT run_id, task_key, job_id, state FROM active")
def _(d):
    return active_from_files(d).select("run_id", "task_key", "job_id", "state")


# One definition file per line item; a group is defined by several files and the last one counts.
_DEFS = """SELECT concat('defs/', lpad(CAST(l_linenumber AS STRING), 3, '0'), '/', lpad(CAST(l_partkey AS STRING), 12, '0'), '/',
        lpad(CAST(l_suppkey AS STRING), 12, '0'), '/', CAST(l_extendedprice AS STRING), '/', CAST(l_orderkey AS STRING), '.yaml') AS path,
    concat('order_', CAST(l_orderkey AS STRING)) AS grp, concat('part_', CAST(l_partkey AS STRING)) AS first_child,
    concat('supp_', CAST(l_suppkey AS STRING)) AS second_child, l_returnflag = 'R' AS weighted FROM {lineitem}"""
_LAST_DEF = dict(defs=_DEFS, last_def="SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY path DESC) = 1")


def group_tables(d):
    yaml = F.concat(
        F.lit("group: "), "grp", F.lit("\ntask: ["), "first_child", F.lit(", {task: "), "second_child", F.lit("}, 7]\naggregate_metric_list:\n"),
        F.lit("  - {metric: acc, weight_by_size: "), F.col("weighted").cast("string"), F.lit("}\n  - {aggregation: mean}\n"),
    )
    # A task parses and sorts a bounded number of files, whatever the cluster.
    n_parts = max(d.spark.sparkContext.defaultParallelism, d.lineitem.count() // 100_000)
    return src.parse_group_defs(d.sql(_DEFS).select("path", yaml.alias("content")).repartition(n_parts))


@query("scan_group_defs", """SELECT grp, first_child AS child, 0 AS child_pos FROM last_def UNION ALL SELECT grp, second_child, 1 FROM last_def""", **_LAST_DEF)
def _(d):
    return group_tables(d)[0].select("grp", "child", "child_pos")


@query("scan_group_metrics", "SELECT grp, 'acc' AS metric, 'mean' AS aggregation, weighted AS weight_by_size FROM last_def", **_LAST_DEF)
def _(d):
    return group_tables(d)[1].select("grp", "metric", "aggregation", "weight_by_size")


# ── compaction ───────────────────────────────────────────────────────────────────────

# Sides F and O of a checkpoint are its files; the newer one wins per key.
_COMPACT = dict(
    **PARSED,
    entry_keys=f"""SELECT model, label, dir, mtime, task, concat(metric, ',', metric_filter) AS key, score AS num FROM leaves
        UNION ALL SELECT model, label, dir, mtime, task, 'sample_len', 10 FROM tasks
        UNION ALL SELECT model, label, dir, mtime, task, concat(metric, ',', metric_filter), score FROM parsed WHERE task_type <> 'benchmark'""",
    winners="""SELECT * FROM entry_keys QUALIFY row_number() OVER (PARTITION BY model, label, task, key ORDER BY mtime DESC, dir DESC) = 1""",
)


@query("compact_results", "SELECT model AS model_key, label, task, key, num FROM winners", **_COMPACT)
def _(d):
    entries = k.compact_entries(d.documents().filter(F.col("content").isNotNull()))
    return entries.filter("section = 'results' and key <> 'alias' and key not like '%\\_stderr,%'").select(
        "model_key", "label", "task", "key", p.numeric_or_null(F.col("value")).alias("num")
    )


@query("compact_report", """SELECT model AS model_key, label, count(DISTINCT task) AS tasks_merged,
        (SELECT count(DISTINCT dir) FROM file_rows f WHERE f.model = e.model AND f.label = e.label) AS dirs_superseded
        FROM entry_keys e GROUP BY model, label UNION ALL
        SELECT model, label, 0, count(DISTINCT dir) FROM file_rows WHERE (model, label) NOT IN (SELECT (model, label) FROM entry_keys) GROUP BY model, label""", **_COMPACT)
def _(d):
    files = d.documents()
    return k.compact_report(files, k.compact_entries(files))


@query("compact_documents", "SELECT model AS model_key, label, task, key, num FROM winners", **_COMPACT)
def _(d):
    merged = k.compact_documents(k.compact_entries(d.documents())).withColumn("dir", F.lit("compacted")).withColumn(
        "mtime", F.lit("2030-01-01").cast("timestamp_ntz")
    ).withColumn("path", F.concat(F.lit("/out/"), "model_key", "label"))
    entries = k.compact_entries(merged)
    return entries.filter("section = 'results' and key <> 'alias' and key not like '%\\_stderr,%'").select(
        "model_key", "label", "task", "key", p.numeric_or_null(F.col("value")).alias("num")
    )


@query("compact_safe_dirs", """SELECT DISTINCT model AS model_key, label, dir FROM file_rows WHERE substring(model, 2) NOT IN
        (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)""")
def _(d):
    active = d.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("job_id"))
    return k.safe_files(d.documents(), active).select("model_key", "label", "dir")


@query("completed_on_disk", "SELECT DISTINCT model AS model_key, label, task FROM parsed", **PARSED)
def _(d):
    return p.completed_tasks(d.documents())
