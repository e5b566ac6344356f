"""Evaluation tables derived from the given tables.

The SQL below runs unchanged in Spark and in DuckDB, so that a query and its check start
from the same rows.  ``{name}`` stands for a given table.  Everything is computed from whole
tables: suppliers are models, line items are score rows, orders are queue and log entries,
nations and regions are the small task graph, and customers, orders and lines a large one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def task_name(k: str) -> str:
    return (
        f"concat(CASE {k} % 4 WHEN 0 THEN 'deu_' WHEN 1 THEN 'eng_' WHEN 2 THEN 'fin_' ELSE '' END,"
        f" 'n', CAST({k} AS STRING))"
    )


def run_of(key: str) -> str:
    return f"concat('r', CAST(CAST(floor({key} / 10) AS BIGINT) AS STRING))"


# Score rows, many per key.  Scores are whole numbers in doubles: sums are exact.
SCORES = f"""
SELECT concat('m', CAST(l_suppkey AS STRING)) AS model,
       {run_of('l_suppkey')} AS run_id,
       CASE WHEN l_linenumber <= 2 THEN CAST(NULL AS BIGINT) WHEN l_linenumber <= 5 THEN 1000 ELSE 2000 END AS step,
       CASE WHEN l_linenumber <= 2 THEN 'main' WHEN l_linenumber <= 5 THEN 'checkpoint_1000' ELSE 'checkpoint_2000' END AS label,
       {task_name('k')} AS task, k,
       CASE l_returnflag WHEN 'A' THEN 'acc' WHEN 'N' THEN 'f1' ELSE 'em' END AS metric,
       CASE WHEN k = 7 OR (k = 5 AND l_linestatus = 'O') THEN 'strict' ELSE 'none' END AS metric_filter,
       CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN NULL ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS score,
       CAST(l_quantity AS BIGINT) - 1 AS n_samples,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL ELSE l_shipdate END AS eval_date,
       concat('/r/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_partkey AS STRING)) AS result_source,
       l_linestatus AS side,
       CASE k % 4 WHEN 0 THEN 'deu' WHEN 2 THEN 'fin' ELSE 'eng' END AS language,
       CASE WHEN l_discount = 0.06 THEN NULL ELSE (l_returnflag <> 'R') <> (k = 11) END AS higher_is_better,
       CASE WHEN l_tax = 0 THEN '' WHEN l_tax = 0.01 THEN NULL
            ELSE concat('/w/', CAST(l_suppkey AS STRING), '/', CAST(k AS STRING)) END AS model_path,
       CASE WHEN l_tax = 0.02 THEN '' ELSE concat('Model ', CAST(l_suppkey AS STRING), '-', CAST(k % 3 AS STRING)) END AS model_display_name,
       CASE WHEN l_discount = 0.05 THEN NULL WHEN l_discount = 0.04 THEN 0 ELSE 1024 * (k + 1) END AS train_batch_size,
       CASE WHEN l_discount = 0.03 THEN 1000000000000 * (k + 1) ELSE NULL END AS tokens_trained,
       'benchmark' AS task_type
FROM (SELECT *, l_partkey % 25 AS k FROM {{lineitem}}) AS keyed
"""

# Group rows that are already in the shared table: one per model, task and group type.
OLD_AGGREGATES = f"""
SELECT concat('m', CAST(s_suppkey AS STRING)) AS model, CAST(NULL AS BIGINT) AS step,
       concat('region_', CAST(s_nationkey % 5 AS STRING)) AS task, 'acc' AS metric, 'none' AS metric_filter,
       CAST(s_suppkey AS DOUBLE) AS score, 'task_group' AS task_type
FROM {{supplier}}
UNION ALL
SELECT concat('m', CAST(s_suppkey AS STRING)), CAST(NULL AS BIGINT), concat('elsewhere_', CAST(s_nationkey % 3 AS STRING)),
       'acc', 'none', CAST(s_suppkey AS DOUBLE), 'task_group'
FROM {{supplier}}
"""

GROUP_CHILD = f"""
SELECT concat('region_', CAST(n_regionkey AS STRING)) AS grp, CAST(n_regionkey AS BIGINT) AS grp_pos,
       {task_name('n_nationkey')} AS child, CAST(n_nationkey AS BIGINT) AS child_pos FROM {{nation}}
UNION ALL SELECT 'world', 100, concat('region_', CAST(r_regionkey AS STRING)), CAST(r_regionkey AS BIGINT) FROM {{region}}
UNION ALL SELECT 'west', 50, concat('region_', CAST(r_regionkey AS STRING)), CAST(r_regionkey AS BIGINT) FROM {{region}}
          WHERE r_name IN ('AFRICA', 'AMERICA')
UNION ALL SELECT 'small', 101, 'west', CAST(r_regionkey AS BIGINT) FROM {{region}} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'small', 101, {task_name('n_nationkey')}, CAST(n_nationkey AS BIGINT) FROM {{nation}} WHERE n_name IN ('NATION_3', 'NATION_5')
UNION ALL SELECT 'lone', 60, {task_name('n_nationkey')}, CAST(n_nationkey AS BIGINT) FROM {{nation}} WHERE n_name = 'NATION_3'
"""

GROUP_METRIC = """
SELECT concat('region_', CAST(r_regionkey AS STRING)) AS grp, 'acc' AS metric, false AS weight_by_size FROM {region}
UNION ALL SELECT concat('region_', CAST(r_regionkey AS STRING)), 'f1', true FROM {region}
UNION ALL SELECT concat('region_', CAST(r_regionkey AS STRING)), 'em', true FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'world', 'acc', true FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'world', 'f1', false FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'world', 'em', false FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'west', 'acc', false FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'west', 'f1', false FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'small', 'acc', true FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'small', 'f1', false FROM {region} WHERE r_name = 'AFRICA'
UNION ALL SELECT 'lone', 'acc', false FROM {region} WHERE r_name = 'AFRICA'
"""

SUITES = """
SELECT CASE r_name WHEN 'AFRICA' THEN 'world' ELSE 'small' END AS task FROM {region} WHERE r_name IN ('AFRICA', 'AMERICA')
"""

# The large graph: nation -> customer -> order -> part.
BIG_CHILD = """
SELECT concat('nation_', CAST(c_nationkey AS STRING)) AS grp, CAST(c_nationkey AS BIGINT) AS grp_pos,
       concat('cust_', CAST(c_custkey AS STRING)) AS child, CAST(c_custkey AS BIGINT) AS child_pos FROM {customer}
UNION ALL SELECT concat('cust_', CAST(o_custkey AS STRING)), 100 + o_custkey,
       concat('order_', CAST(o_orderkey AS STRING)), CAST(o_orderkey AS BIGINT) FROM {orders}
UNION ALL SELECT concat('order_', CAST(l_orderkey AS STRING)), 1000000000 + l_orderkey,
       concat('part_', CAST(l_partkey AS STRING)), CAST(l_linenumber AS BIGINT) FROM {lineitem}
"""

_JOB = "concat('m', CAST(s_suppkey AS STRING))"
_JOB_COLS = f"""{run_of('s_suppkey')} AS run_id, concat({_JOB}, '--%s') AS task_key, {_JOB} AS model_key, '%s' AS label,
       CAST(%s AS BIGINT) AS step, s_suppkey * 10 + %d AS pos, concat('/w/', CAST(s_suppkey AS STRING)) AS model_path,
       CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS display_name, CAST(4096 AS BIGINT) AS train_batch_size,
       CASE WHEN s_acctbal > 5000 THEN CAST(36000000000000 AS BIGINT) ELSE NULL END AS tokens_trained"""
MANIFEST = " UNION ALL ".join(
    f"SELECT {_JOB_COLS % (label, label, step, pos)} FROM {{supplier}}"
    for pos, (label, step) in enumerate([("main", "NULL"), ("checkpoint_1000", "1000"), ("checkpoint_2000", "2000")])
)
# A plan with other jobs: models with a negative balance left, final checkpoints came in.
MANIFEST_NEW = f"""SELECT run_id, task_key FROM manifest WHERE display_name <> ''
UNION ALL SELECT run_id, concat(model_key, '--checkpoint_3000') FROM manifest WHERE label = 'checkpoint_2000' AND tokens_trained IS NOT NULL"""

TASK_MAP = """
SELECT DISTINCT run_id, concat('suite_', metric) AS suite,
       CASE metric WHEN 'acc' THEN 0 WHEN 'f1' THEN 1 ELSE 2 END AS suite_pos, task, k AS pos
FROM scores WHERE n_samples >= 48
"""
DISK = "SELECT DISTINCT model AS model_key, label, task FROM scores WHERE side = 'O' AND metric = 'acc'"
SHARED = "SELECT model, step, task FROM scores WHERE side = 'F' AND metric = 'f1'"

_ORDER_KEY = """concat('m', CAST(o_custkey AS STRING), '--', CASE o_orderpriority WHEN '2-HIGH' THEN 'main'
       WHEN '3-MEDIUM' THEN 'checkpoint_1000' ELSE 'checkpoint_2000' END)"""
QUEUE = f"""
SELECT {run_of('o_custkey')} AS run_id, o_orderkey AS pos,
       concat(CASE WHEN o_orderpriority = '1-URGENT' THEN 'other-' ELSE 'eval-' END, {_ORDER_KEY}) AS name,
       {_ORDER_KEY} AS job_key, CAST(o_orderkey AS STRING) AS job_id,
       CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'RUNNING' ELSE 'COMPLETED' END AS state,
       o_orderstatus = 'O' AS two_states
FROM {{orders}}
"""
ACTIVE = """
SELECT run_id, pos, job_key AS task_key, job_id, state FROM queue WHERE name LIKE 'eval-%' AND state <> 'COMPLETED'
"""
FAILED_LINES = f"""
SELECT {run_of('o_custkey')} AS run_id, o_orderkey AS line_order,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'too short a line'
            ELSE concat(' ', {_ORDER_KEY}, ' ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' 00:00:00 ',
                        CASE o_orderstatus WHEN 'P' THEN 'eval_failures' WHEN 'O' THEN 'health_check_failed' ELSE 'manual_cancellation' END,
                        ' ', CAST(o_orderkey AS STRING), CASE WHEN o_orderpriority = '2-HIGH' THEN '  some   info ' ELSE '' END) END AS line,
       {_ORDER_KEY} AS job_key, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderstatus, o_orderkey
FROM {{orders}}
"""
COMPLETED_LINES = f"""
SELECT {run_of('c_custkey')} AS run_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN concat('  m', CAST(c_custkey AS STRING), '--main ')
            WHEN 'AUTOMOBILE' THEN concat('m', CAST(c_custkey AS STRING), '--checkpoint_1000')
            WHEN 'MACHINERY' THEN concat('m', CAST(c_custkey AS STRING), '--checkpoint_2000') ELSE '   ' END AS line
FROM {{customer}}
UNION ALL
SELECT {run_of('c_custkey')}, concat('m', CAST(c_custkey AS STRING), '--main') FROM {{customer}} WHERE c_mktsegment = 'BUILDING'
"""
COMPLETED = "SELECT DISTINCT run_id, trim(line) AS task_key FROM completed_lines WHERE trim(line) <> ''"

# Catalogue entries; lists are comma-separated text until each engine splits them.
ENTRIES = f"""
SELECT {run_of('s_suppkey')} AS run_id, s_name AS config_key, concat('/w/', CAST(s_suppkey AS STRING)) AS path,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE concat('m.', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING)) END AS model_key,
       CASE WHEN s_nationkey < 6 THEN NULL WHEN s_nationkey < 15 THEN 'checkpoint_{{{{step}}}}' ELSE 'iter{{{{step}}}}*' END AS checkpoint_pattern,
       CASE WHEN s_nationkey BETWEEN 5 AND 9 THEN '1000,3000,5000' WHEN s_nationkey = 20 THEN '' ELSE NULL END AS steps_text,
       concat('Model ', s_name) AS display_name,
       CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey * 1024 AS BIGINT) END AS train_batch_size,
       CASE WHEN s_nationkey IN (7, 8) THEN '5B,6.5B,7.25B' WHEN s_nationkey IN (9, 21) THEN '5B,6B'
            WHEN s_nationkey IN (1, 2, 12) THEN '1.5T' ELSE NULL END AS tokens_text,
       s_nationkey IN (7, 8, 9, 21) AS tokens_is_list,
       CASE WHEN s_acctbal > 5000 THEN CAST(656000 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS step_offset
FROM {{supplier}}
"""
LISTING = """
SELECT DISTINCT concat('/w/', CAST(l_suppkey AS STRING)) AS base,
       CASE l_returnflag WHEN 'A' THEN concat('checkpoint_00', CAST(l_linenumber * 1000 AS STRING))
            WHEN 'N' THEN concat('iter', CAST(l_linenumber * 1000 AS STRING), '_hf')
            ELSE concat('checkpoint_', CAST(l_linenumber AS STRING), 'x') END AS name
FROM {lineitem}
"""

# Rows inside result files: one file per (model, label, side).
FILE_ROWS = """
SELECT model, label, step, side, concat('batch_', substring(model, 2), CASE side WHEN 'F' THEN '_0' ELSE '_1' END) AS dir,
       task, k, metric, metric_filter, max(score) AS score, max(n_samples) AS n_samples, max(eval_date) AS eval_date,
       CASE WHEN metric_filter = 'none' THEN (max(n_samples) + 1) / 8.0 ELSE NULL END AS score_stderr
FROM scores GROUP BY model, label, step, side, task, k, metric, metric_filter
"""

#: Named tables in dependency order; a table may use given tables and earlier ones.
CTES = {
    "scores": SCORES,
    "old_aggregates": OLD_AGGREGATES,
    "group_child": GROUP_CHILD,
    "group_metric": GROUP_METRIC,
    "suites": SUITES,
    "big_child": BIG_CHILD,
    "manifest": MANIFEST,
    "manifest_new": MANIFEST_NEW,
    "task_map": TASK_MAP,
    "disk": DISK,
    "shared": SHARED,
    "queue": QUEUE,
    "active": ACTIVE,
    "failed_lines": FAILED_LINES,
    "completed_lines": COMPLETED_LINES,
    "completed": COMPLETED,
    "entries": ENTRIES,
    "listing": LISTING,
    "file_rows": FILE_ROWS,
}


def duck(text: str) -> str:
    """The text as DuckDB runs it: table marks become names, doubled braces single ones."""
    return re.sub(r"\{(\w+)\}", r"\1", text.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}")


def with_tables(body: str, **more: str) -> str:
    """A DuckDB statement that has all derived tables in scope."""
    parts = [f"{name} AS ({duck(sql)})" for name, sql in {**CTES, **more}.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


class Data:
    """Given and derived tables of one directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in CTES:
                self._made[name] = self.sql(CTES[name])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run a fixture; derived tables are referred to by name, given ones as ``{name}``."""
        used = {n for n in TABLES if f"{{{n}}}" in text}
        for name in CTES:
            marked = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
            if marked != text:
                text, used = marked, used | {name}
        return self.spark.sql(text, **{n: self.table(n) for n in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in CTES or name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    # ── forms that only the Spark side needs ─────────────────────────────────

    def entry_rows(self) -> DataFrame:
        """Catalogue entries with typed lists."""
        from scoremart.functions import parse_human_int

        steps = F.when(
            F.col("steps_text") == "", F.array().cast("array<bigint>")
        ).otherwise(F.split("steps_text", ",").cast("array<bigint>"))
        return self.entries.withColumn("steps", steps).withColumn(
            "tokens_trained", F.transform(F.split("tokens_text", ","), parse_human_int)
        )

    def documents(self, for_files: bool = False) -> DataFrame:
        """Raw result files built from ``file_rows``; every seventh row count gives a torn file.

        A file holds at most 25 tasks with a few metrics each, at any scale.  Documents to be laid out as files are dealt by
        all of ``file_rows``'s file columns: those without a model share a directory, and within a task a file.
        """
        file_keys = ["model", "label", "step", "side", "dir"]
        num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit('"N/A"'))
        metric = F.concat(
            F.lit('"'), "metric", F.lit(","), "metric_filter", F.lit('": '), num("score"),
            F.lit(', "'), "metric", F.lit("_stderr,"), "metric_filter", F.lit('": '), num("score_stderr"),
        )
        # One exchange of scores with a fixed number of partitions serves all aggregations; the
        # documents stay spread out, since parsing costs far more than their size suggests.
        n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if for_files:
            file_rows = self.file_rows.repartition(n_parts, *file_keys)
        else:
            scores = self.scores.repartition(n_parts, "model", "label", "step", "side")
            file_rows = self.spark.sql(FILE_ROWS.replace("FROM scores", "FROM {scores}"), scores=scores)
        tasks = (
            file_rows.withColumn("metric_json", metric)
            .groupBy(*file_keys, "task", "k")
            .agg(
                F.array_join(F.sort_array(F.collect_list("metric_json")), ", ").alias("metrics"),
                F.max("n_samples").alias("n"),
                F.max("eval_date").alias("eval_date"),
                F.count("*").alias("n_rows"),
            )
        )
        q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        kind = F.element_at(
            F.array(*[F.lit(t) for t in ("multiple_choice", "loglikelihood", "generate_until", "loglikelihood_rolling")]),
            (F.col("k") % 4 + 1).cast("int"),
        )
        per_task = tasks.select(
            *file_keys, "k", "n", "eval_date", "n_rows", "task",
            F.concat(
                q(F.col("task")), F.lit(': {"alias": '),
                F.when(F.col("k") % 5 == 0, F.lit('""')).when(F.col("k") % 5 == 1, F.concat(F.lit('" - The - '), "task", F.lit(' - "'))).otherwise(F.concat(F.lit('" - '), "task", F.lit('"'))),
                F.lit(', "sample_len": 10, '),
                F.when(F.col("k") == 3, F.lit('"4096,none": -1, "delta,none": -1, ')).otherwise(F.lit("")),
                F.when(F.col("k") == 9, F.lit('"bits_per_byte,none": 0.5, ')).otherwise(F.lit("")),
                F.when(F.col("k") == 4, F.lit('"text,a,b": "0.5", ')).otherwise(F.lit("")),
                "metrics", F.lit("}"),
            ).alias("result"),
            F.concat(
                q(F.col("task")), F.lit(': {"output_type": '), q(kind), F.lit(', "dataset_path": "d'), F.col("k").cast("string"),
                F.lit('", "doc_to_text": "x", "doc_to_choice": ["A", "B"], "repeats": '), F.col("k").cast("string"), F.lit("}"),
            ).alias("config"),
            F.concat(q(F.col("task")), F.lit(': {"acc": true, "em": false}')).alias("hib"),
            F.concat(q(F.col("task")), F.lit(": "), F.col("k").cast("string")).alias("shot"),
            F.concat(q(F.col("task")), F.lit(': {"original": 99, "effective": '), F.col("n").cast("string"), F.lit("}")).alias("samples"),
            F.concat(q(F.col("task")), F.lit(": 1.0")).alias("version"),
        )
        listed = lambda c: F.array_join(F.transform(F.sort_array(F.col("ts")), lambda t: t[c]), ", ")
        groups = F.sort_array(F.array_distinct(F.transform("ts", lambda t: t["k"] % 5)))
        members = lambda g: F.transform(F.filter(F.sort_array("ts"), lambda t: t["k"] % 5 == g), lambda t: q(t["task"]))
        group_name = lambda g: F.concat(F.lit('"region_'), g.cast("string"), F.lit('"'))
        group_rows = F.array_join(
            F.transform(groups, lambda g: F.concat(group_name(g), F.lit(': {"alias": "", "acc,none": '), F.size(members(g)).cast("string"), F.lit("}"))), ", "
        )
        group_lists = F.array_join(
            F.transform(groups, lambda g: F.concat(group_name(g), F.lit(": ["), F.array_join(members(g), ", "), F.lit("]"))), ", "
        )
        files = per_task.groupBy(*file_keys).agg(
            F.collect_list(F.struct("k", "task", "result", "config", "hib", "shot", "samples", "version")).alias("ts"),
            F.max("eval_date").alias("mtime"),
            F.sum("n_rows").alias("n_rows"),
        )
        world = F.array_join(F.transform(groups, group_name), ", ")
        content = F.concat(
            F.lit('{"results": {'), listed("result"), F.lit(', "world": {"alias": "world", "acc,none": '), F.size(groups).cast("string"),
            F.lit("}, "), group_rows, F.lit('}, "configs": {'), listed("config"),
            F.lit('}, "group_subtasks": {"world": ['), world, F.lit("], "), group_lists,
            F.lit('}, "higher_is_better": {'), listed("hib"), F.lit('}, "n-shot": {'), listed("shot"),
            F.lit('}, "n-samples": {'), listed("samples"), F.lit('}, "versions": {'), listed("version"),
            F.lit('}, "task_hashes": {}, "date": '),
            (F.datediff(F.col("mtime").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).cast("string"),
            F.lit('.5, "lm_eval_version": "0.4.10", "max_length": 4096, "total_evaluation_time_seconds": "12.5", '
                  '"tokenizer_pad_token": ["<pad>", 0], "tokenizer_eos_token": "</s>", "model_name": "'),
            F.col("model"), F.lit('"}'),
        )
        torn = F.col("n_rows") % 7 == 0
        return files.select(
            F.col("model").alias("model_key"),
            "label",
            "dir",
            F.concat(F.lit("/out/"), "model", F.lit("/"), "label", F.lit("/"), "dir", F.lit("/results_1.json")).alias("path"),
            "mtime",
            F.when(torn, F.substring(content, F.lit(1), F.length(content) - 5)).otherwise(content).alias("content"),
            "step",
        )


_NOT_IN_NAMES = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def folder(column: str, value: str | None) -> str:
    """The directory that Spark's partitioned writer gives a value."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}={_NOT_IN_NAMES.sub(lambda m: f'%{ord(m[0]):02X}', value)}"


def local_path(spark, path: str) -> str | None:
    """The path on a disk that all tasks share, or null if another file system holds it."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    parts = urlsplit(path)
    if (parts.scheme or urlsplit(default).scheme) != "file":
        return None
    return unquote(parts.path) if parts.scheme else path


def lay_out_files(rows: DataFrame, root: str, line: str, *columns: str) -> None:
    """Lay text out in one file per task and value of ``columns``, with a directory per column, as a partitioned write does.

    On a local disk the tasks write plain files, as the programs do whose files these stand for: Hadoop's local file system
    starts four processes for each file, which takes most of the time where files are small.  Rows of a file are written in
    their order; a task's files are complete before they get their names, so a task may run again.
    """
    rows = rows.select(*columns, line)
    base = local_path(rows.sparkSession, root)
    if base is None:
        rows.write.partitionBy(*columns).text(root)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, own, made, n = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}", {}, 0
        for batch in batches:
            # Neighbouring rows of a file share one opening of it.
            held, texts = None, []
            for *values, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = tuple(values)
                if place != held:
                    _append(base, columns, held, texts, name + own, made)
                    held, texts = place, []
                texts.append("" if text is None else text)
            _append(base, columns, held, texts, name + own, made)
            n += batch.num_rows
        for path in made.values():
            os.replace(f"{path}/.{name}{own}", f"{path}/{name}.txt")
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    os.makedirs(base)
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _append(base: str, columns: tuple[str, ...], values: tuple | None, texts: list[str], name: str, made: dict) -> None:
    if not texts:
        return
    if values not in made:
        made[values] = os.path.join(base, *map(folder, columns, values))
        os.makedirs(made[values], exist_ok=True)
    with open(f"{made[values]}/.{name}", "a", encoding="utf-8", newline="") as f:
        f.writelines(f"{text}\n" for text in texts)


def plain_names(files: DataFrame, *columns: str) -> DataFrame:
    """Directory names of files that Spark wrote as ``column=value``, without the column."""
    return files.withColumns({c: F.regexp_replace(c, f"^{c}=", "") for c in columns})
