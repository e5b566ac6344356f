"""Merge, de-duplication, assembly and diff of score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoremart.operators import diff as df_
from scoremart.operators import maintain as k
from scoremart.operators import merge as m
from scoremart.schemas import KEY
from scoremart.session import scratch_path, stage
from scoremart.sources import ScoreTable
from scoremart.sources import tables as t
from scoremart.plans.collect import assemble_into, push_merge

from .registry import near, query
from .rollup_sql import LATEST, ROLLED

OUT = [*KEY, "score", "n_samples", "date_format(eval_date, 'yyyy-MM-dd') AS eval_day", "result_source"]
OUT_SQL = """model, step, task, metric, metric_filter, score, n_samples,
    strftime(eval_date, '%Y-%m-%d') AS eval_day, result_source"""
KEY_SQL = "model, step, task, metric, metric_filter"


def sides(d):
    """(existing, incoming) score tables."""
    return d.scores.filter("side = 'F'"), d.scores.filter("side = 'O'")


def side_latest(side: str) -> str:
    return f"""SELECT * FROM scores WHERE side = '{side}' QUALIFY row_number() OVER (PARTITION BY {KEY_SQL}
        ORDER BY eval_date DESC NULLS LAST, result_source DESC, score DESC NULLS LAST, n_samples DESC) = 1"""


@query("union_diagonal", f"SELECT {OUT_SQL}, language FROM (SELECT * EXCLUDE language, NULL AS language FROM scores WHERE side = 'F' "
       "UNION ALL SELECT * EXCLUDE language, language FROM scores WHERE side = 'O') u")
def _(d):
    old, new = sides(d)
    return m.union_diagonal(old.drop("language"), new).selectExpr(*OUT, "language")


@query("dedup_latest", f"SELECT {OUT_SQL} FROM latest", latest=LATEST)
def _(d):
    return m.merge_and_dedup(*sides(d)).selectExpr(*OUT)


@query(
    "repair_token_types",
    "SELECT model, result_source, score, CAST(tokens_trained AS BIGINT) AS tokens_trained, CAST(train_batch_size AS BIGINT) AS train_batch_size FROM scores",
)
def _(d):
    widened = d.scores.withColumn("tokens_trained", F.col("tokens_trained").cast("double")).withColumn(
        "train_batch_size", F.col("train_batch_size").cast("string")
    )
    return m.repair_token_types(widened).select("model", "result_source", "score", "tokens_trained", "train_batch_size")


@query("sort_key_nulls_first", f"SELECT {OUT_SQL} FROM latest ORDER BY model, step NULLS FIRST, task, metric, metric_filter", latest=LATEST)
def _(d):
    return m.sort_by_key(m.merge_and_dedup(*sides(d))).selectExpr(*OUT)


_RUN_MODELS = "SELECT DISTINCT model_key AS model FROM manifest WHERE display_name <> ''"
_SHARED_TABLE = f"""SELECT {KEY_SQL}, score, task_type, 'x' AS origin FROM ({side_latest('F')}) s
    UNION ALL SELECT {KEY_SQL}, score, task_type, 'x' FROM old_aggregates"""


def run_models(d):
    return d.manifest.filter("display_name <> ''").select(F.col("model_key").alias("model")).distinct()


def shared_table(d):
    """An existing table: benchmark rows and older aggregates."""
    return m.union_diagonal(m.dedup_latest(m.conform(sides(d)[0])), d.old_aggregates)


@query("restrict_run_models", f"""SELECT {KEY_SQL}, score, task_type = 'benchmark' AND model IN (FROM run_models) AS of_run
        FROM shared_table WHERE model NOT IN (FROM run_models) OR task_type = 'benchmark'""",
       run_models=_RUN_MODELS, shared_table=_SHARED_TABLE)
def _(d):
    table, models = shared_table(d), run_models(d)
    mine = m.restrict_models(table, models).withColumn("of_run", F.lit(True))
    others = m.other_models(table, models).withColumn("of_run", F.lit(False))
    return mine.unionByName(others).select(*KEY, "score", "of_run")


@query("drop_stale_aggregates", f"SELECT {KEY_SQL}, score FROM shared_table WHERE task_type = 'benchmark'", shared_table=_SHARED_TABLE)
def _(d):
    return m.drop_stale_aggregates(shared_table(d)).select(*KEY, "score")


@query("preserve_foreign_aggregates", f"""SELECT {KEY_SQL}, score FROM shared_table
        WHERE task_type <> 'benchmark' AND model IN (FROM run_models) AND task NOT IN (SELECT grp FROM group_child)""",
       run_models=_RUN_MODELS, shared_table=_SHARED_TABLE)
def _(d):
    fresh = d.group_child.select(F.col("grp").alias("task"))
    return m.preserve_foreign_aggregates(shared_table(d), run_models(d), fresh).select(*KEY, "score")


@query("reclassify_suites", f"""SELECT {KEY_SQL}, CASE WHEN task LIKE 'elsewhere%' THEN 'eval_suite' ELSE task_type END AS task_type FROM shared_table""",
       shared_table=_SHARED_TABLE)
def _(d):
    suites = d.old_aggregates.filter("task like 'elsewhere%'").select("task")
    return m.reclassify_suites(shared_table(d), suites).select(*KEY, "task_type")


@query("assemble_scores", f"""
    SELECT {KEY_SQL}, round(score + 0.000001, 5) AS score, task_type FROM shared_table WHERE model NOT IN (FROM run_models)
    UNION ALL SELECT {KEY_SQL}, round(score + 0.000001, 5), task_type FROM leaf
    UNION ALL SELECT {KEY_SQL}, round(score + 0.000001, 5), task_type FROM shared_table
        WHERE model IN (FROM run_models) AND task_type <> 'benchmark' AND task NOT IN (SELECT task FROM rolled)
    UNION ALL SELECT {KEY_SQL}, round(score + 0.000001, 5), task_type FROM rolled""",
       run_models=_RUN_MODELS, shared_table=_SHARED_TABLE,
       latest=f"""SELECT * FROM (SELECT * FROM scores WHERE side = 'O' OR model IN (FROM run_models)) s
            QUALIFY row_number() OVER (PARTITION BY {KEY_SQL}
            ORDER BY eval_date DESC NULLS LAST, side DESC, result_source DESC, score DESC NULLS LAST, n_samples DESC) = 1
            AND model IN (FROM run_models)""",
       **ROLLED)
def _(d):
    # Local results come from the run's own models only, as result discovery follows the manifest.
    local = m.restrict_models(sides(d)[1], run_models(d))
    table = ScoreTable(d.spark, scratch_path(d.spark, "shared"))
    table.rewrite(shared_table(d))
    assemble_into(table, local, run_models(d), *(stage(g, "graph") for g in (d.group_child, d.group_metric, d.suites)))
    return table.read().select(*KEY, near("score"), "task_type")


@query("push_merge", f"SELECT {OUT_SQL} FROM latest", latest=LATEST)
def _(d):
    root = scratch_path(d.spark, "shared")
    old, new = sides(d)
    ScoreTable(d.spark, root).rewrite(m.dedup_latest(m.conform(old)))
    return push_merge(root, new).selectExpr(*OUT)


_DIFF = dict(
    old_t=side_latest("F"),
    new_t=side_latest("O"),
    both=f"""SELECT coalesce(o.model, n.model) AS model, coalesce(o.step, n.step) AS step, coalesce(o.task, n.task) AS task,
        coalesce(o.metric, n.metric) AS metric, coalesce(o.metric_filter, n.metric_filter) AS metric_filter,
        o.model IS NOT NULL AS in_old, n.model IS NOT NULL AS in_new, o.score AS score_old, n.score AS score_new
        FROM old_t o FULL JOIN new_t n ON o.model = n.model AND o.step IS NOT DISTINCT FROM n.step AND o.task = n.task
        AND o.metric = n.metric AND o.metric_filter = n.metric_filter""",
)


def versions(d):
    old, new = sides(d)
    return m.dedup_latest(m.conform(old)), m.dedup_latest(m.conform(new))


@query("diff_added_removed", f"SELECT {KEY_SQL}, CASE WHEN in_new THEN 'added' ELSE 'removed' END AS change FROM both_t WHERE in_old <> in_new",
       **{("both_t" if n == "both" else n): s for n, s in _DIFF.items()})
def _(d):
    return df_.diff_added_removed(*versions(d))


_DIFF = {("both_t" if n == "both" else n): s for n, s in _DIFF.items()}


@query("diff_changed_values", f"""SELECT {KEY_SQL}, score_old, score_new FROM both_t
        WHERE in_old AND in_new AND score_old IS DISTINCT FROM score_new""", **_DIFF)
def _(d):
    return df_.diff_changed_values(*versions(d))


_SUMMARY = """SELECT old_rows, new_rows, new_rows - old_rows AS net, least(added, removed) AS churned,
    added - least(added, removed) AS genuine_added, removed - least(added, removed) AS genuine_removed, changed FROM (
    SELECT count_if(in_old) AS old_rows, count_if(in_new) AS new_rows, count_if(in_new AND NOT {m}) AS added,
    count_if(in_old AND NOT {m}) AS removed, count_if({m} AND score_old IS DISTINCT FROM score_new) AS changed FROM both_t) c"""


@query("diff_summary", _SUMMARY.replace("{m}", "(in_old AND in_new)"), **_DIFF)
def _(d):
    return df_.diff_summary(*versions(d))


@query("diff_summary_null_steps_differ", _SUMMARY.replace("{m}", "(in_old AND in_new AND step IS NOT NULL)"), **_DIFF)
def _(d):
    return df_.diff_summary(*versions(d), null_keys_equal=False)


@query("manifest_diff", """SELECT coalesce(o.run_id, n.run_id) AS run_id, coalesce(o.task_key, n.task_key) AS task_key,
        CASE WHEN o.run_id IS NULL THEN 'added' ELSE 'removed' END AS change
        FROM manifest o FULL JOIN manifest_new n ON o.run_id = n.run_id AND o.task_key = n.task_key
        WHERE o.run_id IS NULL OR n.run_id IS NULL""")
def _(d):
    return df_.manifest_diff(d.manifest, d.manifest_new)


@query("suite_diff", """SELECT coalesce(o.run_id, n.run_id) AS run_id, coalesce(o.suite, n.suite) AS suite,
        CASE WHEN o.run_id IS NULL THEN 'added' ELSE 'removed' END AS change
        FROM (SELECT DISTINCT run_id, suite FROM task_map) o
        FULL JOIN (SELECT DISTINCT run_id, concat('suite_', metric_filter) AS suite FROM scores UNION
                   SELECT DISTINCT run_id, suite FROM task_map WHERE suite <> 'suite_em') n
        ON o.run_id = n.run_id AND o.suite = n.suite WHERE o.run_id IS NULL OR n.run_id IS NULL""")
def _(d):
    kept = d.task_map.filter("suite <> 'suite_em'").select("run_id", "suite")
    new = d.scores.select("run_id", F.concat(F.lit("suite_"), "metric_filter").alias("suite")).unionByName(kept)
    return df_.suite_diff(d.task_map, new)


# ── storage ──────────────────────────────────────────────────────────────────────────


@query("read_scores", f"SELECT {OUT_SQL} FROM scores")
def _(d):
    path = scratch_path(d.spark, "scores")
    m.conform(d.scores).write.parquet(path)
    return t.read_scores(d.spark, path).selectExpr(*OUT)


@query("write_scores", f"SELECT {OUT_SQL} FROM latest", latest=LATEST)
def _(d):
    table = ScoreTable(d.spark, scratch_path(d.spark, "table"))
    for side in sides(d):
        table.merge(side)
    return table.read().selectExpr(*OUT)


@query("scores_sql_view", """SELECT model, metric, count(*) AS n, sum(score) AS total, max(n_samples) AS most FROM latest
        WHERE language = 'eng' GROUP BY model, metric""", latest=LATEST)
def _(d):
    t.publish_view(m.merge_and_dedup(*sides(d)), "scores")
    return d.spark.sql(
        "SELECT model, metric, count(*) AS n, sum(score) AS total, max(n_samples) AS most FROM scores "
        "WHERE language = 'eng' GROUP BY model, metric"
    )


@query("export_scores", f"""SELECT {KEY_SQL}, score, result_source, strftime(eval_date, '%Y-%m-%dT%H:%M:%S+00:00') AS eval_date,
        concat('{{"region_', CAST(k % 5 AS VARCHAR), '":["', task, '"]}}') AS subtask_tree FROM scores""")
def _(d):
    trees = F.create_map(F.concat(F.lit("region_"), (F.col("k") % 5).cast("string")), F.array("task"))
    rows = m.conform(d.scores.withColumn("subtask_tree", trees))
    return t.export_form(rows).select(*KEY, "score", "result_source", "eval_date", "subtask_tree")


# ── maintenance ──────────────────────────────────────────────────────────────────────

_BROKEN = """CASE k WHEN 1 THEN 'arc_challenge_x' WHEN 2 THEN 'fin_gsm_symbolic' WHEN 3 THEN 'humaneval_fim_py' WHEN 4 THEN 'deu_arc_challenge'
    ELSE task END"""
_DROPS = dict(broken=f"SELECT * EXCLUDE (task, language), {_BROKEN} AS task, CASE WHEN k = 6 OR score IS NULL THEN NULL ELSE language END AS language FROM scores")
_MASK = "coalesce((task LIKE '%arc_challenge%' AND language = 'eng') OR task LIKE '%gsm_symbolic%' OR task LIKE '%humaneval_fim%', false)"


def broken(d):
    return d.scores.withColumn("language", F.when(~((F.col("k") == 6) | F.col("score").isNull()), F.col("language"))).withColumn(
        "task", F.expr(_BROKEN)
    )


@query("drop_rows", f"SELECT {KEY_SQL}, score, language, result_source FROM broken WHERE NOT {_MASK}", **_DROPS)
def _(d):
    return k.drop_rows(broken(d), k.invalid_rows()).select(*KEY, "score", "language", "result_source")


@query("drop_rows_counts", f'SELECT count(*) AS "before", count_if({_MASK}) AS dropped, count_if(NOT {_MASK}) AS "after" FROM broken', **_DROPS)
def _(d):
    return k.drop_rows_counts(broken(d), k.invalid_rows())


@query("drop_rows_preview", f"SELECT DISTINCT model, step, task, metric FROM broken WHERE {_MASK}", **_DROPS)
def _(d):
    return k.drop_rows_preview(broken(d), k.invalid_rows())


_NAMES = """SELECT concat('m', CAST(CAST(floor(c_custkey / 15) AS BIGINT) AS STRING)) AS model_key, c_mktsegment AS file, c_custkey AS pos,
    CASE WHEN c_acctbal < 0 THEN '' WHEN c_mktsegment = 'MACHINERY' THEN NULL
         ELSE concat('Model ', CAST(CAST(floor(c_custkey / 15) AS BIGINT) AS STRING), '-', CAST(c_custkey % 3 AS STRING)) END AS display_name FROM {customer}"""
_SYNC = dict(
    latest=LATEST,
    names=_NAMES,
    mapping="""SELECT model_key AS model, arg_max(display_name, {{'f': file, 'p': pos}}) AS new_name FROM names
        WHERE display_name <> '' AND model_key <> '' GROUP BY model_key""",
    renamed="""SELECT l.model, new_name, arg_min(model_display_name, {{'s': coalesce(step, -1), 't': task, 'm': metric, 'f': metric_filter}}) AS current_name
        FROM latest l JOIN mapping m ON l.model = m.model WHERE model_display_name <> new_name GROUP BY l.model, new_name""",
)


def names(d):
    return k.display_name_mapping(d.sql(_NAMES))


@query("display_name_mapping", "SELECT model, new_name FROM mapping", **_SYNC)
def _(d):
    return names(d)


@query("sync_dimension", f"""SELECT {', '.join('l.' + c for c in KEY)}, l.score, coalesce(r.new_name, l.model_display_name) AS model_display_name
        FROM latest l LEFT JOIN renamed r ON l.model = r.model""", **_SYNC)
def _(d):
    return k.sync_dimension(m.merge_and_dedup(*sides(d)), names(d)).select(*KEY, "score", "model_display_name")


@query("sync_dimension_preview", """SELECT r.model, current_name, new_name, count(*) AS affected_rows FROM renamed r JOIN latest l ON l.model = r.model
        GROUP BY r.model, current_name, new_name""", **_SYNC)
def _(d):
    return k.sync_dimension_preview(m.merge_and_dedup(*sides(d)), names(d))
