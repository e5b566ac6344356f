"""The task graph and group scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoremart.operators import hierarchy as h
from scoremart.operators import merge as m
from scoremart.operators import rollup as r
from scoremart.schemas import KEY
from scoremart.session import stage

from .q_merge import sides
from .registry import near, query
from .rollup_sql import LATEST, ROLLED

_R = dict(latest=LATEST, **ROLLED)


def leaf(d):
    """One row per key; read by several passes, so written once."""
    return stage(m.merge_and_dedup(*sides(d)), "leaf")


def graph(d):
    """The small task graph; in use it is a table, so it is written once here as well."""
    return [stage(t, "graph") for t in (d.group_child, d.group_metric, d.suites)]


def rolled(d):
    return r.rollup(leaf(d), *graph(d))


_ASIA = """SELECT concat('nation_', CAST(n_nationkey AS STRING)) AS grp FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA'"""


@query("reachable_groups", """SELECT DISTINCT grp FROM (SELECT grp FROM asia
    UNION ALL SELECT b.child FROM asia a JOIN big_child b ON a.grp = b.grp WHERE b.child IN (SELECT grp FROM big_child)
    UNION ALL SELECT c.child FROM asia a JOIN big_child b ON a.grp = b.grp JOIN big_child c ON b.child = c.grp
    WHERE c.child IN (SELECT grp FROM big_child)) u""", asia=_ASIA)
def _(d):
    return h.reachable_groups(d.big_child, d.sql(_ASIA)).select("grp")


@query("group_levels", """SELECT grp, CAST(CASE WHEN grp LIKE 'order%' THEN 0
    WHEN grp LIKE 'cust%' THEN coalesce(max(CASE WHEN child IN (SELECT concat('order_', l_orderkey) FROM lineitem) THEN 1 END), 0)
    ELSE (SELECT CASE WHEN bool_or(c.grp IS NOT NULL) THEN CASE WHEN bool_or(c.child IN (SELECT concat('order_', l_orderkey) FROM lineitem)) THEN 2 ELSE 1 END ELSE 0 END
          FROM big_child b LEFT JOIN big_child c ON b.child = c.grp WHERE b.grp = x.grp) END AS INTEGER) AS level
    FROM big_child x GROUP BY grp""")
def _(d):
    return h.group_levels(d.big_child)


@query("reported_metrics", "SELECT DISTINCT task, metric FROM reported", **_R)
def _(d):
    return h.reported_metrics(leaf(d), d.group_metric)


@query("preferred_filter", "SELECT task, metric, metric_filter FROM pref", **_R)
def _(d):
    return h.preferred_filters(leaf(d))


@query("applicable_children", "SELECT grp, metric, weight_by_size, child, child_pos FROM applicable", **_R)
def _(d):
    scores = leaf(d)
    inside = d.group_child.filter("grp <> 'lone'")
    return h.applicable_children(inside, d.group_metric, h.reported_metrics(scores, d.group_metric))


@query("rollup_mean", """SELECT task, model, step, metric, round(score + 0.000001, 5) AS score FROM rolled
    WHERE (task, metric) IN (SELECT (grp, metric) FROM group_metric WHERE NOT weight_by_size)""", **_R)
def _(d):
    means = d.group_metric.filter("not weight_by_size").select(F.col("grp").alias("task"), "metric")
    return rolled(d).join(means, ["task", "metric"], "left_semi").select("task", "model", "step", "metric", near("score"))


@query("rollup_weighted_mean", """SELECT task, model, step, metric, round(score + 0.000001, 5) AS score, n_samples FROM rolled
    WHERE (task, metric) IN (SELECT (grp, metric) FROM group_metric WHERE weight_by_size)""", **_R)
def _(d):
    weighted = d.group_metric.filter("weight_by_size").select(F.col("grp").alias("task"), "metric")
    return rolled(d).join(weighted, ["task", "metric"], "left_semi").select(
        "task", "model", "step", "metric", near("score"), "n_samples"
    )


@query("rollup_levels", f"SELECT {', '.join(KEY)}, round(score + 0.000001, 5) AS score, task_type FROM rolled", **_R)
def _(d):
    return rolled(d).select(*KEY, near("score"), "task_type")


@query("completeness_gate", """SELECT model, step, grp, metric, count(*) AS n_scored, any_value(n) AS n_applicable FROM (
    SELECT c.model, c.step, e.grp, e.metric, (SELECT count(*) FROM edges a WHERE a.grp = e.grp AND a.metric = e.metric) AS n
    FROM (SELECT model, step, task, metric, metric_filter, score FROM leaf UNION ALL
          SELECT model, step, task, metric, metric_filter, score FROM rolled) c
    JOIN edges e ON c.task = e.child AND c.metric = e.metric AND c.metric_filter = e.metric_filter WHERE c.score IS NOT NULL) x
    GROUP BY model, step, grp, metric HAVING count(*) < any_value(n)""", **_R)
def _(d):
    return r.incomplete_cells(leaf(d), *graph(d))


@query("consensus_attrs", f"SELECT {', '.join(KEY)}, language, higher_is_better FROM rolled", **_R)
def _(d):
    return rolled(d).select(*KEY, "language", "higher_is_better")


@query("propagate_attrs", f"""SELECT {', '.join(KEY)}, strftime(eval_date, '%Y-%m-%d') AS eval_day, model_path, model_display_name,
    train_batch_size, tokens_trained, n_samples, step IS NOT NULL AS is_checkpoint FROM rolled""", **_R)
def _(d):
    return rolled(d).select(
        *KEY, F.date_format("eval_date", "yyyy-MM-dd").alias("eval_day"), "model_path", "model_display_name",
        "train_batch_size", "tokens_trained", "n_samples", "is_checkpoint",
    )


@query("group_role_and_parent", f"""SELECT {', '.join(KEY)}, task_type,
    (SELECT arg_min(grp, grp_pos) FROM group_child g WHERE g.child = rolled.task) AS parent_task FROM rolled""", **_R)
def _(d):
    return rolled(d).select(*KEY, "task_type", "parent_task")


@query("merge_subtask_trees", """SELECT r.model, r.step, r.task, r.metric, a.grp AS node, a.child FROM rolled r
    JOIN (SELECT grp AS root, grp, metric FROM applicable
          UNION SELECT a.grp, b.grp, a.metric FROM applicable a JOIN applicable b ON a.child = b.grp AND a.metric = b.metric
          UNION SELECT a.grp, c.grp, a.metric FROM applicable a JOIN applicable b ON a.child = b.grp AND a.metric = b.metric
                JOIN applicable c ON b.child = c.grp AND c.metric = b.metric) t ON t.root = r.task AND t.metric = r.metric
    JOIN applicable a ON a.grp = t.grp AND a.metric = t.metric""", **_R)
def _(d):
    trees = rolled(d).select("model", "step", "task", "metric", F.explode("subtask_tree").alias("node", "children"))
    return trees.select("model", "step", "task", "metric", "node", F.explode("children").alias("child"))


@query("expand_suites", """SELECT concat('nation_', n_nationkey) AS suite, task,
        concat_ws('/', CAST(c_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS path
    FROM (SELECT n_nationkey, c_custkey, o_orderkey, l_linenumber,
          CASE WHEN l_partkey IS NOT NULL THEN concat('part_', l_partkey) WHEN o_orderkey IS NOT NULL THEN concat('order_', o_orderkey)
               WHEN c_custkey IS NOT NULL THEN concat('cust_', c_custkey) ELSE concat('nation_', n_nationkey) END AS task
          FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
          LEFT JOIN lineitem ON l_orderkey = o_orderkey) x""")
def _(d):
    return h.expand_suites(nation_suites(d), d.big_child).select("suite", "task", F.array_join(F.transform("path", lambda p: p["pos"].cast("string")), "/").alias("path"))


def nation_suites(d):
    return d.nation.select(
        F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("suite"), F.col("n_nationkey").cast("bigint").alias("suite_pos")
    )


# One model has scored all parts, the other only some: its groups are mostly incomplete.
_PART_SCORES = """SELECT concat('m', CAST(v AS STRING)) AS model, CAST(NULL AS BIGINT) AS step, concat('part_', CAST(p_partkey AS STRING)) AS task,
    'acc' AS metric, 'none' AS metric_filter, CAST(p_size + 100 * v AS DOUBLE) AS score
    FROM (SELECT p_partkey, p_size, 0 AS v FROM {part} UNION ALL SELECT p_partkey, p_size, 1 FROM {part} WHERE p_size < 35) p"""


def _above(children: str, level: str) -> str:
    """Means of groups all of whose applicable children have a score."""
    return f"""SELECT c.model, b.grp AS task, sum(c.score) / count(*) AS score FROM big_child b JOIN {children} c ON b.child = c.task
        WHERE b.grp LIKE '{level}%' GROUP BY c.model, b.grp
        HAVING count(*) = (SELECT count(*) FROM applicable_big a WHERE a.grp = b.grp)"""


@query("rollup_large_graph", """SELECT model, task, round(score + 0.000001, 5) AS score, task_type FROM (
    SELECT *, 'task_group' AS task_type FROM big_0 UNION ALL SELECT *, 'task_group' FROM big_1 UNION ALL SELECT *, 'eval_suite' FROM big_2) u""",
       part_scores=_PART_SCORES,
       applicable_big="""SELECT grp FROM big_child WHERE child IN (SELECT grp FROM big_child) OR child IN (SELECT task FROM part_scores)""",
       big_0=_above("part_scores", "order_"), big_1=_above("big_0", "cust_"), big_2=_above("big_1", "nation_"))
def _(d):
    leaf = m.conform(d.sql(_PART_SCORES).withColumn("task_type", F.lit("benchmark")))
    child = stage(d.big_child, "graph")
    groups = child.select("grp").distinct()
    metric = stage(groups.select("grp", F.lit("acc").alias("metric"), F.lit(False).alias("weight_by_size")), "graph")
    suites = groups.filter("grp like 'nation%'").select(F.col("grp").alias("task"))
    return r.rollup(leaf, child, metric, suites).select("model", "task", near("score"), "task_type")
