"""Group scores, bottom-up over the task-group graph.

The leaf table is read once for the scores: every leaf row contributes to all groups that
list its task, pre-aggregated before the exchange into one accumulator per (model, step,
group, metric).  Higher levels combine accumulators and the far smaller group rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import null_safe_join
from ..schemas import SCORE
from ..session import stage
from .hierarchy import parent_of, preferred_filters, reachable_groups, subtask_trees
from .merge import conform

_CELL = ["model", "step", "grp", "metric", "depth"]

# What a child hands to its groups, besides its score.
_CHILD = [
    "model", "step", "score", "n_samples", "eval_date", "language", "higher_is_better",
    "model_path", "model_display_name", "train_batch_size", "tokens_trained",
]


def contributions(children: DataFrame, edges: DataFrame) -> DataFrame:
    """What each scored child adds to the cells of its groups, as one-row accumulators."""
    weight = F.when(F.coalesce("n_samples", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("n_samples"))
    # Text and number fields take the first usable child by position: the least struct.
    first = {
        name: F.when(F.col(name) != empty, F.struct("child_pos", F.col(name).alias("value")))
        for name, empty in [
            ("model_path", F.lit("")),
            ("model_display_name", F.lit("")),
            ("train_batch_size", F.lit(0)),
            ("tokens_trained", F.lit(0)),
        ]
    }
    matched = children.filter("score is not null").join(edges, ["child", "metric", "metric_filter"])
    return matched.withColumn("weight", weight).select(
        *_CELL,
        F.lit(1).cast("bigint").alias("n_scored"),
        F.col("score").alias("sum_s"),
        (F.col("score") * F.col("weight")).alias("sum_sw"),
        F.col("weight").alias("sum_w"),
        F.col("weight").alias("max_w"),
        "eval_date",
        F.col("language").alias("lang_lo"),
        F.col("language").alias("lang_hi"),
        F.col("higher_is_better").alias("hib_lo"),
        F.col("higher_is_better").alias("hib_hi"),
        *[value.alias(name) for name, value in first.items()],
    )


def combine(parts: DataFrame) -> DataFrame:
    """Merge accumulators of the same cell; combines before the exchange."""
    low = ["lang_lo", "hib_lo", "model_path", "model_display_name", "train_batch_size", "tokens_trained"]
    high = ["max_w", "eval_date", "lang_hi", "hib_hi"]
    total = ["n_scored", "sum_s", "sum_sw", "sum_w"]
    return parts.groupBy(*_CELL).agg(
        *[F.sum(c).alias(c) for c in total], *[F.max(c).alias(c) for c in high], *[F.min(c).alias(c) for c in low]
    )


def group_shape(applicable: DataFrame) -> DataFrame:
    """(grp, metric, weight_by_size, n_applicable)."""
    return applicable.groupBy("grp", "metric").agg(
        F.bool_or("weight_by_size").alias("weight_by_size"), F.count("*").alias("n_applicable")
    )


def finalise(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Complete cells as score rows; a cell lacking any applicable child gives none."""
    value = lambda c: F.col(c)["value"]
    agreed = lambda kind: F.when(F.col(f"{kind}_lo") == F.col(f"{kind}_hi"), F.col(f"{kind}_lo"))
    weighted = F.col("weight_by_size") & (F.col("max_w") > 1)
    batch = value("train_batch_size")
    return (
        cells.join(shape, ["grp", "metric"])
        .filter("n_scored = n_applicable")
        .select(
            "model",
            "step",
            F.col("grp").alias("task"),
            "metric",
            F.lit("none").alias("metric_filter"),
            F.when(weighted, F.col("sum_sw") / F.col("sum_w")).otherwise(F.col("sum_s") / F.col("n_scored")).alias("score"),
            F.col("grp").alias("task_display_name"),
            agreed("hib").alias("higher_is_better"),
            agreed("lang").alias("language"),
            F.col("sum_w").alias("n_samples"),
            batch.alias("train_batch_size"),
            F.coalesce(value("tokens_trained"), batch * F.col("step")).alias("tokens_trained"),
            "eval_date",
            value("model_path").alias("model_path"),
            F.col("step").isNotNull().alias("is_checkpoint"),
            F.coalesce(value("model_display_name"), "model").alias("model_display_name"),
        )
    )


class Hierarchy:
    """The part of the group graph below the configured suites, prepared for one leaf table.

    ``edges`` has one row per (group, metric, applicable child) with the filter to read the
    child's score under, the group's depth and whether the child is a group that declares the
    metric.  Such a child's score is its aggregate, or its own leaf row where there is none.
    """

    def __init__(
        self,
        leaf: DataFrame,
        group_child: DataFrame,
        group_metric: DataFrame,
        suites: DataFrame,
        filters: DataFrame | None = None,
    ):
        self.suites = suites.select(F.col("task").alias("grp")).distinct()
        self.group_child = group_child
        reachable = reachable_groups(group_child, self.suites)
        inside = group_child.join(reachable, "grp")
        metrics = group_metric.groupBy("grp", "metric").agg(F.bool_or("weight_by_size").alias("weight_by_size"))
        filters = preferred_filters(leaf) if filters is None else filters
        # What a child can report: observed metrics under their filter, and a group's own ones.
        declared = group_metric.join(group_child.select("grp").distinct(), "grp", "left_semi")
        declared = declared.select(F.col("grp").alias("child"), "metric").distinct().withColumn("declared", F.lit(True))
        seen = filters.select(F.col("task").alias("child"), "metric", "metric_filter")
        options = seen.join(declared, ["child", "metric"], "full").select(
            "child", "metric", F.coalesce("metric_filter", F.lit("none")).alias("metric_filter"), "declared"
        )
        from_group = F.coalesce("declared", F.lit(False)) & (F.col("metric_filter") == "none")
        self.edges = stage(
            inside.join(metrics, "grp").join(options, ["child", "metric"]).select(
                "grp", "metric", "weight_by_size", "child", "child_pos", "metric_filter", "depth",
                from_group.alias("is_group"),
            ),
            "edges",
            by="is_group",  # edges to groups are few and read for every depth
        )
        self.shape = stage(group_shape(self.edges), "shape")
        self.top = self.edges.agg(F.max("depth").alias("top")).first()["top"]


def all_cells(leaf: DataFrame, h: Hierarchy) -> list[DataFrame]:
    """Accumulators of every group cell, written, one table per depth, deepest first.

    ``h.rows`` are the score rows of the complete ones, written once for all depths above and for the result.
    """
    leaves = leaf.select(*_CHILD, F.col("task").alias("child"), "metric", "metric_filter")
    leaf_edges = h.edges.filter("not is_group")
    from_leaves = stage(combine(contributions(leaves, leaf_edges)), "leaf-cells")
    named = leaves.join(h.edges.filter("is_group").select("child", "metric").distinct(), ["child", "metric"], "left_semi")
    h.stand_ins = None if named.isEmpty() else stage(named, "stand-ins")
    cells: list[DataFrame] = []
    h.rows = []
    for depth in range(-1 if h.top is None else h.top, -1, -1):
        cells.append(stage(_cells_at(depth, from_leaves, h.rows, h), "cells"))
        h.rows.append(stage(finalise(cells[-1], h.shape), "rows"))
    return cells


def _cells_at(depth: int, from_leaves: DataFrame, rows: list[DataFrame], h: Hierarchy) -> DataFrame:
    """Accumulators of the groups at one depth from leaves and already computed groups."""
    here = h.edges.filter(F.col("depth") == depth)
    parts = from_leaves.filter(F.col("depth") == depth)
    sources = []
    if rows:
        done = reduce(DataFrame.unionByName, rows)
        sources.append(done.select(*_CHILD, F.col("task").alias("child"), "metric", "metric_filter"))
    if h.stand_ins is not None:
        own = h.stand_ins
        if rows:
            keys = ["model", "step", "child", "metric", "metric_filter"]
            own = null_safe_join(own, sources[0].select(*keys), keys, "left_anti")
        sources.append(own)
    if sources:
        children = reduce(DataFrame.unionByName, sources)
        parts = combine(parts.unionByName(contributions(children, here.filter("is_group"))))
    return parts


def rollup(
    leaf: DataFrame,
    group_child: DataFrame,
    group_metric: DataFrame,
    suites: DataFrame,
    filters: DataFrame | None = None,
) -> DataFrame:
    """Aggregate score rows of all groups below the suites.

    ``leaf`` holds one row per key; a leaf row named like a group counts where the group has
    no aggregate.
    Which children can report a metric, and under which filter, is a fact of the whole table:
    when ``leaf`` is only part of it, pass that as ``filters(task, metric, metric_filter)``.
    """
    h = Hierarchy(leaf, group_child, group_metric, suites, filters)
    if not all_cells(leaf, h):
        return leaf.sparkSession.createDataFrame([], SCORE)
    return decorate(reduce(DataFrame.unionByName, h.rows), h)


def decorate(rows: DataFrame, h: Hierarchy) -> DataFrame:
    """Add what depends on the group alone: role, parent and subtask tree."""
    suites = h.suites.select(F.col("grp").alias("task"), F.lit("eval_suite").alias("_role"))
    parents = parent_of(h.group_child).select(F.col("child").alias("task"), F.col("parent").alias("parent_task"))
    trees = subtask_trees(h.edges, h.edges.filter("is_group")).withColumnRenamed("grp", "task")
    full = (
        rows.join(suites, "task", "left")
        .join(parents, "task", "left")
        .join(trees, ["task", "metric"], "left")
        .withColumn("task_type", F.coalesce("_role", F.lit("task_group")))
    )
    return conform(full).select(*SCORE.fieldNames())


def incomplete_cells(
    leaf: DataFrame, group_child: DataFrame, group_metric: DataFrame, suites: DataFrame
) -> DataFrame:
    """Diagnostics: cells with some but not all applicable children scored."""
    h = Hierarchy(leaf, group_child, group_metric, suites)
    cells = all_cells(leaf, h)
    empty = "model string, step bigint, grp string, metric string, n_scored bigint"
    found = reduce(DataFrame.unionByName, cells) if cells else leaf.sparkSession.createDataFrame([], empty)
    return (
        found.join(h.shape, ["grp", "metric"])
        .filter("n_scored < n_applicable")
        .select("model", "step", "grp", "metric", "n_scored", "n_applicable")
    )


def unknown_aggregations(group_metric: DataFrame) -> DataFrame:
    """Declared aggregation functions other than mean; they are treated as mean."""
    return group_metric.filter("aggregation <> 'mean'").select("grp", "metric", "aggregation")


def affected_cells(leaf: DataFrame, touched: DataFrame) -> DataFrame:
    """Leaf rows of the (model, step) pairs that occur in ``touched``."""
    return null_safe_join(leaf, touched.select("model", "step").distinct(), ["model", "step"], "left_semi")
