"""The task-group graph: reachability, levels, leaf expansion, subtask trees.

A graph is two edge tables, ``group_child(grp, grp_pos, child, child_pos)`` and
``group_metric(grp, metric, weight_by_size)``.  Walks double their steps: links of 1, 2, 4, ... steps are written one after
the other until there are none, and every walk is made of some of them, so a chain of a thousand groups takes ten rounds.
The driver sees only whether links of so many steps exist; when they are longer than there are groups, some group
contains itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


class GroupCycleError(ValueError):
    """The group definitions contain a cycle."""


def _powers(links: DataFrame, keys: tuple[str, ...] = ()) -> list[DataFrame]:
    """``links(node, next)`` of 1, 2, 4, ... steps, as long as there are any; ``keys`` are equal along a walk.

    Raises if the links contain a cycle.
    """
    step = stage(links.select(*keys, "node", "next").distinct(), "links")
    powers, most = [], None
    while not step.isEmpty():
        powers.append(step)
        if len(powers) > 2:
            most = most or powers[0].select("node").distinct().count()
            if 2 ** (len(powers) - 1) > most:
                names = [r["node"] for r in step.select("node").distinct().limit(5).collect()]
                raise GroupCycleError(f"groups contain themselves: on or above a cycle lie {', '.join(map(str, names))}")
        second = step.select(*keys, F.col("node").alias("next"), F.col("next").alias("last"))
        step = stage(step.join(second, [*keys, "next"]).select(*keys, "node", F.col("last").alias("next")).distinct(), "links")
    return powers


def _longest(start: DataFrame, powers: list[DataFrame], back: bool = False) -> DataFrame:
    """(node, depth) of all nodes on walks from ``start(node)``, with the most steps; ``back`` walks against the links.

    Steps are taken by falling powers of two.  Of the ways to a node the longest is enough, whatever follows.
    """
    ends = ("next", "node") if back else ("node", "next")
    held = start.select("node", F.lit(0).alias("depth")).distinct()
    for k, links in reversed(list(enumerate(powers))):
        jumps = links.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("to"))
        both = F.array(F.struct("node", "depth"), F.struct(F.col("to").alias("node"), (F.col("depth") + 2**k).alias("depth")))
        held = held.join(jumps, "node", "left").select(F.inline(both)).filter("node is not null")
        held = held.groupBy("node").agg(F.max("depth").alias("depth"))
    return held


def _met(start: DataFrame, powers: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """``start`` (with ``keys`` and ``node``) once for each node on walks from its node, as ``node``."""
    held = start
    for links in reversed(powers):
        jumps = links.select(*keys, "node", F.col("next").alias("to"))
        joined = held.join(jumps, [*keys, "node"], "left")
        others = [c for c in start.columns if c != "node"]
        nodes = F.array("node", "to")
        held = joined.select(*others, F.explode(nodes).alias("node")).filter("node is not null").distinct()
    return held.select(*start.columns)


def group_edges(group_child: DataFrame) -> DataFrame:
    """Edges between groups, one per (grp, child).  Most edges lead to tasks, so those are left out first."""
    groups = group_child.select(F.col("grp").alias("child")).distinct()
    return group_child.select("grp", "child").join(groups, "child", "left_semi").select("grp", "child").distinct()


def _group_links(group_child: DataFrame) -> DataFrame:
    return group_edges(group_child).select(F.col("grp").alias("node"), F.col("child").alias("next"))


def reachable_groups(group_child: DataFrame, roots: DataFrame) -> DataFrame:
    """(grp, depth) of groups reachable from ``roots(grp)``; depth is the longest way from a root.

    Roots that define no group are ignored.  Computing groups by descending depth is a
    bottom-up order, because a child lies deeper than each of its parents.  Raises on a cycle.
    """
    start = group_child.select("grp").distinct().join(roots.select("grp").distinct(), "grp", "left_semi")
    found = _longest(start.withColumnRenamed("grp", "node"), _powers(_group_links(group_child)))
    return found.withColumnRenamed("node", "grp")


def group_levels(group_child: DataFrame) -> DataFrame:
    """(grp, level): longest way down to a group without group children, which has level 0.

    Raises on a cycle.
    """
    groups = group_child.select(F.col("grp").alias("node")).distinct()
    found = _longest(groups, _powers(_group_links(group_child)), back=True)
    return found.select(F.col("node").alias("grp"), F.col("depth").alias("level"))


def expand_suites(names: DataFrame, group_child: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Leaf tasks of every requested name, duplicates kept.

    ``names(suite, suite_pos)``; ``tags(tag, task)`` expand to their members by name.  A name
    that is neither group nor tag is its own leaf.  The result ``(suite, suite_pos, path,
    task)`` is ordered by ``path``, the places on the way down: an order that needs no
    numbering of a suite's members in one place.  A place is the position in a group, or the
    name of a tag's member.

    Ways among groups are joined with themselves, which doubles them, and are walked from the requested names by falling
    powers of two, so that each way is met once; tasks are joined only to the ways that have been walked.  Raises on a
    cycle.
    """
    place = lambda pos, tag: F.struct(pos.cast("bigint").alias("pos"), tag.alias("tag"))
    edges = group_child.select(
        F.col("grp").alias("node"), place(F.col("child_pos"), F.lit("")).alias("pos"), F.col("child").alias("next")
    )
    if tags is not None:
        edges = edges.unionByName(
            tags.select(F.col("tag").alias("node"), place(F.lit(0), F.col("task")).alias("pos"), F.col("task").alias("next"))
        )
    inner = edges.select(F.col("node").alias("next")).distinct().withColumn("goes_on", F.lit(True))
    edges = stage(edges.join(inner, "next", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))), "edges")
    onward = edges.filter("goes_on")
    powers = _powers(onward.select("node", "next"))
    met = _met(names.select(F.col("suite").alias("node")).distinct(), powers, ())
    way = onward.select("node", F.array("pos").alias("path"), "next")
    ways = []
    for k in range(len(powers)):
        if k:
            rest = way.select(F.col("node").alias("next"), F.col("path").alias("rest"), F.col("next").alias("last"))
            way = way.join(rest, "next").select("node", F.concat("path", "rest").alias("path"), F.col("last").alias("next"))
        else:
            way = way.join(met, "node", "left_semi")
        if len(powers) > 1:
            way = stage(way, "ways")
        ways.append(way)
    own = F.array().cast(edges.select(F.array("pos").alias("p")).schema["p"].dataType)
    groups = inner.select(F.col("next").alias("suite"))
    held = names.select("suite", "suite_pos", F.col("suite").alias("node"), own.alias("path"))
    for way in reversed(ways):
        jumps = way.select("node", F.col("path").alias("rest"), "next")
        held = stage(held, "held")
        held = held.unionByName(
            held.join(jumps, "node").select("suite", "suite_pos", F.col("next").alias("node"), F.concat("path", "rest").alias("path"))
        )
    ends = edges.filter("not goes_on").select("node", "pos", F.col("next").alias("task"))
    found = held.join(ends, "node").select("suite", "suite_pos", F.array_append("path", F.col("pos")).alias("path"), F.coalesce("task", "suite").alias("task"))
    alone = names.join(groups, "suite", "left_anti").select("suite", "suite_pos", own.alias("path"), F.col("suite").alias("task"))
    return found.unionByName(alone)


def parent_of(group_child: DataFrame) -> DataFrame:
    """(child, parent): the first group in definition order that lists the child."""
    return group_child.groupBy("child").agg(F.min_by("grp", "grp_pos").alias("parent"))


def reported_metrics(leaf: DataFrame, group_metric: DataFrame) -> DataFrame:
    """(task, metric) a task can report: declared for groups, observed for leaves."""
    return (
        leaf.select("task", "metric").distinct()
        .unionByName(group_metric.select(F.col("grp").alias("task"), "metric"))
        .distinct()
    )


def preferred_filters(leaf: DataFrame) -> DataFrame:
    """(task, metric, metric_filter) to use for a leaf, over all models.

    ``none`` if it occurs anywhere, else the filter seen first in key order.  Only tasks
    with several other filters need that order, so it is looked up for them alone.
    """
    seen = leaf.select("task", "metric", "metric_filter").distinct()
    choice = seen.groupBy("task", "metric").agg(
        F.bool_or(F.col("metric_filter") == "none").alias("has_none"),
        F.count("*").alias("n_filters"),
        F.min("metric_filter").alias("only"),
    )
    simple = choice.filter("has_none or n_filters = 1").select(
        "task", "metric", F.when(F.col("has_none"), F.lit("none")).otherwise(F.col("only")).alias("metric_filter")
    )
    unclear = choice.filter("not has_none and n_filters > 1").select("task", "metric")
    first = (
        leaf.join(unclear, ["task", "metric"], "left_semi")
        .groupBy("task", "metric")
        .agg(F.min_by("metric_filter", F.struct("model", "step", "metric_filter")).alias("metric_filter"))
    )
    return simple.unionByName(first)


def filter_vocabulary(leaf: DataFrame) -> DataFrame:
    """(task, metric, metric_filter, first): filters seen, each with its least (model, step).

    Vocabularies of parts of a table can be stored and united, which :func:`choose_filters`
    accepts, so a growing table need not be scanned again.
    """
    return leaf.groupBy("task", "metric", "metric_filter").agg(F.min(F.struct("model", "step")).alias("first"))


def choose_filters(vocabulary: DataFrame) -> DataFrame:
    """The result of :func:`preferred_filters` from stored vocabularies."""
    order = F.struct((F.col("metric_filter") != "none").alias("other"), "first", "metric_filter")
    return vocabulary.groupBy("task", "metric").agg(F.min_by("metric_filter", order).alias("metric_filter"))


def applicable_children(
    group_child: DataFrame, group_metric: DataFrame, reported: DataFrame
) -> DataFrame:
    """(grp, metric, weight_by_size, child, child_pos) for children that can report the metric."""
    wanted = group_metric.select("grp", "metric", "weight_by_size")
    return (
        group_child.select("grp", "child", "child_pos")
        .join(wanted, "grp")
        .join(reported.withColumnRenamed("task", "child"), ["child", "metric"], "left_semi")
        .select("grp", "metric", "weight_by_size", "child", "child_pos")
    )


def subtask_trees(applicable: DataFrame, group_edges: DataFrame) -> DataFrame:
    """(grp, metric, subtask_tree) of every aggregate that can be computed.

    An aggregate exists only when all applicable children have scores, so its tree follows
    from the graph alone and is built once per (grp, metric), not per score row.
    ``group_edges`` are the applicable edges that lead to groups.  A group's child list is one
    value here, as it is one list in its definition.
    """
    own = applicable.groupBy("grp", "metric").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("child_pos", "child"))), lambda c: c["child"]).alias("kids")
    )
    down = group_edges.select(F.col("grp").alias("node"), "metric", F.col("child").alias("next"))
    pairs = own.select("grp", "metric", F.col("grp").alias("node"))
    nodes = _met(pairs, _powers(down, ("metric",)), ("metric",))
    kids = own.withColumnRenamed("grp", "node")
    return (
        nodes.join(kids, ["node", "metric"])
        .groupBy("grp", "metric")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "kids")))).alias("subtask_tree"))
    )
