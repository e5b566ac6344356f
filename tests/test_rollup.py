import random
import time

import pytest
from pyspark.sql import functions as F

from scoremart.operators import hierarchy as h
from scoremart.operators import rollup as r
from scoremart.operators.merge import conform

LEAF = "model string, step long, task string, metric string, metric_filter string, score double, n_samples long"
CHILD = "grp string, grp_pos long, child string, child_pos long"
METRIC = "grp string, metric string, weight_by_size boolean"


def leaf(spark, rows):
    df = spark.createDataFrame([("m", None, t, "acc", f, s, n) for t, f, s, n in rows], LEAF)
    return conform(df.withColumn("task_type", F.lit("benchmark")))


def roll(spark, rows, weighted, children=(("g", 0, "a", 0), ("g", 0, "b", 1)), metrics=None, suites=("g",)):
    graph = spark.createDataFrame(list(children), CHILD)
    declared = spark.createDataFrame(metrics or [("g", "acc", weighted)], METRIC)
    names = spark.createDataFrame([(s,) for s in suites], "task string")
    return {x["task"]: x for x in r.rollup(leaf(spark, rows), graph, declared, names).collect()}


@pytest.mark.parametrize(
    "rows, weighted, score, n",
    [
        ([("a", "none", 0.2, 10), ("b", "none", 0.4, 30)], False, 0.3, 40),
        ([("a", "none", 0.2, 10), ("b", "none", 0.4, 30)], True, 0.35, 40),
        ([("a", "none", 0.2, None), ("b", "none", 0.4, 0)], True, 0.3, 2),
        ([("a", "none", 0.2, 10)], True, 0.2, 10),
        ([("a", "none", 0.2, 10), ("b", "strict", 0.4, 10)], False, 0.3, 20),
    ],
)
def test_means(spark, rows, weighted, score, n):
    got = roll(spark, rows, weighted)["g"]
    assert got["score"] == pytest.approx(score) and got["n_samples"] == n
    assert got["task_type"] == "eval_suite" and got["metric_filter"] == "none"


def test_incomplete_group_gives_no_row(spark):
    assert roll(spark, [("a", "none", 0.2, 10), ("b", "none", None, 30)], False) == {}


def test_filter_choice_is_global(spark):
    """A model with only "strict" scores is left out once any model reports "none"."""
    rows = spark.createDataFrame(
        [("m1", 1, "a", "acc", "none", 1.0, 1), ("m2", 1, "a", "acc", "strict", 1.0, 1)], LEAF
    )
    graph = spark.createDataFrame([("g", 0, "a", 0)], CHILD)
    declared = spark.createDataFrame([("g", "acc", False)], METRIC)
    out = r.rollup(conform(rows), graph, declared, spark.createDataFrame([("g",)], "task string"))
    assert [x["model"] for x in out.collect()] == ["m1"]


def test_levels_trees_and_parents(spark):
    children = [("top", 1, "mid", 0), ("top", 1, "c", 1), ("mid", 0, "a", 0), ("mid", 0, "b", 1), ("other", 2, "mid", 0), ("lone", 3, "a", 0)]
    metrics = [("top", "acc", False), ("mid", "acc", False), ("other", "acc", False), ("lone", "acc", False)]
    got = roll(spark, [("a", "none", 1.0, 1), ("b", "none", 3.0, 1), ("c", "none", 6.0, 1)], False, children, metrics, ("top", "other"))
    assert set(got) == {"top", "mid", "other"}
    assert got["mid"]["score"] == 2.0 and got["top"]["score"] == 4.0
    assert got["top"]["subtask_tree"] == {"top": ["mid", "c"], "mid": ["a", "b"]}
    assert got["mid"]["parent_task"] == "top" and got["top"]["parent_task"] is None
    assert got["mid"]["task_type"] == "task_group"


def test_deep_graph(spark):
    """Deeper than one planned chunk of a walk."""
    children = [(f"g{i}", i, f"g{i + 1}", 0) for i in range(7)] + [("g7", 7, "a", 0)]
    metrics = [(f"g{i}", "acc", False) for i in range(8)]
    got = roll(spark, [("a", "none", 5.0, 1)], False, children, metrics, ("g0",))
    assert len(got) == 8 and got["g0"]["score"] == 5.0
    assert got["g0"]["subtask_tree"]["g7"] == ["a"] and len(got["g0"]["subtask_tree"]) == 8


def test_cycle_is_an_error(spark):
    graph = spark.createDataFrame([("a", 0, "b", 0), ("b", 1, "c", 0), ("c", 2, "a", 0), ("top", 3, "a", 0)], CHILD)
    with pytest.raises(h.GroupCycleError):
        h.group_levels(graph)
    with pytest.raises(h.GroupCycleError):
        h.reachable_groups(graph, spark.createDataFrame([("top",)], "grp string"))


def test_long_chains_take_few_rounds(spark):
    begin = time.monotonic()
    chain = [(f"g{i:04}", i, f"g{i + 1:04}", 0) for i in range(1000)]
    graph = spark.createDataFrame(chain, CHILD)
    levels = {r["grp"]: r["level"] for r in h.group_levels(graph).collect()}
    assert levels == {f"g{i:04}": 999 - i for i in range(1000)}
    with pytest.raises(h.GroupCycleError, match="g0"):
        h.group_levels(spark.createDataFrame([*chain, ("g0999", 999, "g0500", 0)], CHILD))
    leaf = h.expand_suites(spark.createDataFrame([("g0000", 0), ("g0998", 1)], "suite string, suite_pos int"), graph).collect()
    assert [(r["suite"], len(r["path"]), r["task"]) for r in sorted(leaf)] == [("g0000", 1000, "g1000"), ("g0998", 2, "g1000")]
    assert time.monotonic() - begin < 90


@pytest.mark.parametrize("seed", range(3))
def test_walks_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a in range(14) for b in rng.sample(range(a + 1, 20), min(3, 19 - a)) if rng.random() < 0.7}
    kids = {a: sorted(b for x, b in edges if x == a) for a, _ in edges}

    def ways(node, path=()):
        return [w for i, b in enumerate(kids[node]) for w in ways(b, (*path, i))] if node in kids else [(path, node)]

    def depths(root):
        found, at, d = {}, {root}, 0
        while at:
            found.update(dict.fromkeys(at & kids.keys(), d))
            at, d = {b for a in at for b in kids.get(a, [])}, d + 1
        return found

    graph = spark.createDataFrame([(f"g{a}", a, f"g{b}", kids[a].index(b)) for a, b in edges], CHILD)
    roots = [a for a in (0, 3, 7) if a in kids]
    want = {}
    for r in roots:
        for node, d in depths(r).items():
            want[f"g{node}"] = max(d, want.get(f"g{node}", 0))
    start = spark.createDataFrame([(f"g{r}",) for r in roots], "grp string")
    assert {r["grp"]: r["depth"] for r in h.reachable_groups(graph, start).collect()} == want
    level = lambda a: max((1 + level(b) for b in kids[a] if b in kids), default=0)
    assert {r["grp"]: r["level"] for r in h.group_levels(graph).collect()} == {f"g{a}": level(a) for a in kids}
    names = spark.createDataFrame([(f"g{r}", i) for i, r in enumerate([*roots, 19])], "suite string, suite_pos int")
    found = sorted((r["suite"], tuple(p["pos"] for p in r["path"]), r["task"]) for r in h.expand_suites(names, graph).collect())
    assert found == sorted((f"g{r}", path, f"g{leaf}") for r in [*roots, 19] for path, leaf in ways(r))


def test_positions_of_any_size_keep_their_order(spark):
    positions = [5, 999_999_999, 1_999_999_999, 10_000_000_000]
    graph = spark.createDataFrame([("s", 0, f"t{p}", p) for p in positions], CHILD)
    out = h.expand_suites(spark.createDataFrame([("s", 0)], "suite string, suite_pos long"), graph).orderBy("path").collect()
    assert [r["task"] for r in out] == [f"t{p}" for p in positions]


def test_name_that_is_leaf_and_group(spark):
    """Observed and declared metrics count, and a leaf row stands in where the group has no aggregate."""
    children = [("top", 0, "mid", 0), ("top", 0, "c", 1), ("mid", 1, "a", 0), ("mid", 1, "b", 1)]
    metrics = [("top", "acc", False), ("mid", "acc", False)]
    leaf = [("mid", "none", 0.5, 1), ("a", "none", 0.25, 1), ("c", "none", 1.0, 1)]
    got = roll(spark, leaf, False, children, metrics, ("top",))
    # b is observed nowhere and so not applicable: mid is the mean of a alone.
    assert got["mid"]["score"] == 0.25 and got["top"]["score"] == (0.25 + 1.0) / 2
    got = roll(spark, leaf, False, children, [("top", "acc", False)], ("top",))
    assert "mid" not in got and got["top"]["score"] == 0.75
    got = roll(spark, [("mid", "none", 0.5, 1), ("c", "none", 1.0, 1)], False, children, metrics, ("top",))
    assert "mid" not in got and got["top"]["score"] == 0.75


def test_expand_with_tags_and_duplicates(spark):
    graph = spark.createDataFrame([("s", 0, "g", 0), ("s", 0, "x", 1), ("s", 0, "tag", 2), ("g", 1, "x", 0)], CHILD)
    tags = spark.createDataFrame([("tag", "t2"), ("tag", "t1")], "tag string, task string")
    names = spark.createDataFrame([("s", 0), ("alone", 1)], "suite string, suite_pos long")
    out = h.expand_suites(names, graph, tags).orderBy("suite_pos", "path").collect()
    assert [x["task"] for x in out] == ["x", "x", "t1", "t2", "alone"]


def test_leaf_scores_are_combined_before_the_exchange(spark):
    edges = spark.createDataFrame([("g", "acc", False, "a", 0, "none", 0, False)],
                                  "grp string, metric string, weight_by_size boolean, child string, child_pos long, metric_filter string, depth int, is_group boolean")
    rows = leaf(spark, [("a", "none", 1.0, 1)]).withColumnRenamed("task", "child")
    plan = r.combine(r.contributions(rows, edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") >= 1


def test_expand_suites_walks_groups_before_tasks(spark, monkeypatch):
    """Tasks are joined only to ways that have been walked: no staged table holds them once for each group above."""
    rows = [("s", 0, "c", 0), ("s", 0, "t0", 1), ("c", 1, "o", 0)] + [("o", 2, f"t{i}", i) for i in range(500)] + [("o", 2, None, 500)]
    graph = spark.createDataFrame(rows, "grp string, grp_pos long, child string, child_pos long")
    names = spark.createDataFrame([("s", 0), ("s", 0), ("lone", 1), (None, 2)], "suite string, suite_pos long")
    staged, stage = [], h.stage
    monkeypatch.setattr(h, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    found = [(r["suite"], tuple(p["pos"] for p in r["path"]), r["task"]) for r in h.expand_suites(names, graph).collect()]
    one = [("s", (1,), "t0"), ("s", (0, 0, 500), "s")] + [("s", (0, 0, i), f"t{i}") for i in range(500)]
    assert sorted(found, key=repr) == sorted(one + one + [("lone", (), "lone"), (None, (), None)], key=repr)
    assert sum(table.count() for table in staged) < 600


def test_shape_and_rows_are_written_once(spark):
    child = spark.createDataFrame(
        [("top", 0, "mid", 0), ("top", 0, "b", 1), ("mid", 1, "a", 0), ("mid", 1, "b", 1), ("top", 0, "mid", 2)], CHILD)
    metric = spark.createDataFrame([("top", "acc", False), ("mid", "acc", False)], METRIC)
    leaf = conform(spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0), ("n", "a", 1.0)], "model string, task string, score double").selectExpr(
        "*", "'acc' as metric", "'none' as metric_filter"))
    tree = r.Hierarchy(leaf, child, metric, spark.createDataFrame([("top",)], "task string"))
    cells = r.all_cells(leaf, tree)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (tree.shape, *tree.rows)]
    assert len(cells) == len(tree.rows) == 2 and not any("Aggregate" in x or "Join" in x for x in plans)
    found = {(x["model"], x["task"]): x["score"] for rows in tree.rows for x in rows.collect()}
    assert found == {("m", "mid"): 2.0, ("m", "top"): (2.0 + 2.0 + 3.0) / 3}
    # Edges to tasks, most of all edges, are left out before the rest is made distinct.
    plan = h.group_edges(child)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
