"""Group cells kept current by signed changes of their children.

A stored cell is an accumulator: numbers that add up, and extremes.  A child that changes takes its old contribution out
and puts its new one in; nothing else of the cell is read.  Only where the value that leaves was an extreme, and what
enters does not reach it, or where sums are not finite, is a cell computed again from its children.  Groups that change
are changed children of the groups above, so a batch works its way up the depths of the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import null_safe_join
from ..session import stage
from .rollup import _CELL, _CHILD, Hierarchy, combine, contributions, finalise

TOTALS = ["n_scored", "sum_s", "sum_sw", "sum_w"]
HIGHEST = ["max_w", "eval_date", "lang_hi", "hib_hi"]
LOWEST = ["lang_lo", "hib_lo", "model_path", "model_display_name", "train_batch_size", "tokens_trained"]
ACCUMULATORS = [*TOTALS, *HIGHEST, *LOWEST]
_CHILD_KEY = ["model", "step", "child", "metric", "metric_filter"]


def as_children(rows: DataFrame) -> DataFrame:
    return rows.select(*_CHILD, F.col("task").alias("child"), "metric", "metric_filter")


def _updated(stored: DataFrame, leaving: DataFrame, entering: DataFrame) -> DataFrame:
    """Cells that a batch changes: key, new accumulators, ``was`` (the stored ones) and ``stale`` (compute again)."""
    packed = F.struct(*ACCUMULATORS)
    sides = {"was": stored, "out": leaving, "into": entering}
    every = [cells.select(*_CELL, *[(packed if n == name else F.lit(None)).alias(n) for n in sides]) for name, cells in sides.items()]
    first = _typed(every, packed_type=stored.select(packed.alias("x")).schema["x"].dataType)
    cells = first.groupBy(*_CELL).agg(*[F.max(n).alias(n) for n in sides]).filter("out is not null or into is not null")
    part = lambda side, c: F.col(side)[c]
    number = lambda side, c: F.coalesce(part(side, c), F.lit(0))
    new: dict[str, Column] = {c: number("was", c) - number("out", c) + number("into", c) for c in TOTALS}
    missing = F.lit(False)
    for names, best, reaches in (
        (HIGHEST, F.greatest, lambda a, b: a >= b),
        (LOWEST, F.least, lambda a, b: a <= b),
    ):
        for c in names:
            new[c] = best(part("was", c), part("into", c))
            held = F.coalesce(part("was", c) == part("out", c), F.lit(False))
            missing = missing | (held & ~F.coalesce(reaches(part("into", c), part("was", c)), F.lit(False)))
    odd = F.lit(False)
    for c in ("sum_s", "sum_sw"):
        odd = odd | ~_finite(number("was", c)) | ~_finite(number("out", c))
    empty = new["n_scored"] == 0
    values = [F.when(empty, F.lit(0) if c in TOTALS else F.lit(None)).otherwise(new[c]).alias(c) for c in ACCUMULATORS]
    return cells.select(*_CELL, *values, "was", (~empty & (missing | odd)).alias("stale"))


def _finite(number: Column) -> Column:
    return ~F.isnan(number) & (F.abs(number) != float("inf"))


def _typed(tables: list[DataFrame], packed_type) -> DataFrame:
    typed = [t.select(*_CELL, *[F.col(c).cast(packed_type).alias(c) for c in t.columns if c not in _CELL]) for t in tables]
    return reduce(DataFrame.unionByName, typed)


def _again(stale: DataFrame, h: Hierarchy, depth: int, now: DataFrame, leaves: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cells in ``stale`` from all their children: leaf rows by key, and the groups below as they are ``now``."""
    here = h.edges.filter(F.col("depth") == depth)
    wanted = stale.select("model", "step", "grp", "metric").join(here, ["grp", "metric"])
    wanted = wanted.select(*_CHILD_KEY, "is_group").distinct()
    found = leaves(wanted.filter("not is_group").select(*_CHILD_KEY))
    parts = contributions(found, here.filter("not is_group"))
    below = wanted.filter("is_group").select("model", "step", F.col("child").alias("grp"), "metric")
    groups = null_safe_join(now, below.distinct(), ["model", "step", "grp", "metric"], "left_semi")
    parts = parts.unionByName(contributions(as_children(finalise(groups, h.shape)), here.filter("is_group")))
    return null_safe_join(combine(parts), stale.select(*_CELL), _CELL, "left_semi")


def latest_cells(*versions: DataFrame) -> DataFrame:
    """The last version of each cell; the tables are in the order of their age and have one row per cell."""
    packed = F.struct(*ACCUMULATORS)
    aged = [v.select(*_CELL, F.struct(F.lit(i).alias("age"), packed.alias("cell")).alias("v")) for i, v in enumerate(versions)]
    merged = reduce(DataFrame.unionByName, aged).groupBy(*_CELL).agg(F.max_by("v.cell", "v.age").alias("cell"))
    return merged.select(*_CELL, "cell.*")


def changed_cells(
    stored: DataFrame, leaving: DataFrame, entering: DataFrame, h: Hierarchy, leaves: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    """New versions of the cells that leaf rows ``leaving`` and ``entering`` change; a cell without scores stays as one of 0.

    ``stored`` are the cells of the models concerned; ``leaves(keys)`` gives the current leaf rows of
    ``(model, step, child, metric, metric_filter)`` as children.  No leaf may be named like a group with aggregates.
    """
    out, into = as_children(leaving), as_children(entering)
    done: list[DataFrame] = []
    group_out, group_into = [], []
    for depth in range(-1 if h.top is None else h.top, -1, -1):
        here = h.edges.filter(F.col("depth") == depth)

        def side(rows: DataFrame, groups: list[DataFrame]) -> DataFrame:
            parts = contributions(rows, here.filter("not is_group"))
            for g in groups:
                parts = parts.unionByName(contributions(as_children(g), here.filter("is_group")))
            return combine(parts)

        at = stored.filter(F.col("depth") == depth)
        new = stage(_updated(at, side(out, group_out), side(into, group_into)), "cells")
        fresh = new.select(*_CELL, *ACCUMULATORS)
        stale = new.filter("stale")
        if not stale.isEmpty():
            again = _again(stale, h, depth, latest_cells(stored, *done), leaves)
            fresh = stage(new.filter("not stale").select(*fresh.columns).unionByName(again.select(*fresh.columns)), "cells")
        done.append(fresh)
        group_out.append(finalise(new.filter("was is not null").select(*_CELL, "was.*"), h.shape))
        group_into.append(finalise(fresh, h.shape))
    return reduce(DataFrame.unionByName, done) if done else None
