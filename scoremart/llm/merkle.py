"""A Merkle manifest of a table: a digest of every row, one of every source, one of all, and a proof for each row.

Nodes of a tree stand in order of their position; every three consecutive ones hash to their parent, until one is left.
A tree is climbed in chunks of 3^7 positions, which no run of siblings crosses: one exchange, then per level a window
whose lag and lead columns at the level's distance supply the siblings of each first-child row, masked by the row's slot
in its run (beyond the last node they are null), and first-child rows hash parents.  The last value at or before a row
hands a level's siblings on to all rows below.  The nodes that are left of the chunks are climbed in the same way, so
that neither a hot source nor the table's size makes a window larger than a chunk.  Positions are found by ranges, too.

A digest H is the lower-case hexadecimal SHA-256 of concatenated inputs, digests among them as hexadecimal text.  A field
is ``-`` if null, else its UTF-8 length, a colon and its value.

Null ids come first, rows with one id in the order of their leaves; equal rows have equal leaves, and their proofs differ
by place.  Null sources form a tree of their own, which comes first.  A source with one row has its leaf as subroot; one
source is the root itself.  A row whose id is null is never tampered with.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ARITY = 3
#: Levels that one exchange serves; a chunk has at most ``ARITY ** LEVELS`` nodes.
LEVELS = 7
#: Nodes that one task puts in order.
PLACED = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: dict[str, Column]) -> Column:
    return digest(*(field(values[name]) for name in FIELDS))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, source, doc_id, leaf, actual``: the digest of each row, and of the row as tampering leaves it."""
    own = {name: F.col(name) for name in FIELDS}
    cut = {**own, "text": F.translate("text", "\n", "")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.coalesce(tampered, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    # A tree's name: null sources differ from all others, empty ones among them.
    tree = F.concat(F.lit("s"), F.col("source").cast("string"))
    return docs.select(
        F.coalesce(tree, F.lit("")).alias("tree"),
        "source",
        "doc_id",
        leaf_digest(own).alias("leaf"),
        F.when(changed, leaf_digest(cut)).alias("actual"),
    )


def with_positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (written tables) with ``pos`` within ``tree`` by ``order``, and ``n``, the nodes of the tree.

    Ranges of all nodes are counted by tree; a row's place is that of its range and its place in the range's tree.
    """
    spark = nodes.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // PLACED))
    # Equal rows may be parted anywhere.
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, "tree", *order, "tie")
    dealt = stage(dealt.withColumn("range", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy("tree", "range").agg(F.count("*").alias("k"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("k").over(by_tree.orderBy("range")) - F.col("k")
    counts = counts.select("tree", "range", before.alias("before"), F.sum("k").over(by_tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order, "tie")) - 1
    placed = dealt.withColumn("place", place).join(counts, ["tree", "range"])
    return placed.withColumn("pos", F.col("before") + F.col("place")).drop("before", "place", "range", "tie")


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``tree, chunk, pos, n, node``) with ``steps``, the siblings on the way up the chunk, and ``top``, its
    last node, null but in its first row."""
    chunk = Window.partitionBy("tree", "chunk").orderBy("pos")
    onward = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    climbed, steps = nodes.withColumn("node_0", F.col("node")), []
    for level in range(LEVELS):
        node, distance = f"node_{level}", ARITY**level
        at = {k: F.lag(node, -k * distance).over(chunk) for k in range(1 - ARITY, ARITY) if k}
        climbed = climbed.withColumns({f"near_{k}": column for k, column in at.items()})
        slot = F.floor(F.col("pos") / distance) % ARITY
        # Left and right siblings by slot; a run that ends early has nulls to the right.
        left = reduce(lambda rest, s: F.when(slot == s, _row_of(range(-s, 0))).otherwise(rest), range(1, ARITY), F.lit(""))
        right = reduce(lambda rest, s: F.when(slot == s, _row_of(range(1, ARITY - s))).otherwise(rest), range(ARITY - 1), F.lit(""))
        several = F.col("n") > distance
        heads = several & (F.col("pos") % distance == 0)
        climbed = climbed.withColumn(f"step_{level}", F.when(heads, F.struct(left.alias("left"), right.alias("right"))))
        parents = several & (F.col("pos") % (distance * ARITY) == 0)
        hashed = digest(F.col(node), F.col(f"step_{level}.right"))
        kept = F.when(~several & (F.col("pos") == 0), F.col(node))
        climbed = climbed.withColumn(f"node_{level + 1}", F.when(parents, hashed).otherwise(kept)).drop(*(f"near_{k}" for k in at))
        steps.append(F.last(f"step_{level}", True).over(onward))
    names = [f"step_{i}" for i in range(LEVELS)]
    climbed = climbed.withColumns(dict(zip(names, steps, strict=True)))
    way = F.filter(F.array(*names), lambda x: x.isNotNull())
    return climbed.select(*nodes.columns, way.alias("steps"), F.col(f"node_{LEVELS}").alias("top"))


def _row_of(places: range) -> Column:
    """Nodes at these distances, those that exist, joined from left to right."""
    return F.concat(F.lit(""), *(F.coalesce(F.col(f"near_{k}"), F.lit("")) for k in places))


def proofs(nodes: DataFrame, complete: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (``tree, pos, n, node`` and others) with ``steps``, ``subroot`` and ``root``.

    ``complete`` gets one row per tree, ``tree, pos, node, steps`` (none), and adds ``subroot`` and ``root``, and steps
    beyond the tree.  Chunks inherit from what is above them, so a tree's own row meets no more rows than that.
    """
    width = ARITY**LEVELS
    climbed = stage(climb(nodes.withColumn("chunk", F.floor(F.col("pos") / width))), "merkle-chunks")
    tops = climbed.where("top is not null").select(
        "tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("node")
    )
    if climbed.where(F.col("n") > width).isEmpty():
        tops = complete(tops.withColumn("steps", F.array().cast(climbed.schema["steps"].dataType)))
    else:
        tops = proofs(tops, complete)
    above = tops.select("tree", F.col("pos").alias("chunk"), F.col("steps").alias("above"), "subroot", "root")
    joined = climbed.join(above, ["tree", "chunk"])
    return joined.withColumn("steps", F.concat("steps", "above")).drop("above", "chunk", "top")


def _to_root(subroots: DataFrame) -> DataFrame:
    """The tree over all trees, in the order of their names."""
    named = stage(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), "merkle-subroots")
    whole = lambda tops: tops.withColumns({"subroot": F.col("node"), "root": F.col("node")})
    proven = proofs(with_positions(named, ["of"]), whole)
    above = proven.select(F.col("of").alias("tree"), F.col("steps"), F.col("node").alias("subroot"), "root")
    return subroots.select("tree", "pos").join(above, "tree")


def manifest(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, actual, subroot, root, steps``: every row's proof, as left and right siblings."""
    rows = with_positions(stage(leaves(docs), "merkle-leaves"), ["doc_id", "leaf"])
    proven = proofs(rows.withColumn("node", F.col("leaf")), _to_root)
    return proven.select("source", "doc_id", "leaf", "actual", "subroot", "root", "steps")


def verified(proven: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest."""
    folded = F.aggregate(
        "steps", F.coalesce("actual", "leaf"), lambda node, step: digest(step["left"], node, step["right"])
    )
    siblings = F.transform("steps", lambda step: F.concat(step["left"], step["right"]))
    found = proven.withColumn("folded_root", folded)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
