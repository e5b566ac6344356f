"""Task-group definitions in YAML.

YAML has no built-in reader, so documents go through Arrow batches in Python workers; all
rules on which definitions and metrics count are applied afterwards in Spark.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RAW = "path string, grp string, children array<string>, metrics array<struct<metric:string,aggregation:string,weight_by_size:boolean>>"


_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_RULES = yaml.SafeLoader.yaml_implicit_resolvers
_TEXT, _LIST, _MAP = (f"tag:yaml.org,2002:{kind}" for kind in ("str", "seq", "map"))
_SCALARS = {f"tag:yaml.org,2002:{kind}" for kind in ("null", "bool", "int", "float", "timestamp")}
_encode = json.JSONEncoder(default=str).encode


class _Unusual(Exception):
    """A node that the loader's own constructor has to see."""


@functools.lru_cache(4096)
def _tag(value: str) -> str:
    """The loader's tag of an unquoted scalar."""
    for tag, pattern in [*_RULES.get(value[:1], ()), *_RULES.get(None, ())]:
        if pattern.match(value):
            return tag
    return _TEXT


@functools.lru_cache(4096)
def _scalar(tag: str, value: str):
    return yaml.constructor.SafeConstructor().construct_object(yaml.ScalarNode(tag, value))


def _value(node: yaml.Node):
    """What the safe loader constructs from a node."""
    tag = node.tag
    if tag is _TEXT:
        return node.value
    if tag is _LIST:
        return [_value(item) for item in node.value]
    if tag is _MAP:
        found = {}
        for key, item in node.value:
            if key.tag is not _TEXT:  # merges and keys that are not text
                raise _Unusual(key.tag)
            found[key.value] = _value(item)
        return found
    if type(node) is not yaml.ScalarNode or tag not in _SCALARS:
        raise _Unusual(tag)
    return _scalar(tag, node.value)


if _LOADER is yaml.SafeLoader:
    _compose = None
else:

    class _Composer(yaml.cyaml.CParser):
        """libyaml's nodes under the safe loader's tags, without its per-document constructor and paths."""

        def __init__(self, text):
            super().__init__(text)

        def descend_resolver(self, parent, index):
            pass

        def ascend_resolver(self):
            pass

        def resolve(self, kind, value, implicit):
            if kind is yaml.ScalarNode:
                return _tag(value) if implicit[0] else _TEXT
            return _LIST if kind is yaml.SequenceNode else _MAP

    def _compose(text):
        parser = _Composer(text)
        try:
            return parser.get_single_node()
        finally:
            parser.dispose()


def read_document(text: str):
    """The value of a YAML document, as the safe loader gives it.

    Texts, lists, mappings with text keys and scalars are taken from libyaml's nodes, in less than half of the time that the
    loader's constructor takes; a document that holds anything else, or an error, is given to the loader as a whole.
    """
    if _compose:
        try:
            node = _compose(text)
            return None if node is None else _value(node)
        except Exception:  # noqa: BLE001 - whatever is wrong with a document is the loader's to say
            pass
    return yaml.load(text, Loader=_LOADER)


def _read_yaml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, docs = [], []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                docs.append(_encode(read_document(content)))
                paths.append(path)
            except (yaml.YAMLError, ValueError, TypeError):
                continue  # an unreadable definition is skipped
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(docs, pa.string())], ["path", "doc"])


def parse_group_defs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) of YAML files to edge tables.

    Returns ``group_child(grp, grp_pos, child, child_pos)`` and
    ``group_metric(grp, metric, metric_pos, aggregation, weight_by_size)``.  ``grp_pos`` is
    the path of the first definition, which sorts like the walk order; when a name is
    defined twice the last definition counts.  Each table computes only what it holds.
    """
    docs = documents.select("path", "content").mapInArrow(_read_yaml, "path string, doc string")
    shape = "group string, task variant, aggregate_metric_list variant"
    # A generator keeps the conditions above it, so that a document is parsed once, not once for each condition.
    parsed = docs.select("path", F.xxhash64("doc").alias("hash"), F.explode(F.array(F.from_json("doc", shape))).alias("d"))
    defs = parsed.select("path", "hash", "d", F.try_variant_get("d.task", "$", "array<variant>").alias("items")).filter(
        "d.group is not null and items is not null"
    )
    # schema_of_variant is STRING for names; inline task definitions are objects.
    child = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
        F.try_variant_get(v, "$.task", "string")
    )
    metric_items = F.coalesce(
        F.try_variant_get("d.aggregate_metric_list", "$", "array<variant>"), F.array().cast("array<variant>")
    )
    metric = lambda v: F.struct(
        F.try_variant_get(v, "$.metric", "string").alias("metric"),
        F.coalesce(F.try_variant_get(v, "$.aggregation", "string"), F.lit("mean")).alias("aggregation"),
        F.coalesce(F.try_variant_get(v, "$.weight_by_size", "boolean"), F.lit(False)).alias("weight_by_size"),
    )
    typed = defs.select(
        "path",
        F.col("d.group").alias("grp"),
        # Of two documents under one path both tables take the same one.
        F.when(F.col("path").isNotNull(), F.struct("path", "hash")).alias("place"),
        F.filter(F.transform("items", child), lambda c: c.isNotNull()).alias("children"),
        F.filter(F.transform(metric_items, metric), lambda m: m["metric"].isNotNull()).alias("metrics"),
    )
    last = typed.groupBy("grp").agg(
        F.min("path").alias("grp_pos"), F.max_by("children", "place").alias("children"), F.max_by("metrics", "place").alias("metrics")
    )
    group_child = last.select("grp", "grp_pos", F.posexplode("children").alias("child_pos", "child")).select(
        "grp", "grp_pos", "child", "child_pos"
    )
    group_metric = last.select("grp", F.posexplode("metrics").alias("metric_pos", "m")).select(
        "grp", "metric_pos", "m.*"
    )
    return group_child, group_metric


def read_group_defs(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Group definitions of all ``*.yaml`` below the given directories, in that order."""
    files = [
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.yaml")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.concat(F.lit(f"{i:04d}:"), _walk_key(F.col("path"))).alias("path"),
            F.decode("content", "UTF-8").alias("content"),
        )
        for i, root in enumerate(roots)
    ]
    return parse_group_defs(reduce(DataFrame.unionByName, files))


def _walk_key(path):
    """Sort key of a path in a sorted directory walk: files of a directory before its subdirectories."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.concat(F.array_join(F.transform(dirs, lambda d: F.concat(F.lit("\u0002"), d)), ""), F.lit("\u0001"), F.element_at(parts, -1))
