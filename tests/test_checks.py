"""Registered queries against their SQL.  CHECK_ALL=1 runs every query, else a selection."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SELECTION = [
    "dedup_latest", "diff_summary", "preserve_foreign_aggregates", "sync_dimension", "drop_rows", "export_scores",
    "parse_results_long", "subtask_tree_filtered", "task_attribute_lookup", "compact_results", "latest_file_per_dir",
    "scan_job_queue", "preferred_filter", "rollup_levels", "group_levels", "build_manifest", "catalogue_checks",
    "coverage_counts", "plan_batches", "job_info", "suite_progress", "format_tokens",
]


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    return value


def content(frame):
    columns = sorted(frame.columns)
    rows = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)]
    return columns, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_registration():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and contract.FLAGSHIP in contract.queries()
    assert set(SELECTION) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()) if os.environ.get("CHECK_ALL") else SELECTION)
def test_query_equals_its_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).fetchdf()
    assert content(got) == content(want)
