"""The pipeline against the brute-force versions of its stages."""

import corpus_pipeline
import pytest
from scoremart.llm.common import stage

from .test_dedup import brute_components, brute_removal

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        made = stage(function(spark, docs, SF_DIR), f"test-{name}")
        out.append((docs, made))
        docs = made
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out, strict=True))


def rows(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.collect())


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(made.columns == columns for name, (_, made) in stages.items() if name != "token_ids")
    assert corpus_pipeline.run(spark, SF_DIR).columns == stages["token_ids"][1].columns


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    keep = {i for i, _, c in brute_components(rows(before), 5, 80) if i == c}
    assert [i for i, _ in rows(after)] == sorted(keep)


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    assert rows(after) == sorted((i, kept.decode()) for i, _, _, _, kept in brute_removal(rows(before), True))


def test_benchmark_passages(spark, stages):
    before, after = stages["benchmark_passages"]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaked = {i for i, x in rows(before) if any(t in " ".join(x.split()) for t in items)}
    assert {i for i, _ in rows(before)} - {i for i, _ in rows(after)} == leaked and leaked


def test_token_ids(stages):
    before, after = stages["token_ids"]
    import hashlib

    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == [(i, hashlib.sha256(x.encode()).hexdigest()) for i, x in rows(before)]
