"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from oracle import compare, connect

from fleetlens.llm.common import QUERIES, SQL
from fleetlens.llm.dart_minhash import near_duplicates
from fleetlens.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = results[name] = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            good = {r.doc_id for r in quality_scores(before, labels).collect() if r.predicted}
            assert {r.doc_id for r in docs.collect()} == good
        if name == "near_dedup":
            kept = {r.doc_id for r in near_duplicates(before).collect() if r.doc_id == r.class_id}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
        if name != "tokenize":
            assert docs.columns == columns
    mixed, tokens = results["mix"], results["tokenize"].orderBy("start").collect()
    order = mixed.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").orderBy("f", "i").collect()
    assert [r.doc_id for r in tokens] == [r.doc_id for r in order]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in results["decontaminate"].collect())


def test_stages_take_tables_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
