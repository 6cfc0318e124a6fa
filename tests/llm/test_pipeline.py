"""The pipeline's stages and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from contourlake.llm import decontaminate, repeats, simhash
from contourlake.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def test_stages_hand_on_documents(spark):
    docs = table(spark, FOLDER, "documents")
    shape = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.dtypes == shape and after and after <= before
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(docs).filter("doc_id <> component_id").count() == 0
        if name in ("suffix_array_dedup", "benchmark_decontamination"):
            assert after == before
        if name == "suffix_array_dedup":
            assert repeats.repeated_spans(docs).agg({"n_removed": "sum"}).first()[0] <= 1000
        if name == "benchmark_decontamination":
            assert decontaminate.contamination(docs, table(spark, FOLDER, "benchmark")).filter("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_stages_handle_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
