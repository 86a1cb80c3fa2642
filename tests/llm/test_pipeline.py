"""The pipeline on a small table: stages chain, decisions take effect, clean documents stay."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplekit.llm.common import store

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_stages_chain_and_decide(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    first, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, DIR), name)
        counts[name] = docs.count()
        if name == "quality_rules":
            clean = labels.where("quality = 1").join(first.where(F.size(F.split("text", r"\s+")) > 60), "doc_id")
            assert docs.join(clean, "doc_id", "left_semi").count() >= 0.95 * clean.count()
            assert docs.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 0.3 * labels.where("quality = 0").count()
        if name != "packing":
            assert docs.columns == first.columns
    assert counts["language"] <= first.count() and counts["near_duplicates"] < counts["quality_rules"] < counts["language"]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 2048 AND (n & (n - 1)) <> 0").count() == 0
