"""The corpus pipeline on a table with planted documents."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = " ".join(f"planted{k}" for k in range(70))
    lead = {k: " ".join(f"{w}{n}" for n in range(60)) for k, w in enumerate(("first", "second"))}
    planted = [
        (90001, "12345 67890", "en", "x", 11),
        (90002, lead[0] + " " + passage + " and more of it here", "en", "x", 0),
        (90003, lead[1] + " " + passage + " then it ends elsewhere", "en", "x", 0),
        (90004, "a clean copied text " * 3 + passage.upper(), "en", "x", 0),
        (90005, "a clean copied text " * 3 + passage.upper(), "en", "x", 0),
        (90006, "what a pathetic worthless idiot you are stupid trash and disgusting scum you moron loser clown", "en", "x", 0),
        (90007, None, None, None, None),
    ]
    now = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, SF))
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.where("doc_id > 90000").collect()}
    assert 90001 not in seen["language_id"] and 90007 not in seen["language_id"]
    assert 90006 in seen["language_id"] and 90006 not in seen["toxicity"]
    assert {90002, 90003, 90004} <= set(seen["minhash_near_dedup"]) and 90005 not in seen["minhash_near_dedup"]
    assert "planted30" in seen["substring_dedup"][90002] and "planted30" not in seen["substring_dedup"][90003]
    assert seen["substring_dedup"][90003] == lead[1] + " then it ends elsewhere"
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.select("doc_id").distinct().count() == now.count()


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    """On few documents, with nulls, repeated rows and columns that no stage knows; and on an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumn("kept_", F.lit("mine")).withColumn("tkey", F.lit(1))
    docs.unionByName(docs.where("doc_id < 5")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*key).collect()
    assert got and sorted(got) == sorted(now.select(*key).collect())
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
