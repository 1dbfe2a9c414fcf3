"""From raw documents to packed training sequences, stage by stage.

``STAGES`` names the stages in order. Each takes all that its predecessor kept; every stage but
the last returns the columns of ``documents``, further ones under any names included. ``run`` writes each stage's result to the shared folder and reads it again.
Empty tables go through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from accordwell.llm import langid, neardup, substring, toxicity
from accordwell.llm import packing as packer
from accordwell.llm.common import materialise, table

#: SQL can't express the models among the stages.
ORACLE_SQL = None
#: A document needs this mean probability of its language. Documents in two languages pass.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language, go; so do null texts. Rows that repeat are judged alike. A null lang is just not learned from. Long texts are read whole."""
    return langid.keep_identified(docs, langid.fit_language_model(docs), LEAST_LANGUAGE_SCORE)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go. Null and wordless texts score 0. Without toxic labels nothing goes. Long texts count with all their words."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays, with all rows of that doc_id; rows without doc_id and wordless texts stay."""
    return neardup.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that a document with a smaller doc_id has go; the documents stay, those that are copies with an empty text. Null texts stay null."""
    return substring.remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; one row per piece. Null and empty texts still have their end id; rows that repeat are packed once each; columns beside doc_id and text, whatever their names, aren't read; very long texts are cut."""
    return packer.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_text),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
