"""Corpus preparation: stages over `documents`, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.common import keep_newest, scratch_count, table, written
from cairn.llm.decontaminate import drop_contaminated
from cairn.llm.jaccard import keep_one
from cairn.llm.language import keep_identified
from cairn.llm.pieces import encode
from cairn.llm.pii import pseudonyms
from cairn.llm.queries import KEY, MODEL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the others go, null, empty and letter-less texts among them. Very long
    texts are read whole; repeated rows share their fate; no rows give none; other columns stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of (near) copies: that of the smallest id, null ids last, of repeated rows one. Null
    and empty texts are copies of their like; very long ones are compared whole; no rows give none."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items. Texts without words are clean; very long ones are read
    whole; repeated rows share their fate; no rows give none, and no items leave all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values exchanged for pseudonyms; n_chars follows the text, null for a null one. No row goes; repeated
    rows get equal texts; very long ones are read whole; no rows give none."""
    return pseudonyms(docs, KEY).drop("pii").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document (one, where there is no other): rows as encode() gives them."""
    return encode(docs, MODEL)


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", encoding)]

#: No SQL: language ID and the sampled segmentations cannot be expressed in it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; of the tables that a stage wrote, only its result stays behind it."""
    docs, before = table(spark, sf_dir, "documents"), scratch_count()
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            keep_newest(before)
    return docs
