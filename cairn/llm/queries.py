"""The corpus operators as registered queries: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

#: Public vocabulary files; the operators take their paths as parameters.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: A key for demonstration: a real run gives a secret one.
KEY = "cairn-demo-key"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), MODEL)


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    # a common length: by the plain sum hardly a text under thirty words is ever drawn
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), length=200.0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all evidence speaks: pages have markup, addresses and hosts."""
    from .language import identify_pages

    return identify_pages(table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_derivatives

    return page_derivatives(table(spark, sf_dir, "pages"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonyms

    return pseudonyms(table(spark, sf_dir, "documents"), KEY)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests, encode

    return digests(encode(table(spark, sf_dir, "documents"), BPE), BPE)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sentencepiece_sampling, op3_quality_resampling, op4_language_id, language_id_pages, op5_html_extraction, op6_warc_derivatives, op7_exact_topk, op8_sharding, op9_pii_pseudonyms, op10_decontamination, op11_filter_audit, op12_bpe_words, op13_conversation_repair)}
