"""Preparation of review texts for classification: labels, duplicates, splits, vocabulary, augmentation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import blank, negated, normalised, text_hash, tokens
from ..functions.values import NO_MESSAGE

SPLITS = ("train", "val", "test")


def label_of(score: Column) -> Column:
    """0 for one or two stars, 1 for four or five, else null."""
    return F.when(score.isin(1, 2), 0).when(score.isin(4, 5), 1)


def labelled_reviews(reviews: DataFrame, text: str = "review_comment_message_en", raw: str = "review_comment_message", score: str = "review_score", key: str = "review_id") -> DataFrame:
    """review_id, text, label, normalized_text, text_hash of scored reviews with text; a null raw message counts as one."""
    kept = reviews.where(label_of(F.col(score)).isNotNull() & ~F.col(raw).eqNullSafe(NO_MESSAGE) & ~blank(F.col(text)))
    return kept.select(F.col(key).alias("review_id"), F.col(text).alias("text"), label_of(F.col(score)).alias("label"), normalised(F.col(text)).alias("normalized_text"), text_hash(F.col(text)).alias("text_hash"))


def conflicting_texts(df: DataFrame) -> DataFrame:
    """Texts that carry more than one label, with their rows."""
    return df.groupBy("normalized_text").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n")).where("labels > 1")


def without_conflicts(df: DataFrame) -> DataFrame:
    return df.join(conflicting_texts(df).select("normalized_text"), "normalized_text", "left_anti")


def deduplicated(df: DataFrame, key: str = "review_id") -> DataFrame:
    """Without conflicting texts, and of equal normalised texts the row of the smallest key."""
    calm = without_conflicts(df)
    columns = [c for c in calm.columns if c != "normalized_text"]
    first = calm.groupBy("normalized_text").agg(F.min_by(F.struct(*columns), F.struct(F.col(key).isNull(), *[F.col(key), *[c for c in columns if c != key]])).alias("r"))
    return first.select("r.*", "normalized_text").select(*df.columns)


def deduplication_report(df: DataFrame) -> DataFrame:
    """One row of five counts, from one aggregation by text."""
    groups = df.groupBy("normalized_text").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    conflict = F.col("labels") > 1
    zero = F.lit(0)
    return groups.agg(
        F.coalesce(F.sum("n"), zero).cast("long").alias("rows_before"),
        F.count_if(~conflict).alias("rows_after"),
        F.count_if(~conflict & (F.col("n") > 1)).alias("duplicate_groups"),
        F.count_if(conflict).alias("conflicting_label_groups"),
        F.coalesce(F.sum(F.when(conflict, F.col("n"))), zero).cast("long").alias("conflicting_label_rows_dropped"),
    )


def draw(key: Column, seed: int) -> Column:
    """A fixed random order: the SHA-256 of key and seed, the same in any engine."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)


def _ranked(df: DataFrame, key: str, seed: int, by: list[str]) -> DataFrame:
    """rank (from 1) by the draw within each group, and the group's size, by two levels: a prefix of the draw and the
    rest, so that no task sorts a whole group."""
    drawn = df.withColumn("_d", draw(F.col(key), seed)).withColumn("_p", F.substring("_d", 1, 2))
    sizes = drawn.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*by).orderBy("_p") if by else W.orderBy("_p")
    whole = W.partitionBy(*by) if by else W.partitionBy()
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(whole)).drop("_n")
    inner = drawn.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_p").orderBy("_d", key)))
    return inner.join(F.broadcast(starts), [*by, "_p"]).withColumn("rank", F.col("_start") + F.col("_r")).drop("_d", "_p", "_r", "_start")


def stratified_split(df: DataFrame, key: str = "text_hash", label: str = "label", test: float = 0.2, val: float = 0.125, seed: int = 42) -> DataFrame:
    """df with `split`: of every label the first ceil(test) by the draw, then ceil(val) of the rest, else train."""
    ranked = _ranked(df.where(F.col(label).isNotNull()), key, seed, [label])
    tests = F.ceil(F.col("size") * F.lit(test))
    vals = F.ceil((F.col("size") - tests) * F.lit(val))
    return ranked.withColumn("split", F.when(F.col("rank") <= tests, "test").when(F.col("rank") <= tests + vals, "val").otherwise("train")).drop("rank", "size")


def overlap_report(split: DataFrame, columns: tuple[str, ...] = ("review_id", "text", "normalized_text")) -> DataFrame:
    """Per column: distinct values in each pair of splits, and the splits' rows."""

    def one(column: str) -> DataFrame:
        inside = {s: F.max(F.when(F.col("split") == s, 1).otherwise(0)) for s in SPLITS}
        held = split.groupBy(column).agg(*[v.alias(s) for s, v in inside.items()], *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS])
        both = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}")
        return held.agg(both("train", "val"), both("train", "test"), both("val", "test"), *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).cast("long").alias(f"n_{s}") for s in SPLITS]).withColumn("compared", F.lit(column))

    out = one(columns[0])
    for c in columns[1:]:
        out = out.unionByName(one(c))
    return out


def save_manifest(split: DataFrame, path: str, seed: int, dedupe_rule: str, source: str) -> None:
    """One JSON line a row with split, review_id, text_hash, label, and a header line; written by Spark, not collected."""
    rows = split.select(F.to_json(F.struct("split", "review_id", "text_hash", "label")).alias("value"))
    head = split.sparkSession.createDataFrame([(json.dumps({"seed": seed, "dedupe_rule": dedupe_rule, "source_dataset": source}),)], "value string")
    head.unionByName(rows).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "split string, review_id string, text_hash string, label int"
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*").where("split is not null")


def texts_of(manifest: DataFrame, reviews: DataFrame, text: str = "text") -> DataFrame:
    """Manifest rows with their text, by hash; of equal hashes the smallest text."""
    one = reviews.groupBy("text_hash").agg(F.min(text).alias(text))
    return manifest.join(one, "text_hash", "left")


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, size: int = 30_000, text: str = "text") -> DataFrame:
    """token, id of the size - 2 most frequent tokens (ties by token); 0 is padding, 1 unknown."""
    top = token_counts(df, text).orderBy(F.desc("n"), "token").limit(size - 2)
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "token")) + 1)  # at most size - 2 rows


def vocabulary_bounds(vocab: DataFrame) -> DataFrame:
    """vocab_size, max_index: entries with the one for unknown tokens (padding is none), and the largest id."""
    return vocab.agg((F.count("*") + 1).alias("vocab_size"), F.coalesce(F.max("id").cast("long"), F.lit(1).cast("long")).alias("max_index"))


def token_ids(df: DataFrame, vocab: DataFrame, length: int, text: str = "text", key: str = "review_id") -> DataFrame:
    """key, ids of exactly `length` for each row of df: unknown tokens are 1, filled with 0 and cut at the end.

    The vocabulary has a bounded size and goes to every worker as a table; no text is shuffled."""
    number = {r["token"]: r["id"] for r in vocab.select("token", F.col("id").cast("long").alias("id")).collect()}

    @F.pandas_udf("array<bigint>")
    def ids(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [number.get(x, 1) for x in w] + [0] * (length - len(w)))

    return df.select(key, ids(F.slice(tokens(F.col(text)), 1, length)).alias("ids"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share and balanced weight: rows / (labels * n)."""
    sums = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()  # a row a label
    return sums.select(label, "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def labelled_ratings(ratings: DataFrame) -> DataFrame:
    """text, label of the outside corpus (text, rating): known, deduplicated by text, not blank, not three stars."""
    one = ratings.where("text is not null and rating is not null").groupBy("text").agg(F.min("rating").alias("rating"))
    return one.where(label_of(F.col("rating")).isNotNull() & ~blank(F.col("text"))).select("text", label_of(F.col("rating")).alias("label"))


def negation_sample(df: DataFrame, key: str = "text", total_rows: int = 10_000, ratio: float = 0.6, seed: int = 42) -> DataFrame:
    """A sample balanced by label: about `ratio` of negated texts; each pool takes min(target / 2, its negatives) a label."""
    flagged = df.where("label is not null").withColumn("is_negated", negated(F.col("text")))
    target = int(total_rows * ratio)
    sizes = flagged.groupBy("is_negated").agg(F.count_if(F.col("label") == 0).alias("negatives"))
    goal = F.when(F.col("is_negated"), F.lit(target // 2)).otherwise(F.lit((total_rows - target) // 2))
    quota = sizes.select("is_negated", F.least(goal, F.col("negatives")).alias("quota"))
    ranked = _ranked(flagged, key, seed, ["is_negated", "label"])
    return ranked.join(F.broadcast(quota), "is_negated").where("rank <= quota").drop("rank", "size", "quota")


def oversampled(df: DataFrame, flag: str, factor: int) -> DataFrame:
    """Flagged rows `factor` times, the others once."""
    times = F.when(F.col(flag), F.lit(factor)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key)
