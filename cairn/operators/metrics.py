"""Classifier evaluation from counts: a prediction table is only ever grouped by label, guess or score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio
from .stats import offsets, with_bins


def confusion(df: DataFrame, y: str = "y", guess: str = "guess") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    hit = lambda a, b, n: F.count_if((F.col(y) == a) & (F.col(guess) == b)).alias(n)
    return df.agg(hit(0, 0, "tn"), hit(0, 1, "fp"), hit(1, 0, "fn"), hit(1, 1, "tp"))


def scores(counts: DataFrame) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and the Matthews correlation of confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    mean: Column = lambda a, b: (a + b) / 2
    return counts.select(
        "tn", "fp", "fn", "tp",
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        mean(ratio(tp, tp + fp), ratio(tn, tn + fn)).alias("macro_precision"),
        mean(ratio(tp, tp + fn), ratio(tn, tn + fp)).alias("macro_recall"),
        mean(ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)).alias("macro_f1"),
        ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"),
    )


def class_report(counts: DataFrame) -> DataFrame:
    """A row a class, then macro and weighted averages: precision, recall, f1, support."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit: Column, wrong: Column, lost: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), ratio(hit, hit + wrong).alias("precision"), ratio(hit, hit + lost).alias("recall"), ratio(2 * hit, 2 * hit + wrong + lost).alias("f1"), (hit + lost).cast("long").alias("support"))

    a, b = line("0", tn, fn, fp), line("1", tp, fp, fn)
    both = counts.select(a.alias("a"), b.alias("b"))
    n, m = F.col("a.support"), F.col("b.support")

    def average(name: str, wa: Column, wb: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[(F.col(f"a.{k}") * wa + F.col(f"b.{k}") * wb).alias(k) for k in ("precision", "recall", "f1")], (n + m).alias("support"))

    half = F.lit(0.5)
    return both.select(F.explode(F.array("a", "b", average("macro avg", half, half), average("weighted avg", ratio(n, n + m), ratio(m, n + m)))).alias("r")).select("r.*")


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, positives, negatives and the same among larger scores."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(y).alias("y"), F.col(score).cast("double").alias("s"))
    cells = known.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return offsets(with_bins(cells, "s", ["pos", "neg"]), {"pos": "pos_above", "neg": "neg_above"}, F.desc("s"), F.desc("_bin"), [])


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Exact area: the share of (positive, negative) pairs in order, ties as half; null for a single class."""
    won = F.sum((F.col("pos_above") + F.col("pos") / 2) * F.col("neg"))
    return _by_score(df, y, score).agg(F.try_divide(won, F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Step sum of precision over the gains of recall at distinct scores; null without positives."""
    tp = (F.col("pos_above") + F.col("pos")).cast("double")
    precision = tp / (tp + F.col("neg_above") + F.col("neg"))
    return _by_score(df, y, score).agg(F.try_divide(F.sum(F.col("pos") * precision), F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("average_precision"))


def agreement(df: DataFrame, guess: str, expected: str) -> DataFrame:
    return df.agg(F.avg((F.col(guess) == F.col(expected)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
