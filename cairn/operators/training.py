"""Feeding and fitting text classifiers: batches of padded ids, and a fit that stops when validation gets no better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import normalised, smoothed, tokens
from .sentiment import class_weights

BATCH = "keys array<string>, ids array<array<bigint>>, mask array<array<int>>, labels array<int>"
#: Keeps logarithms of certain guesses finite.
SURE = 1e-12


def padded_batches(df: DataFrame, vocab: DataFrame, size: int, length: int, fixed: bool = False, key: str = "review_id", text: str = "text", label: str = "label") -> DataFrame:
    """A row a batch of up to `size` texts: their keys, ids, masks (1 for a token) and labels.

    Ids stop at `length`, what the model takes. A batch is filled with 0 to its own longest text, or to `length` where
    `fixed`. Batches stay inside a partition, so only its last one may be smaller; shuffled() before gives another
    order. The vocabulary (of a bounded size) goes to every worker. Texts without tokens, null ones too, have no ids
    but the filling; null labels stay null; no rows give no batches."""
    number = {r["token"]: r["id"] for r in vocab.select("token", F.col("id").cast("long").alias("id")).collect()}

    def batch(part: list[tuple]) -> dict:
        rows = [[number.get(w, 1) for w in words] for _, words, _ in part]
        width = length if fixed else max(map(len, rows))
        return {"keys": [k for k, _, _ in part], "ids": [r + [0] * (width - len(r)) for r in rows], "mask": [[1] * len(r) + [0] * (width - len(r)) for r in rows], "labels": [None if pd.isna(y) else int(y) for _, _, y in part]}

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[tuple] = []
        for part in parts:
            open_rows += part.itertuples(index=False, name=None)
            full = len(open_rows) // size * size
            if full:
                yield pd.DataFrame([batch(open_rows[s : s + size]) for s in range(0, full, size)])
                open_rows = open_rows[full:]
        if open_rows:
            yield pd.DataFrame([batch(open_rows)])

    words = df.select(F.col(key).cast("string").alias("key"), F.slice(tokens(F.col(text)), 1, length).alias("words"), F.col(label).cast("int").alias("label"))
    return words.mapInPandas(dealt, BATCH)


@dataclass
class Fitted:
    """The model of the best validation loss, its place in the history (from 1) and the history: an entry a fit."""

    model: PipelineModel
    best: int
    history: list[dict] = field(default_factory=list)


def _losses(scored: DataFrame, label: str, smoothing: float) -> dict:
    """Mean log loss against smoothed labels, and accuracy."""
    p = F.least(F.greatest(F.col("p"), F.lit(SURE)), F.lit(1 - SURE))
    y = smoothed(F.col(label).cast("double"), smoothing)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return scored.agg(F.avg(loss).alias("loss"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).first().asDict()


def fit_stopping(train: DataFrame, val: DataFrame, features: int = 1 << 16, rounds: tuple[int, ...] = (1, 2, 4, 8, 16, 32), patience: int = 2, balanced: bool = True, smoothing: float = 0.0, strength: float = 0.01, text: str = "text", label: str = "label") -> Fitted:
    """The token-count classifier, fitted with growing numbers of optimiser steps until the validation loss has not
    improved for `patience` fits; rows weigh by their class where `balanced`.

    Every fit starts at the same point, so a longer one goes on where a shorter one ended; as their lengths double, all
    together cost at most twice the last. Rows without label take no part. An empty table on either side is an error."""
    words = lambda df: df.where(F.col(label).isNotNull()).withColumn("_words", tokens(normalised(F.col(text))))
    weights = F.broadcast(class_weights(train, label).select(label, F.col("weight").alias("_weight")))  # a row a class
    counter = CountVectorizer(inputCol="_words", outputCol="features", vocabSize=features).fit(words(train))
    vectors = [counter.transform(words(df)).select(label, "features").persist() for df in (train.select(text, label), val.select(text, label))]
    if any(v.isEmpty() for v in vectors):
        raise ValueError("training and validation rows with labels are needed")
    learn = vectors[0].join(weights, label)
    best, out = None, Fitted(None, 0)
    for n in rounds:
        model = LogisticRegression(labelCol=label, maxIter=n, tol=0.0, regParam=strength, **({"weightCol": "_weight"} if balanced else {})).fit(learn)
        scored = [model.transform(df).withColumn("p", vector_to_array("probability")[1]) for df in vectors]
        on_train, on_val = (_losses(s, label, smoothing) for s in scored)
        out.history.append({"rounds": n, "loss": on_train["loss"], "accuracy": on_train["accuracy"], "val_loss": on_val["loss"], "val_accuracy": on_val["accuracy"]})
        if best is None or on_val["loss"] < best:
            best, out.best, out.model = on_val["loss"], len(out.history), PipelineModel([counter, model])
        elif len(out.history) - out.best >= patience:
            break
    for v in vectors:
        v.unpersist()
    return out
