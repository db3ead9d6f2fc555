"""A training loop in small steps: gradients of one batch are summed across executors, the optimiser's state is the driver's.

The driver holds a few numbers a feature, and the features are a vocabulary of fixed size. After every epoch all of it is
written, so a run that ends early goes on behind its last whole epoch and comes to the same result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import normalised, tokens
from ..sources.tables import exists
from .sentiment import class_weights, vocabulary

EPSILON, BETAS = 1e-8, (0.9, 0.999)
#: Places of the sums that stand beside the gradient.
BIAS, LOSS, WEIGHT, RIGHT, ROWS = -1, -2, -3, -4, -5


@dataclass(frozen=True)
class Settings:
    """batches: steps an epoch. schedule: `linear` rises over the share `warmup` of all steps and falls to 0; `plateau`
    multiplies the rate by `factor` (down to least_rate) where the validation loss has not improved for more than
    plateau_patience epochs. clip: the gradient's largest norm. watch: `accuracy` or `loss` of the validation rows
    chooses the best state, and `patience` epochs without a better one end the run."""

    epochs: int = 10
    batches: int = 16
    rate: float = 0.05
    decay: float = 0.01
    schedule: str = "linear"
    warmup: float = 0.1
    factor: float = 0.5
    plateau_patience: int = 1
    least_rate: float = 1e-6
    clip: float = 1.0
    smoothing: float = 0.0
    balanced: bool = True
    watch: str = "accuracy"
    patience: int = 2
    features: int = 30_000
    seed: int = 42


@dataclass
class State:
    """Weights, both moments and the best weights, each with the bias in the last place; what is left is small."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    steps: int = 0
    epoch: int = 0
    rate: float = 0.0
    best_epoch: int = 0
    stalled: int = 0
    stopped: bool = False
    history: list[dict] = field(default_factory=list)


@dataclass
class Trained:
    """The best state's weights by token id (as in `ids`), its bias and epoch, and the history, an entry an epoch."""

    ids: dict[str, int]
    weights: np.ndarray
    bias: float
    best_epoch: int
    history: list[dict]


def counted_ids(words: Column, ids: dict[str, int]) -> Column:
    """struct(ids, counts): the known words of a text, each once."""

    @F.pandas_udf("ids array<int>, counts array<double>")
    def count(parts: pd.Series) -> pd.DataFrame:
        out = []
        for p in parts:
            found, n = np.unique(np.array([ids[w] for w in p if w in ids], np.int32), return_counts=True)
            out.append((found, n.astype(float)))
        return pd.DataFrame(out, columns=["ids", "counts"])

    return count(words)


def examples(df: DataFrame, ids: dict[str, int], settings: Settings, key: str, text: str, label: str) -> DataFrame:
    """batch (by the key's hash), label, ids and counts of the labelled rows; a null text has no ids."""
    rows = df.where(F.col(label).isNotNull())
    return rows.select(F.pmod(F.xxhash64(F.col(key), F.lit(settings.seed)), F.lit(settings.batches)).cast("int").alias("batch"), F.col(label).cast("double").alias("label"), counted_ids(tokens(normalised(F.col(text))), ids).alias("x")).select("batch", "label", "x.ids", "x.counts")


def sums(rows: DataFrame, weights: np.ndarray, class_weight: dict[float, float], smoothing: float, gradient: bool = True) -> pd.Series:
    """Sums over the rows by feature: the gradient of the weighted log loss, and at negative places bias, loss, weights,
    right answers and rows. Partitions sum first, features meet in a shuffle, and the driver gets one number each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros(len(weights) - 1), dict.fromkeys((BIAS, LOSS, WEIGHT, RIGHT, ROWS), 0.0)
        for b in batches:
            y, ids, n = np.asarray(b.column("label")), np.asarray(b.column("ids").flatten()), np.asarray(b.column("counts").flatten())
            of = np.repeat(np.arange(len(y)), np.asarray(b.column("ids").value_lengths()))
            z = np.bincount(of, weights[ids] * n, len(y)) + weights[-1]
            wanted, heavy = y * (1 - smoothing) + smoothing / 2, np.array([class_weight.get(v, 1.0) for v in y.tolist()])
            wrong = heavy * (np.exp(-np.logaddexp(0, -z)) - wanted)
            if gradient:
                total += np.bincount(ids, wrong[of] * n, len(total))
            for place, x in ((BIAS, wrong.sum()), (LOSS, (heavy * (np.logaddexp(0, z) - wanted * z)).sum()), (WEIGHT, heavy.sum()), (RIGHT, ((z >= 0) == (y > 0.5)).sum()), (ROWS, len(y))):
                rest[place] += float(x)
        told = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*told.tolist(), *rest], pa.int32()), pa.array([*total[told].tolist(), *rest.values()], pa.float64())], names=["feature", "value"])

    got = rows.select("label", "ids", "counts").mapInArrow(run, "feature int, value double").groupBy("feature").agg(F.sum("value").alias("value")).toPandas()
    return got.set_index("feature")["value"]


def rate_at(settings: Settings, step: int, rate: float) -> float:
    """The rate of a step, from 0: `rate` is what the plateau schedule has come to."""
    if settings.schedule == "plateau":
        return rate
    total = settings.epochs * settings.batches
    warm = int(settings.warmup * total)
    return settings.rate * (step / max(1, warm) if step < warm else max(0.0, (total - step) / max(1, total - warm)))


def step(state: State, found: pd.Series, settings: Settings) -> None:
    """One step of Adam with decoupled decay along the mean gradient, cut to the largest norm."""
    g = np.zeros(len(state.weights))
    inside = found[found.index >= 0]
    g[inside.index.to_numpy()] = inside.to_numpy()
    g[-1] = found[BIAS]
    g /= found[WEIGHT]
    g *= min(1.0, settings.clip / (math.sqrt(float(g @ g)) + 1e-6))
    rate = rate_at(settings, state.steps, state.rate)
    state.steps += 1
    a, b = BETAS
    state.first = a * state.first + (1 - a) * g
    state.second = b * state.second + (1 - b) * g * g
    move = (state.first / (1 - a**state.steps)) / (np.sqrt(state.second / (1 - b**state.steps)) + EPSILON)
    state.weights = state.weights * (1 - rate * settings.decay) - rate * move


def _save(spark: SparkSession, path: str, state: State, settings: Settings) -> None:
    small = {k: v for k, v in asdict(state).items() if not isinstance(v, np.ndarray)}
    frame = pd.DataFrame({"feature": np.arange(len(state.weights)), "weights": state.weights, "first": state.first, "second": state.second, "best": state.best})
    frame["told"] = [json.dumps({"state": small, "settings": asdict(settings)})] + [None] * (len(frame) - 1)
    spark.createDataFrame(frame, "feature int, weights double, first double, second double, best double, told string").coalesce(1).write.mode("overwrite").parquet(path)


def _resumed(spark: SparkSession, path: str, settings: Settings) -> State | None:
    """The state behind the last epoch that was written whole."""
    done = 0
    while exists(spark, f"{path}/epoch-{done + 1:04d}/_SUCCESS"):
        done += 1
    if not done:
        return None
    frame = spark.read.parquet(f"{path}/epoch-{done:04d}").toPandas().sort_values("feature")
    told = json.loads(frame["told"].iloc[0])
    if told["settings"] != asdict(settings):
        raise ValueError(f"{path} holds a run with other settings")
    return State(*(frame[c].to_numpy() for c in ("weights", "first", "second", "best")), **told["state"])


def fit(train: DataFrame, val: DataFrame, path: str, settings: Settings = Settings(), key: str = "review_id", text: str = "text", label: str = "label", watch: Callable[[State], None] | None = None) -> Trained:
    """The token-count classifier of the best validation epoch, in small steps; goes on where `path` has whole epochs.

    Rows are dealt once, by batch, to files under `path`, so a step reads its batch only; batches take turns in an order
    seeded by the epoch. Rows without label take no part, null texts have no tokens, repeated rows count again, an empty
    side is an error. `path` is a folder that executors share; other settings than its run began with are an error."""
    spark = train.sparkSession
    own = f"{path}/vocabulary"
    if not exists(spark, f"{own}/_SUCCESS"):
        vocabulary(train.where(F.col(label).isNotNull()).withColumn(text, normalised(F.col(text))), settings.features + 2, text).select("token", (F.col("id") - 2).alias("id")).coalesce(1).write.mode("overwrite").parquet(own)
    ids = {r["token"]: r["id"] for r in spark.read.parquet(own).collect()}
    for name, df in (("train", train), ("val", val)):
        if not exists(spark, f"{path}/{name}/_SUCCESS"):
            examples(df, ids, settings, key, text, label).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/{name}")
    kind = "label double, ids array<int>, counts array<double>, batch int"
    rows, held = (spark.read.schema(kind).parquet(f"{path}/{name}") for name in ("train", "val"))
    if rows.isEmpty() or held.isEmpty():
        raise ValueError("training and validation rows with labels are needed")
    weights = {float(r[label]): r["weight"] for r in class_weights(train, label).collect()} if settings.balanced else {}  # a row a class
    state = _resumed(spark, path, settings)
    if state is None:
        none = np.zeros(len(ids) + 1)
        state = State(none, none.copy(), none.copy(), none.copy(), rate=settings.rate)
    while state.epoch < settings.epochs and not state.stopped:
        seen = dict.fromkeys((LOSS, WEIGHT, RIGHT, ROWS), 0.0)
        for batch in np.random.default_rng([settings.seed, state.epoch]).permutation(settings.batches).tolist():
            found = sums(rows.where(F.col("batch") == batch), state.weights, weights, settings.smoothing)
            if not found.get(ROWS, 0):
                state.steps += 1
                continue
            for k in seen:
                seen[k] += found[k]
            step(state, found, settings)
        checked = sums(held, state.weights, weights, settings.smoothing, gradient=False)
        state.epoch += 1
        state.history.append({"rate": rate_at(settings, state.steps, state.rate), "loss": seen[LOSS] / seen[WEIGHT], "accuracy": seen[RIGHT] / seen[ROWS], "val_loss": checked[LOSS] / checked[WEIGHT], "val_accuracy": checked[RIGHT] / checked[ROWS]})
        _judge(state, settings)
        _save(spark, f"{path}/epoch-{state.epoch:04d}", state, settings)
        if watch:
            watch(state)
    return Trained(ids, state.best[:-1], float(state.best[-1]), state.best_epoch, state.history)


def first_step(df: DataFrame, settings: Settings, text: str = "text", label: str = "label") -> DataFrame:
    """token, gradient, weight: the mean gradient over all rows at zero weights, before it is cut, and what one step makes
    of it. A row for every token of the vocabulary, and one without token for the bias."""
    spark = df.sparkSession
    words = df.where(F.col(label).isNotNull()).withColumn(text, normalised(F.col(text)))
    ids = {r["token"]: r["id"] - 2 for r in vocabulary(words, settings.features + 2, text).collect()}
    weights = {float(r[label]): r["weight"] for r in class_weights(df, label).collect()} if settings.balanced else {}
    none = np.zeros(len(ids) + 1)
    state = State(none, none.copy(), none.copy(), none.copy(), rate=settings.rate)
    found = sums(examples(df, ids, settings, label, text, label), state.weights, weights, settings.smoothing)
    if not found.get(ROWS, 0):
        return spark.createDataFrame([], "token string, gradient double, weight double")
    step(state, found, settings)
    at = [*ids.values(), len(ids)]
    gradient = [float(found.get(i, 0.0)) / found[WEIGHT] for i in [*ids.values(), BIAS]]
    return spark.createDataFrame(pd.DataFrame({"token": [*ids, None], "gradient": gradient, "weight": state.weights[at]}), "token string, gradient double, weight double")


def _judge(state: State, settings: Settings) -> None:
    """Keeps the best state, ends the run, lowers the rate: by the validation rows of the epochs so far."""
    worth = [h["val_accuracy"] if settings.watch == "accuracy" else -h["val_loss"] for h in state.history]
    if len(worth) == 1 or worth[-1] > worth[state.best_epoch - 1]:
        state.best, state.best_epoch = state.weights.copy(), state.epoch
    elif state.epoch - state.best_epoch >= settings.patience:
        state.stopped = True
    if settings.schedule == "plateau":
        losses = [h["val_loss"] for h in state.history]
        state.stalled = 0 if len(losses) == 1 or losses[-1] < min(losses[:-1]) else state.stalled + 1
        if state.stalled > settings.plateau_patience:
            state.rate, state.stalled = max(state.rate * settings.factor, settings.least_rate), 0


def predict(df: DataFrame, trained: Trained, text: str = "text") -> DataFrame:
    """df with probability of the positive class and guess; a null text is one without tokens."""
    weights, bias = trained.weights, trained.bias

    @F.pandas_udf("double")
    def chance(ids: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + math.exp(-min(700.0, max(-700.0, bias + float(weights[i] @ n))))) for i, n in zip(ids, counts, strict=True)], dtype=float)

    found = df.withColumn("_x", counted_ids(tokens(normalised(F.col(text))), trained.ids))
    return found.withColumn("probability", chance(F.col("_x.ids"), F.col("_x.counts"))).withColumn("guess", (F.col("probability") >= 0.5).cast("int")).drop("_x")
