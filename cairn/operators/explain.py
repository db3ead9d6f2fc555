"""What each token of a text adds to a model's answer: Shapley values of whatever model answers.

A model is asked about the text without some of its tokens. Values are means over seeded orders in which tokens come
back one by one; each order is taken backwards as well, which makes the values exact for models whose tokens work alone
or in pairs, and their sum the answer to the text less the answer to nothing, for any model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import strongest
from .scoring import Model
from .sentiment import draw

#: Models may be asked about so many texts at once.
BATCH = 64
_PART = re.compile(r"\w+\W*")


def parts(text: str) -> list[str]:
    """The text's words, each with what follows it; what precedes the first belongs to it. Joined they are the text."""
    found = _PART.findall(text)
    if found:
        found[0] = text[: len(text) - sum(map(len, found))] + found[0]
    return found


def _runs(found: list[str], players: int) -> list[list[int]]:
    """At most `players` runs of neighbouring words, as even as can be."""
    return [list(x) for x in np.array_split(np.arange(len(found)), min(players, len(found)))] if found else []


def _asked(text: str, pairs: int, seed: int, players: int) -> tuple[list[str], list[list[int]], list[np.ndarray], list[str]]:
    """Words, their runs, the orders, and every text that has to be scored: nothing, all, then each order's heads."""
    found = parts(text)
    runs = _runs(found, players)
    r = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{text}".encode()).digest()[:8], "big"))
    orders = [o for _ in range(pairs if len(runs) > 1 else 0) for p in [r.permutation(len(runs))] for o in (p, p[::-1])]
    masked = ["", text]
    for order in orders:
        there = np.zeros(len(found), bool)
        for player in order[:-1]:
            there[runs[player]] = True
            masked.append("".join(w for w, yes in zip(found, there, strict=True) if yes))
    return found, runs, orders, masked


def _values(found: list[str], runs: list[list[int]], orders: list[np.ndarray], scores: list[float]) -> list[dict]:
    """(token, value) word by word; the words of a run share its value."""
    none, whole = scores[:2]
    got = np.zeros(len(runs))
    for n, order in enumerate(orders):
        size = len(order) - 1
        steps = np.array([none, *scores[2 + n * size : 2 + (n + 1) * size], whole])
        got[order] += np.diff(steps)
    got = got / len(orders) if orders else np.full(len(runs), whole - none)
    share = {i: v / len(run) for run, v in zip(runs, got.tolist(), strict=True) for i in run}
    return [{"token": re.search(r"\w+", w)[0], "value": share[i]} for i, w in enumerate(found)]


def shapley(df: DataFrame, load: Callable[[], Model], pairs: int = 4, seed: int = 42, players: int = 256, text: str = "text") -> DataFrame:
    """df with base (the answer to an empty text), score, failed, and token_values: array of (token, value) in the text's
    order, over `pairs` orders and their reversals.

    `load` makes the model once a worker. Rows get their result by their text, so keys may repeat or be null. Equal texts
    have equal values, and the model is asked about them once: distinct texts are dealt evenly to as many tasks as there
    are shuffle partitions or cores, however few files hold the rows, and joined back. A null text is an empty one: no tokens, score equal to base. A text of over `players` words is divided
    into that many runs of words, which share their run's value. A model that fails on a text leaves nulls there and
    failed true. An empty table gives no rows; columns of these names are replaced."""

    @F.pandas_udf("base double, score double, failed boolean, token_values array<struct<token:string,value:double>>")
    def told(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in series:
            out = []
            for t in texts:
                found, runs, orders, masked = _asked("" if t is None else t, pairs, seed, players)
                try:
                    scores = [float(x) for s in range(0, len(masked), BATCH) for x in model(masked[s : s + BATCH])]
                    out.append((scores[0], scores[1], False, _values(found, runs, orders, scores)))
                except Exception:  # noqa: BLE001 - reported row by row, as scorer() does
                    out.append((None, None, True, None))
            yield pd.DataFrame(out, columns=["base", "score", "failed", "token_values"])

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = df.select(F.col(text).cast("string").alias("_asked")).distinct().repartition(tasks)
    once = told.asNondeterministic()  # or a filter upon the values is asked below the dealing, of every row of a file
    answers = asked.withColumn("_told", once("_asked")).select("_asked", "_told.*")
    rows = df.drop(*answers.columns)
    return rows.join(answers, F.col(text).cast("string").eqNullSafe(F.col("_asked")), "left").drop("_asked")


def top_tokens(df: DataFrame, load: Callable[[], Model], k: int = 8, **options: int | str) -> DataFrame:
    """df with base, score, failed and top_tokens: the k (token, value) of largest absolute value, to four digits."""
    found = shapley(df, load, **options)
    top = F.transform(strongest(F.col("token_values"), k), lambda x: F.struct(x["token"].alias("token"), F.bround(x["value"], 4).alias("value")))
    return found.withColumn("top_tokens", top).drop("token_values")


def sampled(df: DataFrame, load: Callable[[], Model], sample: int = 8, seed: int = 42, k: int = 5, key: str = "review_id", text: str = "text", **options: int) -> DataFrame:
    """key, text, base, score, failed, top_tokens of `sample` rows, the first by the seeded draw of the key."""
    return top_tokens(df.select(key, text).orderBy(draw(F.col(key), seed), key, text).limit(sample), load, k, text=text, seed=seed, **options)
