"""Shapley values of tokens against their definition."""

from __future__ import annotations

import itertools
import math
import sys

import pytest
from pyspark import cloudpickle

from cairn.operators import explain

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def crooked(texts):
    """A model in which three words work together."""
    out = []
    for t in texts:
        w = t.lower().split()
        out.append(0.1 + 0.3 * w.count("good") - 0.4 * w.count("bad") + 0.7 * ("not" in w and "bad" in w) + 0.05 * len(set(w)) ** 2)
    return out


def exact(text):
    """The mean over all orders."""
    found = explain.parts(text)
    total = [0.0] * len(found)
    for order in itertools.permutations(range(len(found))):
        there, before = set(), crooked([""])[0]
        for i in order:
            there.add(i)
            after = crooked(["".join(w for n, w in enumerate(found) if n in there)])[0]
            total[i] += after - before
            before = after
    return [x / math.factorial(len(found)) for x in total]


def told(spark, texts, load=lambda: crooked, **options):
    rows = spark.createDataFrame([(n % 3 or None, t, 9.0) for n, t in enumerate(texts)], "review_id int, text string, base double").repartition(2)
    return explain.shapley(rows, load, **options).collect()


def test_words_join_to_the_text():
    for t in ("a b", "  a, b! ", "...", "", "é-ü", "x"):
        found = explain.parts(t)
        assert "".join(found) == (t if any(c.isalnum() for c in t) else "")


def test_against_all_orders(spark):
    texts = ["good", "not bad", "Not bad, good film", "bad bad good not", "", None, " good\n"]
    got = told(spark, texts, pairs=300)
    assert len(got) == len(texts) and {r["review_id"] for r in got} == {None, 1, 2}
    for r in got:
        values = [x["value"] for x in r["token_values"]]
        assert sum(values) == pytest.approx(r["score"] - r["base"]) and r["base"] == crooked([""])[0] and not r["failed"]
        if values:
            assert values == pytest.approx(exact(r["text"]), abs=0.03), r["text"]
        else:
            assert not r["text"]


def test_pairs_are_exact_and_orders_seeded(spark):
    pair = lambda ts: [2.0 * t.count("a") + 3.0 * ("b" in t and "c" in t) - 1.0 * ("a" in t and "c" in t) for t in ts]
    one, two = (told(spark, ["a b c"], lambda: pair, pairs=n)[0] for n in (1, 5))
    assert [x["value"] for x in one["token_values"]] == pytest.approx([1.5, 1.5, 1.0]) == [x["value"] for x in two["token_values"]]
    again, other = told(spark, ["x not bad good b"], pairs=1), told(spark, ["x not bad good b"], pairs=1, seed=7)
    assert again == told(spark, ["x not bad good b"], pairs=1) and again[0]["token_values"] != other[0]["token_values"]


def test_long_texts_share_runs(spark):
    linear = lambda ts: [float(t.count("up") - t.count("down")) for t in ts]
    r = told(spark, ["up down x " * 700], lambda: linear, pairs=1, players=50)[0]
    assert len(r["token_values"]) == 2100 and sum(x["value"] for x in r["token_values"]) == pytest.approx(0.0)
    r = told(spark, ["up down x " * 7], lambda: linear, pairs=1)[0]
    assert [x["value"] for x in r["token_values"]] == [1.0, -1.0, 0.0] * 7


def test_top_tokens_failures_and_edges(spark):
    def moody(ts):
        if any("boom" in t for t in ts):
            raise RuntimeError
        return [0.123456 * t.count("good") - 0.5 * t.count("bad") for t in ts]

    rows = spark.createDataFrame([(1, "good bad x"), (1, "boom"), (2, None)], "review_id int, text string")
    got = {r["text"]: r for r in explain.top_tokens(rows, lambda: moody, 2).collect()}
    assert [tuple(x) for x in got["good bad x"]["top_tokens"]] == [("bad", -0.5), ("good", 0.1235)]
    assert got["boom"]["failed"] and got["boom"]["top_tokens"] is None and got[None]["top_tokens"] == []
    assert explain.shapley(rows.where("false"), lambda: moody).count() == 0
    assert explain.sampled(rows, lambda: moody, sample=2).count() == 2


def test_equal_texts_are_asked_once_by_many_tasks(spark):
    """One partition of rows with few distinct texts: the model sees each once, in more than one task."""
    asked, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        tasks.add(1)

        def model(texts):
            asked.add(len(texts))
            return [float(t.count("a")) for t in texts]

        return model

    rows = spark.range(400).selectExpr("id", "if(id % 41 = 40, null, concat('a b', id % 41)) as text", "'x' as failed").coalesce(1)
    found = explain.shapley(rows, load, pairs=1)
    assert found.selectExpr("id", "posexplode(token_values)").count() == 2 * sum(n % 41 < 40 for n in range(400)) and asked.value == 40 * 4 + 2
    got = found.collect()
    assert len(got) == 400 and all([v["value"] for v in r["token_values"]] == ([] if r["text"] is None else [1.0, 0.0]) and r["failed"] is False for r in got)
    assert asked.value == 2 * (40 * 4 + 2) and tasks.value > 2
