"""The training loop: resumption, schedules, best state, and a step against numbers by hand."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest

from cairn.operators import minibatch
from cairn.operators.minibatch import Settings, State

SCHEMA = "review_id int, text string, label int, ids int, batch string"


@pytest.fixture(scope="module")
def rows(spark):
    words = [f"{'good fine' if n % 3 else 'bad poor'} thing {n % 7} the the" for n in range(90)]
    own = [(n if n % 11 else None, w, int(n % 3 > 0), 1, "b") for n, w in enumerate(words)] + [(200, None, 1, 1, "b"), (201, "good", None, 1, "b"), (202, "", 0, 1, "b"), (3, "good fine", 1, 1, "b")]
    return spark.createDataFrame(own, SCHEMA).repartition(3).cache()


def same(a, b):
    return a.ids == b.ids and np.allclose(a.weights, b.weights, atol=1e-9) and a.bias == pytest.approx(b.bias, abs=1e-9) and a.best_epoch == b.best_epoch and len(a.history) == len(b.history) and all(x == pytest.approx(y) for x, y in zip(a.history, b.history, strict=True))


def test_resumed_run_is_the_straight_one(spark, rows, tmp_path):
    settings = Settings(epochs=4, batches=3, patience=9, watch="loss", rate=0.2)
    whole = minibatch.fit(rows, rows, str(tmp_path / "a"), settings)

    def stop(state):
        if state.epoch == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        minibatch.fit(rows, rows, str(tmp_path / "b"), settings, watch=stop)
    assert same(minibatch.fit(rows, rows, str(tmp_path / "b"), settings), whole)
    again = []
    assert same(minibatch.fit(rows, rows, str(tmp_path / "b"), settings, watch=again.append), whole) and again == []  # nothing is left to do
    with pytest.raises(ValueError, match="other settings"):
        minibatch.fit(rows, rows, str(tmp_path / "b"), dataclasses.replace(settings, rate=0.1))
    assert whole.history[-1]["val_loss"] < whole.history[0]["val_loss"] and whole.history[-1]["val_accuracy"] > 0.9
    scored = {r["text"]: r for r in minibatch.predict(rows, whole).collect()}
    assert scored["good fine"]["guess"] == 1 and scored["bad poor thing 0 the the"]["guess"] == 0 and scored[None]["probability"] == pytest.approx(1 / (1 + np.exp(-whole.bias)))
    assert minibatch.predict(rows.where("false"), whole).count() == 0


def test_a_step_by_hand(spark):
    """Two rows, unweighted: gradient, cut, and first step of Adam as written out here."""
    df = spark.createDataFrame([("a a b", 1), ("b c", 0)], "text string, label int")
    settings = Settings(epochs=1, batches=1, warmup=0.0, balanced=False, clip=0.5, rate=0.1, decay=0.01)
    got = {r["token"]: (r["gradient"], r["weight"]) for r in minibatch.first_step(df, settings).collect()}
    g = {"a": -0.5, "b": 0.0, "c": 0.25, None: 0.0}
    cut = 0.5 / (np.sqrt(0.3125) + 1e-6)
    for token, x in g.items():
        assert got[token] == pytest.approx((x, -0.1 * x * cut / (abs(x * cut) + 1e-8)))
    assert minibatch.first_step(df.where("false"), settings).count() == 0


def test_rates():
    line = Settings(epochs=2, batches=10, rate=1.0, warmup=0.1)
    assert [minibatch.rate_at(line, n, 9.0) for n in (0, 1, 2, 11, 20)] == pytest.approx([0.0, 0.5, 1.0, 0.5, 0.0])
    assert minibatch.rate_at(dataclasses.replace(line, schedule="plateau"), 5, 0.25) == 0.25


def judged(losses, settings, accuracies=None):
    none = np.zeros(1)
    state = State(none, none, none, none, rate=1.0)
    rates = []
    for n, x in enumerate(losses):
        state.epoch += 1
        state.weights = np.array([float(n)])
        state.history.append({"val_loss": x, "val_accuracy": (accuracies or losses)[n]})
        minibatch._judge(state, settings)
        rates.append(state.rate)
    return state, rates


def test_best_state_stopping_and_plateaus():
    state, rates = judged([5, 4, 4.5, 4.4, 4.3, 3], Settings(watch="loss", schedule="plateau", patience=9, plateau_patience=1))
    assert state.best_epoch == 6 and state.best[0] == 5 and rates == [1, 1, 1, 0.5, 0.5, 0.5]
    state, _ = judged([1, 1, 1], Settings(watch="accuracy", patience=2), [0.5, 0.6, 0.6])
    assert state.best_epoch == 2 and not state.stopped
    state, _ = judged([1, 1, 1, 1], Settings(watch="accuracy", patience=2), [0.5, 0.6, 0.6, 0.6])
    assert state.stopped and state.best[0] == 1


def test_empty_sides(rows, tmp_path):
    with pytest.raises(ValueError, match="labels"):
        minibatch.fit(rows, rows.where("label is null"), str(tmp_path / "x"), Settings(epochs=1))
