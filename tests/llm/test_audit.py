"""The filter audit against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import audit
from cairn.llm.common import text_bytes

SCHEMA = "doc_id long, text string, lang string, id long, part string, n int, key string"
LABELS = "doc_id long, quality int, toxic int, id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text, i, smallest):
    w = WORD.findall(text)
    tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and smallest is not None and i > smallest)
    return {f for f, bad in zip("ABCDE", tests, strict=True) if bad}


def expected(rows, labels):
    """All rows of the report, filter by filter over every document."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, *flags in labels if flags[k] == 1} - {None} for k in (0, 1))
    out = {}
    for part in {p for *_, p in rows}:
        docs = [(i, failed(t, i, least.get(t))) for i, t, p in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone, after = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(after), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
                left = after
        for key, x in out.items():
            if key[0] == part:
                x[-1] = shapley[x[-1]]
    return {k: tuple(x) for k, x in out.items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    texts = [None, "", " \t\n", " ", "One TWO #3", "word " * 150, " ".join(f"w{n}" for n in range(100)), " ".join(f"w{n}" for n in range(99)), "É" * 5 + "A", "A" + "é" * 9, "A" + "é" * 8, "x" * 700 + " " + "x" * 699 + "y " + "x" * 700]
    texts += [" ".join(r.choice("ab") * r.randint(1, 40) for _ in range(r.randint(80, 160))) for _ in range(10)] + [" ".join(f"t{n % 40000}" for n in range(600000))]
    out = [(n, t, r.choice(("en", "de", None, ""))) for n, t in enumerate(texts)]
    return out + [(n + 100, r.choice(texts[:-1]), r.choice(("en", "de", None))) for n in range(60)] + [(3, " ", "en"), (None, "One TWO #3", "en"), (None, None, None), (5, "word " * 150, "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, 7, "clash", 1, "k") for i, t, p in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark, rows):
    labels = [(n, n % 3 - 1 if n % 5 else None, n % 2) for n in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = audit.audit(frame(spark, rows), spark.createDataFrame([(*x, 1) for x in labels], LABELS)).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got} == expected(rows, labels) and len(got) == 600 * 4


def test_distinct_words_of_equal_hashes(monkeypatch, rows):
    texts = [t for _, t, _ in rows if t is not None and len(t) < 10000]
    data, offsets = text_bytes(pa.array(texts))
    start, end = audit.word_bounds(data, offsets)
    want = [len(set(WORD.findall(t))) for t in texts]
    assert audit.distinct_words(data, offsets, start, end).tolist() == want
    monkeypatch.setattr(audit, "hashed", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    assert audit.distinct_words(data, offsets, start, end).tolist() == want


def test_stretches_join(monkeypatch):
    texts = ["ab cd ab", "", "ab " * 50, "cd"]
    data, offsets = text_bytes(pa.array(texts))
    start, end = audit.word_bounds(data, offsets)
    whole, flags = audit.hashed(data, start, end), data == 97
    monkeypatch.setattr(audit, "SLICE", 5)
    assert (audit.hashed(data, start, end) == whole).all() and len(set(whole)) == 2
    assert audit.counted(flags, offsets).tolist() == [t.count("a") for t in texts]


def test_edge_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    got = {tuple(r)[:3]: r for r in audit.audit(frame(spark, [(1, "a", "en")] * 20 + [(2, "a", "en")] * 3), labels).collect()}
    assert got["en", "EABCD", 1]["removed"] == 3 and got["en", "AEBCD", 2]["redundant"] == 3 and got["en", "ABCDE", 5]["kept"] == 0
