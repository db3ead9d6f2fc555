"""The stages of the pipeline, each against its operator's brute force on a small folder."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    stock = {"en": "the and of that with this from have".split(), "de": "der die und nicht sich über auch ein".split()}
    text = lambda c, n: " ".join(r.choice(stock[c]) + str(r.randint(0, 99)) for _ in range(n))
    rows = [(n, text(c, 60), c, f"s{n % 3}") for n, c in enumerate(["en", "de"] * 40)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[2][1] + " more", "en", "s1"), (102, "%%% 12 ###", "en", "s1"), (103, None, "en", "s1"), (104, text("en", 30) + " mail a.12@x.example.com", "en", "s2"), (105, "alpha beta gamma delta", "en", "s2")]
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, c, s, len(t or "")) for i, t, c, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma delta")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {102, 103} & set(kept["language_id"]) == set() and len(kept["language_id"]) == 84
    assert {100, 101} & set(kept["ngram_jaccard"]) == set() and len(kept["ngram_jaccard"]) == 82
    assert set(kept["ngram_jaccard"]) - set(kept["decontamination"]) == {105}
    assert "a.12@x" not in kept["pii"][104] and kept["pii"][0] == kept["decontamination"][0]
    out = pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(kept["pii"])
    assert out.where("not round_trip").count() == 0
