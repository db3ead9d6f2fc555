"""BPE over distinct words against the tokenizer run on whole texts."""

from __future__ import annotations

import hashlib
import json
import random
import struct

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairn.llm import bpe
from cairn.llm.queries import BPE

SCHEMA = "doc_id long, text string, id string, ids int, n int, word string, words int, h long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    bits = ["don't", "we'll  'S 's", "<|endoftext|>", " <|endoftext|> ", "<|endof", "\n\n", "   ", " ", "\t ", " ", " x", "\u0085", "\x1c", "\x00", "é", "Ünï", "漢字", "ひら", "१२", "x²", "Ⅻ", "a1b22", "!!??", "$ 5", "🙂🙂", "é", "ꟊ", "Ᲊ", "\U00010d40", "\U0001faf6", "�", "  a", "word", " word"]
    out = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b \n", "x" * 3000, " " * 5000, "  " * 50]
    out += ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(150)]
    return out + [" ".join(f"w{r.randint(0, 3000)}" + r.choice(("", ".", "  ", "\n")) for _ in range(4000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [*enumerate(texts), (3, texts[3]), (3, "other"), (None, "null id"), *((700 + n, texts[20]) for n in range(30))]
    return spark.createDataFrame([(i, t, "clash", 1, 1, "w", 1, 1) for i, t in rows], SCHEMA).repartition(3).cache()


TOKENIZER = Tokenizer.from_file(BPE)


def whole(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("limits", [{}, {"stretch": 40}, {"most_words": 30, "stretch": 40}, {"most_words": 0}])
def test_against_whole_texts(docs, limits):
    key = lambda r: (r[0] is not None, r[0], r[1:])
    want = {t: whole(t) for t in {r["text"] for r in docs.collect()}}
    rows = docs.select("doc_id", "text").collect()
    got = bpe.encode(docs, BPE, **limits).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(((r["doc_id"], want[r["text"]][0]) for r in rows), key=key)
    if "most_words" in limits:
        return
    hashed = bpe.digests(bpe.encode(docs, BPE, **limits), BPE).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digest = lambda ids, text: (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode()))
    assert sorted(map(tuple, hashed), key=key) == sorted(((r["doc_id"], *digest(*want[r["text"]])) for r in rows), key=key)


def test_decode(spark):
    rows = [(1, [50256, 40], "x"), (2, [], "x"), (3, None, "x"), (4, [188], "x"), (5, [10263], None), (5, [10263], None)]
    got = bpe.decode(spark.createDataFrame(rows, "a int, ids array<int>, text string"), BPE).collect()
    t = Tokenizer.from_file(BPE)
    assert sorted((r["a"], r["text"]) for r in got if r["ids"] is not None) == sorted((a, t.decode(i, skip_special_tokens=False)) for a, i, _ in rows if i is not None)
    assert [r["text"] for r in got if r["ids"] is None] == [None]


def test_words_of_one_hash_are_not_common():
    table = bpe.Common(pa.table({"h": [5, 7, 5, -1], "ids": [[1], [2, 3], [4], [9]]}))
    assert table.find(pa.array([7, 5, -1, 8])).tolist() == [1, -1, 0, -1]
    assert table.ids(table.find(pa.array([7, 5, -1])))[0].tolist() == [2, 3, 9]
    assert bpe.Common(pa.table({"h": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})).find(pa.array([1])).tolist() == [-1]


def test_words_are_encoded_once(spark, docs):
    words = spark.createDataFrame([("the",), ("the",), (" cat",)], "word string")
    got = bpe.word_table(words, BPE).collect()
    assert sorted((r["word"], r["n"], r["ids"]) for r in got) == [(" cat", 1, whole(" cat")[0]), ("the", 2, whole("the")[0])]


def test_edge_tables(spark, docs, tmp_path):
    none = docs.where("false")
    assert bpe.encode(none, BPE).count() == 0 and bpe.digests(bpe.encode(none, BPE), BPE).count() == 0
    file = json.load(open(BPE, encoding="utf-8")) | {"normalizer": {"type": "NFC"}}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.encode(docs, str(other))
