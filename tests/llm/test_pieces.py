"""Segmentation lattices that are kept from slice to slice, over units smaller than words."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import pieces
from cairn.llm.queries import MODEL


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(MODEL, 0.5)


def some_texts(seed, n=40):
    r = random.Random(seed)
    parts = ["a", "the", " ", "  ", "é", "日", "☃", "\n", ".", ",", "\t", "x1", "ing", "🙂", "(", ").\n", " cat", "\x00"]
    return pa.array(["".join(r.choice(parts) for _ in range(r.choice([1, 5, 50, 400]))) for _ in range(n)] + ["", None, "aaaa" * 100])


def drawn(texts, vocab, lattices=None):
    return [np.asarray(x, float) for x in pieces.encode_batch(texts, pieces.mix(np.arange(len(texts), dtype=np.uint64)), vocab, 3, lattices)]


def test_kept_lattices_draw_what_new_ones_draw(vocab):
    kept = pieces.Lattices(vocab)
    for seed in (1, 2, 3, 1):
        got, want = drawn(some_texts(seed), vocab, kept), drawn(some_texts(seed), vocab)
        assert all(np.array_equal(a, b) for a, b in zip(got[:4], want[:4], strict=True)) and got[6].all()
        assert all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(got[4:6], want[4:6], strict=True))


def test_units_are_laid_out_once(vocab):
    kept = pieces.Lattices(vocab)
    drawn(pa.array(["the cat sat.\nThe cat", "a cat"]), vocab, kept)
    size = len(kept.text)
    drawn(pa.array(["a cat sat", "the cat.\nThe cat sat."] * 50), vocab, kept)
    assert len(kept.text) == size
    drawn(pa.array(["another"]), vocab, kept)
    assert len(kept.text) > size


@pytest.mark.parametrize("long", [4, 256])
def test_units_draw_what_words_draw(vocab, monkeypatch, long):
    """Cut or not: the same pieces, numbers and scores, whatever unit a sibling lies in."""
    monkeypatch.setattr(pieces, "LONG", long)
    cut = drawn(some_texts(4, 150), vocab)
    monkeypatch.setattr(pieces, "units_of", lambda data, start, vocab: start)
    whole = drawn(some_texts(4, 150), vocab)
    assert all(np.array_equal(a, b) for a, b in zip(cut[:4], whole[:4], strict=True))
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-9) for a, b in zip(cut[4:6], whole[4:6], strict=True))


def test_no_piece_crosses_a_unit(vocab):
    text = (" " + " ".join(x for x in some_texts(5).to_pylist() if x)).encode()
    data, known = np.frombuffer(text, np.uint8), {b for b in vocab.bytes if len(b) > 1}
    units = pieces.units_of(data, np.array([0]), vocab)
    longest = max(map(len, known))
    for at in units.tolist()[1:]:
        assert text[at] & 0xC0 != 0x80
        assert not any(text[s:e] in known for s in range(max(at - longest, 0), at) for e in range(at + 1, min(s + longest, len(text)) + 1))
    assert len(units) > text.count(b".")


def test_broken_characters_at_the_end(vocab):
    """A text whose last character lacks bytes, behind a long run without spaces."""
    raw = pa.array([b"q" * 80 + b"\xe2", b"\xff the\xc3"], pa.binary())
    *_, whole = drawn(pa.Array.from_buffers(pa.string(), 2, raw.buffers()), vocab)
    assert whole.all()


def test_tables_grow(vocab):
    table, keys = pieces.Table(4), pieces.mix(np.arange(1, 5001, dtype=np.uint64))
    for s in range(0, 4000, 500):
        table.add(keys[s : s + 500], np.arange(s, s + 500))
    assert table.find(keys).tolist() == list(range(4000)) + [-2] * 1000
