"""Hand-labelled pages of layouts that the training templates do not write, the choice on small trees, and a page of megabytes."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from cairn.llm import extract
from cairn.llm.dom import parse

A, B, C = "Rivers carry water to the sea, and much else besides.", "They also move sand, slowly, from the hills to the shore.", "Nobody has counted the grains, though some have tried."
NAV = "<a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a>"
#: (name, page, blocks of its article)
PAGES = [
    ("article among links", f"<nav>{NAV}</nav><main><h1>A study of rivers</h1><p>See <a href=a>the first long study</a>, <a href=b>the second study</a> and <a href=c>the third one</a>.</p><p>{A}</p></main><footer>(c) 2020 Acme</footer>", ["A study of rivers", "See the first long study, the second study and the third one.", A]),
    ("comments without names", f"<article><h1>Rivers</h1><p>{A}</p><p>{B}</p></article><h3>2 comments</h3><ol><li>I liked this very much, thank you.</li><li>So did I.</li></ol>", ["Rivers", A, B]),
    ("table layout", f"<table><tr><td colspan=2>Acme News</td></tr><tr><td>{NAV}</td><td><h1>Rivers</h1><p>{A}</p><p>{B}</p></td></tr><tr><td colspan=2>(c) 2020 Acme</td></tr></table>", ["Rivers", A, B]),
    ("bare body", f"<h1>Rivers</h1><p>{A}</p><p>{B}</p><p>{C}</p>", ["Rivers", A, B, C]),
    ("neutral names", f"<div class=x1><div class=x2>{NAV}</div><div class=x3><h1>Rivers</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div>", ["Rivers", A, B, C]),
    ("roles", f"<div role=navigation>{NAV}</div><div role=main><h2>Rivers</h2><p>{A}</p><p>{B}</p></div><div role=complementary><h3>More</h3><ul><li><a href=1>Lakes</a><li><a href=2>Seas</a></ul></div><div role=contentinfo>Imprint</div>", ["Rivers", A, B]),
    ("cookie notice", f"<div class=cookie-bar>We use cookies. <button>Accept</button></div><article><h1>Rivers</h1><p>{A}</p><p>{C}</p></article>", ["Rivers", A, C]),
    ("box inside the article", f"<article><h1>Rivers</h1><p>{A}</p><aside class=related><h4>Related</h4><ul><li><a href=1>Lakes</a></li></ul></aside><p>{B}</p></article>", ["Rivers", A, B]),
    ("code and quotation", f"<header><a href=/>Acme</a></header><main><h1>Loops</h1><p>{A}</p><pre>for i in x:\n  go(i)</pre><blockquote>{B}</blockquote><p>{C}</p></main><footer>&copy; Acme</footer>", ["Loops", A, "for i in x: go(i)", B, C]),
    ("single block", "<nav>" + NAV + f"</nav><article><p>{A} {B} {C}</p></article><footer>All rights reserved</footer>", [f"{A} {B} {C}"]),
    ("search form and scripts", f"<form action=/q><input name=q><button>Search</button></form><script>var a = '<p>no</p>';</script><style>p {{}}</style><article><h1>Rivers</h1><p>{A}</p><p>{B}</p></article>", ["Rivers", A, B]),
    ("other language", "<nav><a href=1>首页</a> <a href=2>新闻</a></nav><article><h1>河流</h1><p>河流把水带到大海，还有许多别的东西。</p><p>它们也慢慢地搬运沙子。</p></article><footer>© 2020</footer>", ["河流", "河流把水带到大海，还有许多别的东西。", "它们也慢慢地搬运沙子。"]),
]


@pytest.fixture(scope="module")
def trees():
    return extract.model()


@pytest.mark.parametrize("name", [n for n, *_ in PAGES])
def test_foreign_layouts(trees, name):
    _, body, blocks = next(p for p in PAGES if p[0] == name)
    assert extract.main_text([f"<html><head><title>t</title></head><body>{body}</body></html>"], trees) == ["\n\n".join(blocks)]


def test_best_choice_on_small_trees():
    """Every labelling of small trees in which nothing is kept under a dropped node, tried out."""
    r = random.Random(1)
    for _ in range(60):
        page = "<body>" + "".join(r.choice(("<div>", "</div>", "a ", "<p>", "</p>", "b c ")) for _ in range(r.randint(2, 9)))
        flat = extract.Flat(parse(page)[0])
        n = len(flat.parent)
        if n > 11:
            continue
        margin = np.array([r.uniform(-3, 3) for _ in range(n)])
        gain = [-float(np.logaddexp(0, -m)) for m in margin], [-float(np.logaddexp(0, m)) for m in margin]
        best = max(
            (sum(gain[0][k] if keep[k] else gain[1][k] for k in range(1, n)), [t for k, t in enumerate(flat.text) if t and keep[k]])
            for rest in itertools.product((True, False), repeat=n - 1) for keep in [(True, *rest)] if all(keep[flat.parent[k]] or not keep[k] for k in range(1, n))
        )
        assert flat.kept(margin) == best[1]


def test_a_page_of_megabytes(spark, trees):
    page = f"<html><body><nav>{NAV}</nav><article><h1>Rivers</h1>" + f"<p>{A}</p><p>{B}</p>" * 20_000 + "</article><footer>(c) 2020</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "\n\n".join(["Rivers", *[A, B] * 20_000])
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(text)), (1, len(text)), (2, 0), (3, 0), (4, 0)]
    assert {r["text"] for r in got if r["page_id"] == 1} == {text}
