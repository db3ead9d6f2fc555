"""Each corpus operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import html.parser
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, extract, jaccard, language, pieces, pii, resample, sharding, topk, warc
from cairn.llm.queries import MODEL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, unit int"


def words(text):
    return WORD.findall((text or "").translate(UP))


def prose(r, n):
    return " ".join(r.choice(("sun", "moon", "tree", "river", "stone", "bird", "wind", "lake", "hill", "road", "Été", "x9")) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [prose(r, n) for n in (30, 60, 60, 120, 8)]
    out = []
    for n, t in enumerate(base):
        w = t.split()
        out.append((10 * n, t))
        for v in range(4):
            near = list(w)
            near[r.randrange(len(w))] = f"edit{v}"
            out.append((10 * n + v + 1, " ".join(near)))
        out.append((10 * n + 7, t))
    out += [(90, None), (91, ""), (92, "!!! ---"), (93, "one two"), (94, "One, two."), (None, base[1]), (95, None), (96, "word " * 30000), (10, base[1]), (10, base[1])]
    return [(i, t, "en", None if i and i % 4 == 0 else "src0", None, 5, "clash", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_links(rows, n=5, threshold=0.8):
    grams = []
    for _, t, *_ in rows:
        w = words(t)
        grams.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    edges = defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] == rows[b][1] or (grams[a] and grams[b] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])):
            edges[a].add(b)
            edges[b].add(a)
    seen, out = {}, []
    for a in range(len(rows)):
        if a not in seen:
            todo, part = [a], set()
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += edges[x]
            low = min((rows[x][0] for x in part if rows[x][0] is not None), default=None)
            seen |= dict.fromkeys(part, low)
        out.append((rows[a][0], seen[a], len(edges[a])))
    return Counter(out)


def test_jaccard_join(docs, rows, nothing):
    assert Counter(map(tuple, jaccard.similar(docs).collect())) == brute_links(rows)
    assert jaccard.similar(nothing).count() == 0
    # units cut into chunks give the same
    assert Counter(map(tuple, jaccard.similar(docs, unit_docs=2, pack_pairs=3).collect())) == brute_links(rows)


def test_keep_one(docs, rows):
    classes = {(i, c) for i, c, _ in brute_links(rows)}
    kept = jaccard.keep_one(docs)
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(got) == sorted({c for _, c in classes})


def test_bayesian_pruning_keeps_what_is_likely():
    table = dict(jaccard.least_matches(16, 96, 0.8, 1e-4))
    assert table[16] < 0.8 * 16 and table[96] < 0.8 * 96 and all(m > 0 for m in table.values())
    for n, m in table.items():  # the posterior by numeric integration
        x = np.linspace(0, 1, 20001)[1:-1]
        tail = lambda k, n=n: (d := x**k * (1 - x) ** (n - k))[x >= 0.8].sum() / d.sum()
        assert tail(m) >= 0.9e-4 and (m == 0 or tail(m - 1) <= 1.1e-4)


def test_looks_share_the_tolerance(nothing, monkeypatch):
    used, real = [], jaccard.least_matches
    monkeypatch.setattr(jaccard, "least_matches", lambda *a: used.append(real(*a)) or used[-1])
    assert jaccard.similar(nothing).count() == 0
    alive, last, lost = {0: 1.0}, 0, 0.0  # a pair of similarity 0.8, by matches so far
    for n, fewest in used[0]:
        k, grown = n - last, Counter()
        for a, p in alive.items():
            for x in range(k + 1):
                grown[a + x] += p * math.comb(k, x) * 0.8**x * 0.2 ** (k - x)
        lost += sum(p for a, p in grown.items() if a < fewest)
        alive, last = {a: p for a, p in grown.items() if a >= fewest}, n
    assert 0 < lost < 1.3e-4


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 230), r.randint(200, 230)) for _ in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {x["node"]: x["root"] for x in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


ITEMS = [(1, "alpha beta gamma"), (2, " ".join(f"k{i}" for i in range(20))), (3, ""), (4, None), (5, "!!"), (6, " ".join(f"K{i}" for i in range(4, 20))), (77, "été Été x")]


def brute_contamination(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, nothing):
    texts = ["x ALPHA, beta-gamma y", "k0 " + " ".join(f"K{i}" for i in range(20)) + " z", " ".join(f"k{i}" for i in range(5, 18)) + " q" * 400, "alpha beta", None, "", "ÉTÉ Été x été Été X", "alpha beta gamma " * 50, "K0 k1"]
    table = [(n, t, None, None, None, 1, "a", 2) for n, t in enumerate(texts)] + [(0, texts[0], None, None, None, 1, "a", 2), (None, texts[0], None, None, None, 1, "a", 2)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(table, SCHEMA)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == Counter((i, *brute_contamination(t, ITEMS)) for i, t, *_ in table)
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [n for n, t in enumerate(texts) if not brute_contamination(t, ITEMS)[4]]


@pytest.mark.parametrize("tokens", [0, 10**6])
def test_decontamination_shuffled(spark, monkeypatch, tokens):
    """Beyond the broadcast limits, with every prefix word in several parts, and with a long text and nameless items."""
    for name, value in {"BROADCAST_ROWS": 0, "BROADCAST_TOKENS": tokens, "PART_WINDOWS": 2, "PART_PLACES": 3}.items():
        monkeypatch.setattr(decontaminate, name, value)
    texts = [f"k0 {' '.join(f'K{i}' for i in range(20))} z", "alpha beta gamma " * 9 + "alpha", "sun " * 40_000 + "Alpha.Beta.Gamma", "nameless thing", None, "\u212aelvin \u0130x \u00c9T\u00c9 \u00e9t\u00e9 x"]
    items = [*ITEMS, (9, "beta gamma alpha"), (10, "alpha"), (11, "k4 k5"), (12, "\u212aelvin"), (13, "kelvin")]
    table = [(n, t) for n, t in enumerate(texts)] + [(0, texts[0]), (1, texts[1])]
    want = Counter((i, *brute_contamination(t, items)) for i, t in table)
    got = decontaminate.contamination(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == want
    nameless = spark.createDataFrame([(None, "nameless thing"), (None, "alpha beta")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(table[3:4], "doc_id long, text string"), nameless).collect()}
    assert got[3]["n_items"] == 1 and got[3]["n_hit"] == 2 and got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_decontamination_is_native(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding(spark, nothing):
    r = random.Random(2)
    texts = [prose(r, r.randint(1, 60)) for _ in range(900)]
    table = [(n, t) for n, t in enumerate(texts)] + [(1000 + n, texts[n % 7]) for n in range(50)] + [(2000 + n, "hot text " * 9) for n in range(2000)] + [(5000, None), (5001, ""), (None, "é"), (5002, "same"), (5002, "same")]
    frame = spark.createDataFrame([(i, t, "", "", 0, 3, "x", 4) for i, t in table], SCHEMA).repartition(4)
    got = sharding.shard_by_bytes(frame, shards=5).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()) & 0xFFFFFFFF) for i, t in table)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    by = defaultdict(list)
    for x in got:
        by[x["shard"]].append(x)
    sizes = [sum(x["size"] for x in by[s]) for s in range(5)]
    assert set(by) == set(range(5)) and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 5
    for xs in by.values():
        assert sorted(x["slot"] for x in xs) == list(range(len(xs)))
    homes = defaultdict(set)
    for x in got:
        homes[x["text_crc32"]].add(x["shard"])
    assert len(homes[zlib.crc32(b"hot text " * 9)]) > 1 and sum(len(v) > 1 for v in homes.values()) <= 2
    assert sharding.shard_by_bytes(nothing).count() == 0
    assert {x["law"] for x in got} == {"bytes"} and {x["grown_shard"] for x in got} == {None}


def test_shards_with_long_texts_stay_equal(spark):
    """Rows of up to half a shard, copies of them among them; and one larger than any shard."""
    r = random.Random(12)
    table = [(n, "x" * int(50 * 300 ** r.random())) for n in range(500)] + [(600, "y" * 9000)] * 3 + [(601, "y" * 9000)]
    for extra in ([], [(700, "z" * 200_000)]):
        got = sharding.shard_by_bytes(spark.createDataFrame(table + extra, "doc_id long, text string"), shards=12).collect()
        assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len(t) + 8) for i, t in table + extra)
        by = defaultdict(list)
        for x in got:
            by[x["shard"]].append(x)
        sizes = sorted(sum(x["size"] for x in xs) for xs in by.values())
        sizes = sizes[:-1] if extra else sizes
        assert len(by) == 12 and sizes[-1] - sizes[0] < 0.02 * sizes[0]
        assert all(sorted(x["slot"] for x in xs) == list(range(len(xs))) for xs in by.values())
    assert sharding._filled([5, 0, 0], 4) == [0.0, 2.0, 2.0] and sharding._filled([1, 0], 3) == [1.0, 2.0]


def test_overfull_ranges_are_subdivided():
    sample = [(1, i, 1.0) for i in range(50)] + [(k, 0, 1.0) for k in range(2, 20)]
    got = sharding._splitters(sample, 10)
    assert got[0] == (1, sharding.LOWEST) and sum(k == 1 for k, _ in got) > 3


def test_slow_subdivision_loses_no_rows(spark, monkeypatch):
    real = sharding._splitters
    monkeypatch.setattr(sharding, "_splitters", lambda sample, ranges: (got := real(sample, ranges))[len(got) // 2 : len(got) // 2 + 1])
    frame = spark.createDataFrame([(n, f"text {n * n} {'x' * (n % 50)}") for n in range(600)], "doc_id long, text string")
    got = sharding.shard_by_bytes(frame, shards=5).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(600))
    sizes = Counter()
    for x in got:
        sizes[x["shard"]] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 5


@pytest.mark.parametrize("scale", [1.0, 3e4, 3e6])
def test_topk(spark, scale):
    """Against all pairs: sums exact in single precision, in double precision, and in neither."""
    r = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(scale * x)) for x in v]) for i, v in enumerate(r.normal(size=(300, 12)))]
    vectors += [(400 + i, [0.5] * 12) for i in range(30)] + [(500, None), (520, [float("nan")] + [0.0] * 11), (540, [None] + [0.0] * 11), (None, [1.0] * 12), (20, vectors[20][1]), (560, [0.0] * 12), (580, [1.0, 2.0]), (600, []), (601, []), (20, [1.0] * 12)]
    vectors += [(40, vectors[40][1])] * 30 + [(700, [-0.5] * 12)] * 3
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, block int, own int").repartition(3)
    got = defaultdict(list)
    for x in topk.search(frame, query_rows=8, group_rows=100).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = defaultdict(list)
    for q, v in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        at = good.index((q, list(v)))
        rest = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for n, (i, w) in enumerate(good) if n != at and len(v) == len(w)]
        want[q] += [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(rest)[:20])]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_bounds_hold():
    """At every depth the bounds enclose the scores, and a query that stops early loses nothing."""
    r = np.random.default_rng(5)
    lists = topk.Lists(r.integers(-64, 64, (500, 16)))
    queries = r.integers(-64, 64, (40, 16))
    weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], 1).astype(float)
    scores = queries @ lists.vectors.T
    for at in range(len(lists.depths)):
        excess, met = lists.read(at)
        upper = weights @ excess + (weights @ lists.front)[:, at : at + 1]
        gaps = weights * (lists.front[:, at] - lists.worst[:, 0])
        lower = upper - gaps.sum(1, keepdims=True) + gaps @ met
        assert (upper >= scores - 1e-6).all() and (lower <= scores + 1e-6).all()
    for floors in (np.full(40, -np.inf), np.sort(scores, 1)[:, -5].astype(float)):
        q, v, s = lists.search(queries, floors, 5)
        assert (s == scores[q, v]).all()
        for i in range(40):
            assert sorted(s[q == i], reverse=True)[:5] == sorted(scores[i], reverse=True)[:5]


def test_pseudonyms_are_permutations():
    key = b"k"
    for size in (2, 10, 97, 1000):
        p = pii.Permutation(key, "t", size)
        assert sorted(map(p, range(size))) == list(range(size)) and all(p(x) != x and p.inverse(p(x)) == x for x in range(size))
    assert pii.Permutation(key, "t", 1)(0) == 0


def test_pseudonyms_keep_formats():
    key, swap = b"k", lambda t: pii.pseudonymise(t, b"k")[0]
    assert pii.luhn("4111111111111111") == 0
    for text, form in (
        ("4111 1111 1111 1111", r"\d{4}( \d{4}){3}"),
        ("+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("10.20.30.40", r"\d+(\.\d+){3}"),
        ("123-45-6789", r"\d{3}-\d{2}-\d{4}"),
        ("a.12@mail.example.com", r"[a-z]\.\d\d@mail\.example\.com"),
        ("2024-02-29", r"\d{4}-\d{2}-\d{2}"),
        ("31.12.1999", r"\d{2}\.\d{2}\.\d{4}"),
        ("DE89370400440532013000", r"DE\d{20}"),
        ('token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', r'token = "[0-9a-f]{40}"'),
    ):
        new = swap(text)
        assert new != text and re.fullmatch(form, new), (text, new)
        assert swap(f"see {text} and {text}") == f"see {new} and {new}"
    assert pii.luhn(re.sub(r"\D", "", swap("4111 1111 1111 1111"))) == 0
    assert pii.iban(key, swap("DE89370400440532013000")) is not None
    for text in ("version 3.0", "chapter 12", "CC BY-NC 4.0", "2024-13-45", "999.1.1.1", "000-12-3456", "DE00123456789012345678", "1234567"):
        assert swap(text) == text


def test_pseudonyms_behind_failed_matches():
    swap = lambda t: pii.pseudonymise(t, b"k")[0]
    card, account = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    assert pii.iban(b"k", account) is not None
    for text in (f"{account} EUR", f"{account} 12", account):
        assert swap(text) == swap(account) + text[len(account) :] and swap(account) != account
    assert swap(f"AB12 CARD {card}") == f"AB12 CARD {swap(card)}"
    assert swap("+44 2012 3456 7890 1234 5678") != "+44 2012 3456 7890 1234 5678"
    assert swap("DE89 3704 0044 0532 0130 00, GB29 NWBK 6016 1331 9268 19 X") == f"{swap('DE89 3704 0044 0532 0130 00')}, {swap('GB29 NWBK 6016 1331 9268 19')} X"


def test_pseudonyms_of_timestamps_and_month_names():
    swap = lambda t: pii.pseudonymise(t, b"k")[0]
    assert swap("2001-02-03T10:00:00Z") == swap("2001-02-03") + "T10:00:00Z" and swap("2001-02-03") != "2001-02-03"
    day = pii.datetime.date.fromisoformat(swap("2001-02-03"))
    long, short = pii.MONTHS[day.month - 1], pii.MONTHS[day.month - 1][:3]
    for text, want in (
        ("3 February 2001", f"{day.day} {long} {day.year}"),
        ("03-Feb-2001", f"{day.day:02d}-{short} {day.year}".replace(" ", "-")),
        ("FEBRUARY 3, 2001", f"{long.upper()} {day.day}, {day.year}"),
        ("born Feb. 3, 2001.", f"born {short}. {day.day}, {day.year}."),
        ("2001 February 03", f"{day.year} {long} {day.day:02d}"),
    ):
        assert swap(text) == want
    assert re.fullmatch(r"the \d+(st|nd|rd|th) of [A-Z][a-z]+ \d{4}", swap("the 3rd of February 2001")) and "February 2001" not in swap("the 3rd of February 2001")
    for text in ("31 February 2001", "May 2001", "3 Marching 2001", "2001-13-03T10:00:00Z", "3 may 12"):
        assert swap(text) == text


def test_every_day_keeps_its_own_pseudonym():
    """All days of 1900 to 2099 in every format: within one, no two days meet, and a form of one reading never becomes one of another."""
    days = [pii.datetime.date.fromordinal(d) for d in range(pii.FIRST_DAY, pii.LAST_DAY + 1)]
    slashed = {}
    for form in ("{0.year:04d}-{0.month:02d}-{0.day:02d}", "{0.day:02d}.{0.month:02d}.{0.year}", "{0.day}.{0.month}.{0.year}", "{0.day:02d} {0:%B} {0.year}", "{0.month:02d}/{0.day:02d}/{0.year}", "{0.day:02d}/{0.month:02d}/{0.year}"):
        for d in days:
            text = form.format(d)
            if "/" in form:
                slashed[text] = pii.date(b"k", text)
        if "/" not in form:
            assert len({pii.date(b"k", form.format(d)) for d in days}) == len(days)
    assert len(set(slashed.values())) == len(slashed) and None not in slashed.values() and all(a != b for a, b in slashed.items())
    assert pii.date(b"k", "24.04.1905").split(".") == pii.date(b"k", "24/04/1905").split("/")


def test_pseudonyms_of_symbols_and_digit_runs():
    locals_ = ["".join(x) for n in (1, 2, 3) for x in itertools.product(pii.SYMBOLS, repeat=n)]
    moved = {x: pii.email(b"k", x + "@a.org") for x in locals_}
    assert len(set(moved.values())) == len(moved) and all(len(v) == len(x) + 6 and v != x + "@a.org" for x, v in moved.items())
    swap = lambda t, **o: pii.pseudonymise(t, b"k", **o)[0]
    for text in ("1700000000001", "at 9783161484101 x", "4111 1111 1111 1112"):
        assert swap(text) == text and swap(text, unchecked=True) != text
    for text in ("ref XY99 4111 1111 1111 1111", "AB12 4111 1111 1111 1111 1111"):
        assert "4111 1111 1111 1111" not in swap(text)


def test_pseudonyms_of_long_text(spark):
    text = "x" * 300_000 + " mail a.9@b.example.org " + "1 " * 200_000
    assert "a.9@b" not in pii.pseudonyms(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["text"]


def test_pseudonyms_frame(docs, rows, nothing, spark):
    got = pii.pseudonyms(docs, "k")
    assert got.columns == [*docs.columns, "pii"] and Counter(r["text"] for r in got.collect()) == Counter(t for _, t, *_ in rows)
    assert pii.pseudonyms(nothing, "k").count() == 0
    text = "mail x.9@a.example.org\nno\n" + "y " * 9 + "10.0.0.1"
    r = pii.pseudonyms(spark.createDataFrame([(1, text, "old"), (2, None, "")], "doc_id long, text string, pii string"), "k").orderBy("doc_id").collect()
    for s in r[0]["pii"]:
        part = r[0]["text"][s["start"] : s["start"] + s["length"]]
        assert re.fullmatch({"email": r"\w\.\d@a\.example\.org", "ipv4": r"\d+(\.\d+){3}"}[s["kind"]], part)
    assert len(r[0]["pii"]) == 2 and r[1]["text"] is None and r[1]["pii"] == []


def test_language(spark, nothing):
    r = random.Random(5)
    stock = {"en": "the and of that with this".split(), "de": "der die und nicht sich über".split(), "fr": "le la les une des été".split()}
    table = [(n, " ".join(r.choice(stock[c]) for _ in range(40)), c, f"h{n % 2}") for n, c in enumerate(r.choice(("en", "de", "fr")) for _ in range(240))]
    wrong = [(900 + n, " ".join(r.choice(stock["de"]) for _ in range(60)), "en", "h0") for n in range(5)]
    odd = [(950, None, "en", "h0"), (951, "", "en", None), (952, "%%% 123 !!", None, None), (953, "zq xj qz jx vq zj xq " * 20, None, "h1"), (954, "und", None, None), (0, table[0][1], table[0][2], "h0")]
    frame = spark.createDataFrame([(*x, 1, "z", 5.0) for x in table + wrong + odd], "doc_id long, text string, lang string, source string, h int, id string, posterior double")
    found = language.identify(frame).collect()
    assert len(found) == len(table + wrong + odd)
    got = {x["doc_id"]: x for x in found}
    right = sum(got[n]["lang"] == c and got[n]["accepted"] for n, _, c, _ in table)
    assert right == len(table) and all(got[n]["lang"] == "de" for n, *_ in wrong)
    assert not got[950]["accepted"] and not got[951]["accepted"] and not got[952]["accepted"] and not got[953]["accepted"] and got[954]["lang"] == "de"
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(found) - 4
    assert language.identify(nothing).count() == 0


def test_every_declared_language_is_a_class(spark):
    r = random.Random(8)
    codes = sorted(language.REGISTERED)[:35]  # each with words of its own
    stock = {c: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for c in codes}
    rows = [(100 * k + n, " ".join(r.choice(stock[c]) for _ in range(30)), c) for k, c in enumerate(codes) for n in range(12 if k < 32 else 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.identify(frame, host_col=None).collect()}
    assert all(got[i]["lang"] == c and got[i]["accepted"] for i, _, c in rows)


def test_unregistered_codes_say_nothing(spark):
    """Made-up codes are no classes: documents under them are told by their texts, as those that declare nothing."""
    words = {"en": "the and of that with this", "de": "der die und nicht sich über"}
    rows = [(n, f"{words[c]} " * 5, c) for n, c in enumerate(["en", "de"] * 30)]
    made = ["q" + a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows += [(1000 + n, f"{words[c]} {n} " * 5, made[n % 100] if n % 3 else None) for n, c in enumerate(["en", "de"] * 60)]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), host_col=None).collect()}
    for n, c in enumerate(["en", "de"] * 60):
        assert got[1000 + n]["lang"] == got[1000 + n]["text_lang"] == c and got[1000 + n]["accepted"]
        assert got[1000 + n]["declared"] == (made[n % 100] if n % 3 else None)
    named = language.sample_labelled(spark.createDataFrame([(t, c) for _, t, c in rows], "t string, l string"), F.col("t"), F.col("l"), 300, 1)
    assert {r[0] for r in named.select("l").distinct().collect()} == {"de", "en"}


def test_language_sample_is_bound_by_label(spark):
    rows = [("copied a lot", "en")] * 400 + [(f"english {n}", "en") for n in range(40)] + [(f"deutsch {n}", "de") for n in range(9)] + [(None, "fr"), ("", "fr"), ("none", None)]
    frame = spark.createDataFrame(rows, "t string, l string")
    for seed in range(3):
        got = [tuple(r) for r in language.sample_labelled(frame, F.col("t"), F.col("l"), 20, seed=seed).collect()]
        assert len(set(got)) == len(got) and Counter(x for _, x in got) == {"en": 20, "de": 9}


def test_language_evidence(spark):
    pages = spark.createDataFrame([("http://a.example.de/x", "<html lang='de'>"), ("https://b.example.com/fr/1", "<HTML class=x LANG=\"EN-us\">"), ("ftp", "<p>"), (None, None)], "u string, h string")
    got = pages.select(language.suffix_language(F.col("u")), language.markup_language(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("de", "de"), ("fr", "en"), (None, None), (None, None)]


def test_language_codes_are_whole(spark):
    words = {"fil": "ang mga sa ng ay na", "fi": "ja on se että ei oli"}
    rows = [(n, f"{words[c]} " * 5, tag) for n, (c, tag) in enumerate([("fil", "fil"), ("fi", "fi-FI"), ("fil", "FIL_ph"), ("fi", "fi")] * 10)] + [(90, "ja on se että ei oli " * 30_000, None)]
    got = {r["doc_id"]: r["lang"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), host_col=None).collect()}
    assert all(got[n] == ("fil" if n % 2 == 0 else "fi") for n in range(40)) and got[90] == "fi"
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.example.com",), ("alone",), (None,)], "h string")
    assert [r[0] for r in hosts.select(language.domain_of(F.col("h"))).collect()] == ["b.co.uk", "b.co.uk", "example.com", "alone", None]


def test_pages_are_identified_by_all_evidence(spark, monkeypatch):
    """A text that says nothing is decided by markup, by the path's code, by the country suffix, by the host and by its domain."""
    words = {"en": "the and of that with this", "de": "der die und nicht sich über"}
    page = lambda t, tag="": f"<html{tag}><head><style>der die und</style></head><p>{t}</p></html>"
    rows = [(n, f"http://{'a' if c == 'en' else 'b'}.net/{n}", page(f"{words[c]} " * 5, f' lang="{c}-XX"')) for n, c in enumerate(["en", "de"] * 20)]
    rows += [(100 + n, f"http://h{n}.{c}house.org/x", page(f"{words[c]} " * 5, f" lang={c}")) for n, c in enumerate(["en", "de"] * 10)]
    empty = {200: ("http://q.com/1", ' lang="de"', "de"), 201: ("http://q.com/1", ' lang="en"', "en"), 202: ("http://q.com/de/1", "", "de"), 203: ("http://q.com/en-gb/1", "", "en"), 204: ("http://q.de/1", "", "de"), 205: ("http://q.ie/1", "", "en"), 206: ("http://a.net/1", "", "en"), 207: ("http://b.net/1", "", "de"), 208: ("http://other.dehouse.org/1", "", "de"), 209: ("http://other.enhouse.org/1", "", "en")}
    rows += [(i, u, page("ok", tag)) for i, (u, tag, _) in empty.items()] + [(300, None, None), (301, "no address", "<")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = language.identify_pages(frame).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and all(got[i]["lang"] == want for i, (*_, want) in empty.items())
    assert not got[300]["accepted"] and not got[301]["accepted"]
    monkeypatch.setattr(language, "BROADCAST_PRIORS", 0)
    again = {r["page_id"]: r for r in language.identify_pages(frame).collect()}
    assert all(again[i]["lang"] == r["lang"] and again[i]["posterior"] == pytest.approx(r["posterior"]) for i, r in got.items())


def test_language_posterior_from_its_definition(spark):
    """Likelihoods, declared languages, address suffixes and host priors fused anew, document by document."""
    r = random.Random(9)
    words = {"en": "the and of that".split(), "de": "der die und nicht".split()}
    truth = [r.choice(("en", "de")) for _ in range(60)]
    rows = [(n, " ".join(r.choice(words[c]) for _ in range(r.randint(1, 9))), c if n % 5 else r.choice(("en", "de", None)), r.choice(("a.x.org", "b.x.org", "c.y.com", "lone", None)), r.choice(("http://u.de/", "http://u.com/en/", "http://u.com/", None))) for n, c in enumerate(truth)]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string"), url_col="url").collect()}

    def bucket(tri):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in tri]
        return 0 if b.count(32) >= 2 else max(1, (b[0] << 16 | b[1] << 8 | b[2]) * 2654435761 % 2**32 >> 17)

    grams = [[bucket(t.encode()[i : i + 3]) for i in range(len(t.encode()) - 2)] for _, t, *_ in rows]
    grams = [[b for b in g if b] for g in grams]
    samples = {c: {t for _, t, d, *_ in rows if d == c} for c in ("en", "de")}
    counts = {c: Counter(b for t in samples[c] for g in [[bucket(t.encode()[i : i + 3]) for i in range(len(t.encode()) - 2)]] for b in g if b) for c in ("de", "en")}
    single = np.zeros(256)
    for t in [t for c in samples for t in samples[c]]:
        single += np.bincount(language._FOLD[np.frombuffer(t.encode(), np.uint8)], minlength=256)
    und = language.TextModel.fit(["de"], np.zeros((1, language.BUCKETS)), single).weights[-1]
    names = ["de", "en", "und"]
    weight = lambda c, b: und[b] if c == "und" else math.log((counts[c][b] + 0.2) / (sum(counts[c].values()) + 0.2 * language.BUCKETS))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    logs = np.array([[sum(weight(c, b) for b in g) / max(len(g), 1) * (len(g) / (1 + len(g) / 80)) for c in names] for g in grams])
    p = np.array([soft(x) for x in logs])
    base = (p.sum(0) + 1) / (p.sum() + 3)
    domain = {"a.x.org": "x.org", "b.x.org": "x.org", "c.y.com": "y.com", "lone": "lone"}
    for n, (_, _, declared, host, url) in enumerate(rows):
        others = [m for m in range(len(rows)) if m != n]
        in_host = p[[m for m in others if host and rows[m][3] == host]].sum(0)
        in_domain = p[[m for m in others if host in ("a.x.org", "b.x.org") and domain.get(rows[m][3]) == "x.org"]].sum(0)
        d_prior = (in_domain + 8 * base) / (in_domain.sum() + 8)
        prior = (in_host + 8 * d_prior) / (in_host.sum() + 8)
        speaks = lambda c, trust: np.array([0.0] * 3) if c is None else np.log([trust if x == c else (1 - trust) / 2 for x in names])
        suffix = {"http://u.de/": "de", "http://u.com/en/": "en"}.get(url)
        q = soft(logs[n] + np.log(prior) + speaks(declared, 0.8) + speaks(suffix, 0.6) + np.array([0, 0, math.log(1e-3)]))
        assert got[n]["lang"] == names[q.argmax()] and got[n]["posterior"] == pytest.approx(q.max(), rel=1e-4), n


def test_markup_declares_a_language(spark):
    words = {"en": "the and of that with this", "de": "der die und nicht sich über"}
    rows = [(n, f"{words[c]} " * 5, "xx", f"<html lang='{c}'>") for n, c in enumerate(["en", "de"] * 20)] + [(90, words["de"] * 5, "de", "<p>"), (91, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, html string")
    for column in ("lang", None):
        got = {r["doc_id"]: r for r in language.identify(frame, declared_col=column, host_col=None, html_col="html").collect()}
        assert all(got[n]["lang"] == got[n]["declared"] == c for n, c in enumerate(["en", "de"] * 20))
        assert got[90]["lang"] == "de" and got[90]["declared"] == ("de" if column else None)


def test_a_lone_host_is_counted_once(spark):
    """The prior of a host that is its whole domain: its counts and the corpus's, nothing twice."""
    rows = [(n, "the and of that with this the and", "en", "x") for n in range(8)] + [(100 + n, "der die und nicht sich der die und", "de", "y") for n in range(24)]
    rows += [(200, "es", None, "x")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    mine, top = got[200], {"en": 8 + (1 / 3), "de": 24 + (1 / 3)}
    base = (top[mine["lang"]] + 1) / (33 + 3)
    seen = 8 if mine["lang"] == "en" else 0
    assert mine["host_prior"] == pytest.approx((seen + 8 * base) / 16, abs=0.03)


def test_host_prior_decides_short_texts(spark):
    rows = [(n, "the and of that with this the and", "en", "x.org") for n in range(40)] + [(100 + n, "der die und nicht sich der die und", "de", "y.org") for n in range(40)]
    rows += [(200, "es", None, "x.org"), (201, "es", None, "y.org")]
    got = {r["doc_id"]: r["lang"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[200] == "en" and got[201] == "de"


def test_resampling(spark, nothing):
    r = random.Random(6)
    good, junk = "calm clear plain useful text about rivers".split(), "### $$$ buy now cheap win".split()
    table = [(n, " ".join(r.choice(good if n % 3 else junk) for _ in range(30)), n % 3 > 0) for n in range(300)]
    docs = spark.createDataFrame([(n, t, 1, "k") for n, t, _ in table] + [(900, None, 1, "k"), (901, "", 1, "k"), (1, table[1][1], 1, "k")], "doc_id long, text string, key int, draw string")
    labels = spark.createDataFrame([(n, int(g), 0) for n, _, g in table[:150]], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels, fraction=0.5).collect()
    assert len(got) == 303 and sum(x["selected"] for x in got) == 152
    assert not any(x["selected"] for x in got if x["doc_id"] < 900 and x["doc_id"] % 3 == 0) and not any(x["selected"] for x in got if x["doc_id"] >= 900)
    draws = sorted((x["draw"] for x in got), reverse=True)
    assert {x["draw"] >= draws[151] for x in got if x["selected"]} == {True}
    again = resample.resample(docs.repartition(5), labels, fraction=0.5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert resample.resample(nothing, labels).count() == 0
    flat = resample.resample(docs, labels.limit(0), fraction=0.5).collect()
    assert {x["log_weight"] for x in flat} == {0.0, -1e9} and sum(x["selected"] for x in flat) == 152


def brute_buckets(text, buckets):
    """Buckets of a text's words and pairs by scalar arithmetic, from the definition of the features."""
    mask = 2**64 - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    letter = [mixed((b + 1) * 0x9E3779B97F4A7C15 + 11 & mask) for b in range(256)]
    hashes = []
    for w in re.findall(r"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode().decode("latin-1")):
        hashes.append(mixed(sum(letter[b] * pow(0x9E3779B97F4A7C15, n, 2**64) for n, b in enumerate(w.encode("latin-1").lower())) & mask))
    pairs = [mixed(a * 0x9FB21C651E98DF25 + b & mask) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes + pairs]


@pytest.mark.parametrize("length", [None, 200.0])
def test_resampling_weights(spark, length):
    """Log-ratios of the two models, computed anew by counting; a long text among them."""
    r = random.Random(16)
    texts = [" ".join(r.choice("Sun moon, tree! river stone bird wind Été x9".split()) for _ in range(r.randint(1, 40))) for _ in range(40)] + [None, "", "word " * 60_000]
    good, buckets = set(range(0, 40, 3)), 500
    labels = spark.createDataFrame([(n, int(n in good), 0) for n in range(40)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in resample.resample(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels, fraction=0.5, buckets=buckets, length=length).collect()}
    found = [brute_buckets(t, buckets) for t in texts]
    raw, target = Counter(b for f in found for b in f), Counter(b for n in good for b in found[n])
    model = lambda c, b: (c[b] + 1) / (sum(c.values()) + buckets)
    for n, f in enumerate(found):
        want = sum(c * math.log(model(target, b) / model(raw, b)) for b, c in Counter(f).items())
        want = want if length is None or not f else want * length / len(f)
        assert got[n]["n_features"] == len(f) and math.isclose(got[n]["log_weight"], want if f else -1e9, rel_tol=1e-9, abs_tol=1e-9)
    assert sum(x["selected"] for x in got.values()) == math.ceil(0.5 * len(texts))


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9, 1.0])
def test_resampling_of_repeated_rows(spark, fraction):
    docs = spark.createDataFrame([(1, "same words again", 7)] * 9 + [(2, "others here", 7), (None, None, 7), (None, None, 7)], "doc_id long, text string, id int").repartition(3)
    got = resample.resample(docs, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), fraction=fraction).collect()
    assert len(got) == 12 and sum(x["selected"] for x in got) == math.ceil(fraction * 12) and Counter(x["doc_id"] for x in got) == {1: 9, 2: 1, None: 2}
    assert min([x["draw"] for x in got if x["selected"]]) >= max([x["draw"] for x in got if not x["selected"]], default=-1e12)


def test_gumbel_draw_follows_weights(spark):
    """The first draw falls on rows in proportion to exp(log_weight)."""
    u = np.random.default_rng(1).integers(0, 2**63, size=(20000, 3), dtype=np.uint64)
    keys = np.log([0.6, 0.3, 0.1]) - np.log(-np.log(resample.uniform(resample.mix(u))))
    share = np.bincount(keys.argmax(1), minlength=3) / len(u)
    assert np.allclose(share, [0.6, 0.3, 0.1], atol=0.015)


@pytest.mark.parametrize(("foreign", "least"), [(False, 135), (True, 120)])
def test_extraction_held_out(foreign, least):
    trees, draw = extract.model(), extract.Template(4321, foreign)
    exact = 0
    for _ in range(150):
        source = draw.page()
        want = "\n\n".join(t.replace("", "") for t in extract.Flat(extract.parse(source)[0]).text if t and t.startswith(""))
        exact += extract.main_text([re.sub("[]", "", source)], trees)[0] == want
    assert exact >= least


def test_extraction_frame(spark):
    page = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Head &amp; tail</h1><p><b>First  line<br>goes on.<p>Second one, which is a bit longer than the first.</p></article><div class="comments"><p>I liked this a lot, thanks for it.</p></div><footer>&copy; me</footer>'
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<<<>>> & <p", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert got[1]["text"] == "Head & tail\n\nFirst line goes on.\n\nSecond one, which is a bit longer than the first." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and extract.extract(pages).count() == 5
    assert extract.extract(pages.limit(0)).count() == 0


def test_extraction_is_consistent():
    flat = extract.Flat(extract.parse("<div><p>a</p><p>b</p></div><p>c</p>")[0])
    margin = np.array([-9.0 if p >= 0 else 9.0 for p in flat.parent])
    assert flat.kept(margin) == []
    margin = np.full(len(flat.parent), 5.0)
    div = next(k for k, p in enumerate(flat.parent) if p == 0)
    margin[div] = -40.0  # a dropped ancestor takes its likely descendants along
    assert flat.kept(margin) == ["c"]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "<title>T &amp; t</title><p>Hi <a href='/y'>there</a></p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    stored = warc.responses(pages).cache()
    path = str(tmp_path / "r.warc.gz")
    with open(path, "wb") as f:
        for r in stored.collect():
            f.write(warc.encode(r["header"], r["block"]))
    again = warc.scan(spark, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stored.collect()))
    made = warc.derivatives(again).collect()
    assert len(made) == 6
    meta = next(r for r in made if r["record_type"] == "metadata" and r["target_uri"] == "http://a/x")
    text = next(r for r in made if r["record_type"] == "conversion" and r["target_uri"] == "http://a/x")
    source = next(r for r in stored.collect() if r["target_uri"] == "http://a/x")
    assert bytes(text["block"]).decode() == "Hi there" and meta["refers_to"] == text["refers_to"] == source["record_id"]
    assert text["record_id"].encode() in bytes(meta["block"]) and b'"T & t"' in bytes(meta["block"]) and b'"/y"' in bytes(meta["block"])
    assert all(r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"]) for r in made)
    direct = warc.page_derivatives(pages).drop("page_id").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, made))
    assert warc.page_derivatives(pages.limit(0)).count() == 0
    assert warc.derive("<x>", None, "d", b"no header end", "sha1:bad")


def independent_digest(data):
    """base-32 SHA-1 by another route than the operator's."""
    bits = "".join(f"{b:08b}" for b in bytes.fromhex(hashlib.sha1(data).hexdigest()))
    return "sha1:" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[int(bits[i : i + 5], 2)] for i in range(0, len(bits), 5))


def test_warc_derivatives_by_other_means(spark):
    """Links, digests, lengths and text of the derivatives from the pages alone; clashing columns and a long page."""

    class Text(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.links, self.title, self.open = [], [], "", ""

        def handle_starttag(self, tag, attrs):
            self.open = tag
            self.links += [dict(attrs)["href"]] if tag == "a" else []

        def handle_data(self, data):
            if self.open == "title":
                self.title += data
            else:
                self.parts.append(data)

    rows = [(n, f"http://h/{n}", f"<title>T{n}</title><p>some text {n} &amp; <a href='/l{n}'>more</a></p>", 1, "b") for n in range(20)] + [(90, "http://h/long", "<title>L</title><p>" + "word " * 200_000 + "</p>", 1, "b"), (91, None, "", 1, "b")]
    got = warc.page_derivatives(spark.createDataFrame(rows, "page_id long, url string, html string, block int, header string")).collect()
    assert len(got) == 2 * len(rows)
    for page_id, url, page, *_ in rows:
        meta, text = sorted((r for r in got if r["page_id"] == page_id), key=lambda r: r["record_type"], reverse=True)
        parsed = Text()
        parsed.feed(page)
        want = " ".join("".join(parsed.parts).split())
        assert bytes(text["block"]).decode() == want and meta["target_uri"] == text["target_uri"] == url
        described = json.loads(bytes(meta["block"]))
        assert described["title"] == (parsed.title or None) or described["title"] == parsed.title
        assert [x["url"] for x in described["links"]] == parsed.links and described["payload-length"] == len(page.encode())
        assert described["payload-digest"] == independent_digest(page.encode()) and described["conversion"] == text["record_id"]
        for r in (meta, text):
            block = bytes(r["block"])
            assert r["block_digest"] == independent_digest(block) and r["content_length"] == len(block)
            fields = dict(x.split(": ", 1) for x in r["header"].split("\r\n")[1:-1])
            assert fields["WARC-Refers-To"] == r["refers_to"] and fields["Content-Length"] == str(len(block)) and fields["WARC-Record-ID"] == r["record_id"]


def test_warc_files(spark, tmp_path):
    """Written files have a gzip member a record; the reader goes on behind broken records, and joins blocks that hold a record's start."""
    pages = spark.createDataFrame([(n, f"http://a/{n}", "x" * n) for n in range(30)] + [(99, "http://b", "in it\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nstill\r\n\r\nWARC/"), (100, "http://c", "\xff\u00e9" * 300_000)], "page_id long, url string, html string").repartition(3)
    stored = warc.responses(pages).cache()
    want = sorted(map(tuple, stored.collect()))
    files = warc.write_records(stored, str(tmp_path / "out"))
    assert sum(n for _, n in files) == 32 and len(files) == 3
    with pytest.raises(FileExistsError):
        warc.write_records(stored, str(tmp_path / "out"))
    for damaged in (False, True):
        assert sorted(map(tuple, warc.scan(spark, str(tmp_path / "out"), damaged).collect())) == want
    one = tmp_path / "out" / files[0][0]
    raw = one.read_bytes()
    assert raw.count(b"\x1f\x8b\x08\x00") >= files[0][1]
    plain = b"".join(warc.encode(r["header"], bytes(r["block"])) for r in stored.orderBy("record_id").limit(6).collect())
    parts = gzip.decompress(plain).split(b"\r\n\r\nWARC/")
    short = parts[0] + b"\r\n\r\nWARC/" + parts[1][:-1] + b"\r\n\r\nWARC/1.0\r\nnothing" + b"".join(b"\r\n\r\nWARC/" + x for x in parts[2:])
    (tmp_path / "short.warc").write_bytes(short)
    (tmp_path / "empty.warc").write_bytes(b"")
    kinds = Counter(r["record_type"] for r in warc.scan(spark, str(tmp_path / "*.warc")).collect())
    assert kinds["broken"] == 2 and kinds["response"] == 5
    a, b, c = (warc.encode(f"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 3\r\n", t) for t in (b"one", b"two", b"six"))
    (tmp_path / "hurt.warc.gz").write_bytes(a + b[:-12] + c)
    got = [(r["record_type"], bytes(r["block"])) for r in warc.scan(spark, str(tmp_path / "hurt.warc.gz"), damaged=True).collect()]
    assert ("x", b"one") in got and ("x", b"six") in got
    assert [r[1] for r in warc.records_of(iter([b"junk"]))] == ["broken"] and list(warc.records_of(iter([]))) == []


def test_warc_records_do_not_depend_on_splits(spark, tmp_path):
    """Plain files whose blocks hold whole records and record starts, read at several split sizes."""
    inner = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <inner>\r\nContent-Length: 5\r\n\r\ninner\r\n\r\n"
    records, raw = [], b""
    for n in range(40):
        block = b"a" * (n * 7) + b"\r\n\r\n" + inner * (n % 3) + b"tail\r\n\r\nWARC/1.0 is no record" + b"z" * n
        raw += b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n"
        records.append((f"<r{n}>", block))
    (tmp_path / "nested.warc").write_bytes(raw)
    (tmp_path / "other.warc").write_bytes(raw[: raw.index(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r5>")])
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(raw))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (128 << 20, 5000, 1000, 300):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = [(r["record_id"], bytes(r["block"])) for r in warc.scan(spark, str(tmp_path / "*.warc")).collect()]
            assert sorted(got) == sorted(records + records[:5]), size
        assert sorted((r["record_id"], bytes(r["block"])) for r in warc.scan(spark, str(tmp_path)).collect()) == sorted(records * 2 + records[:5])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(MODEL, 0.5)


def segmentations(text, vocab):
    table = {b: i for i, b in enumerate(vocab.bytes) if b and not vocab.byte_id.min() <= i <= vocab.byte_id.max()}
    raw, out = b" " + text.encode(), []

    def walk(p, acc, s):
        if p == len(raw):
            out.append((tuple(acc), s))
        for e in range(p + 1, len(raw) + 1):
            if (i := table.get(raw[p:e])) is not None:
                walk(e, [*acc, i], s + vocab.score[i])

    walk(0, [], 0.0)
    z = np.logaddexp.reduce([s for _, s in out])
    return {k: math.exp(s - z) for k, s in out}


def test_segmentations_are_sampled_without_replacement(vocab):
    p = segmentations("the cat", vocab)
    n = 6000
    rows, numbers, flat, ends, probs, inclusions, whole = pieces.encode_batch(pa.array(["the cat"] * n), pieces.mix(np.arange(n, dtype=np.uint64)), vocab, 3)
    by, weight = defaultdict(list), Counter()
    for r, d in enumerate(rows):
        ids = tuple(flat[ends[r] : ends[r + 1]].tolist())
        by[d].append(ids)
        assert probs[r] == pytest.approx(math.log(p[ids]), abs=1e-9)
        weight[ids] += p[ids] / math.exp(inclusions[r])
    assert all(whole) and all(len(set(x)) == 3 for x in by.values())
    first, pair = Counter(x[0] for x in by.values()), Counter(tuple(x[:2]) for x in by.values())
    a, b = sorted(p, key=lambda k: -p[k])[:2]
    assert first[a] / n == pytest.approx(p[a], abs=0.025) and pair[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.025)
    assert sum(weight.values()) / n == pytest.approx(1.0, abs=0.03)  # inverse inclusion weights are unbiased


def test_every_segmentation_comes_out_once(vocab):
    p = segmentations("ab c", vocab)
    rows, _, flat, ends, *_ = pieces.encode_batch(pa.array(["ab c"]), np.array([7], np.uint64), vocab, 10_000)
    got = [tuple(flat[ends[r] : ends[r + 1]].tolist()) for r in range(len(rows))]
    assert len(got) == len(set(got)) and set(got) == set(p)


def test_tail_items_are_split_when_popped(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "HEAD", 1)
    p = segmentations("the cat", vocab)
    n = 3000
    rows, _, flat, ends, *_ = pieces.encode_batch(pa.array(["the cat"] * n), pieces.mix(np.arange(n, dtype=np.uint64)), vocab, 3)
    by = defaultdict(list)
    for r, d in enumerate(rows):
        by[d].append(tuple(flat[ends[r] : ends[r + 1]].tolist()))
    assert all(len(set(x)) == 3 for x in by.values())
    a, b = sorted(p, key=lambda k: -p[k])[:2]
    pair = Counter(tuple(x[:2]) for x in by.values())
    assert pair[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.03) and pair[b, a] / n == pytest.approx(p[b] * p[a] / (1 - p[b]), abs=0.03)


def test_long_words_are_drawn_alike(vocab, monkeypatch):
    """Node by node or side by side: the same edges, probabilities and scores."""
    r = random.Random(3)
    texts = pa.array(["".join(r.choice("abcdefgh") for _ in range(700)), "an ordinary one", "aaaa" * 200, "x" * 70 + " " + "q" * 90, "", None])
    keys = pieces.mix(np.arange(6, dtype=np.uint64))
    got = []
    for long in (4, 40, 10_000):
        monkeypatch.setattr(pieces, "LONG", long)
        got.append([np.asarray(x, float) for x in pieces.encode_batch(texts, keys, vocab, 3)])
    for other in got[1:]:
        assert all(np.allclose(a, b) for a, b in zip(got[0], other, strict=True))
    assert all(got[0][-1])


def test_texts_without_spaces(vocab):
    """Long runs end in seconds, also of characters that few pieces join; no piece crosses a cut."""
    r = random.Random(4)
    wide = "".join(chr(r.randint(0x4E00, 0x5200)) if r.random() < 0.9 else r.choice("abc。、") for _ in range(100_000))
    runs = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), wide, "ab\ncd\t" * 20_000]
    began = time.monotonic()
    *_, whole = pieces.encode_batch(pa.array(runs), pieces.mix(np.arange(3, dtype=np.uint64)), vocab, 2)
    assert all(whole) and time.monotonic() - began < 60
    joined = {two for b in vocab.bytes for two in itertools.pairwise(b.decode("utf-8", "replace"))}
    data = np.frombuffer(wide[:500].encode(), np.uint8)
    power, inverse = pieces._powers(len(data))
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(pieces._BYTE[data] * power[: len(data)])])
    cuts = pieces.cut_long_words(data, np.array([0]), np.array([len(data)]), cum, inverse, vocab)
    want = [0] + [len(wide[: n + 1].encode()) for n, two in enumerate(itertools.pairwise(wide[:500])) if two not in joined]
    assert cuts.tolist() == want


def test_encoding_round_trips(spark, docs, nothing):
    texts = ["", None, " ", "  two  spaces ", "▁ mark", "日本語 ☃ é", "x" * 5000, "a\nb\tc", "the the the"]
    frame = spark.createDataFrame([(n, t, 3) for n, t in enumerate(texts)] + [(None, "z z", 3), (8, "the the the", 3)], "doc_id long, text string, ids int")
    made = pieces.encode(frame, MODEL, samples=2)
    back = pieces.decode(made, MODEL).collect()
    want = dict(enumerate(texts)) | {None: "z z"}
    assert all(r["text"] == want[r["doc_id"]] and r["round_trip"] for r in back)
    assert {r["doc_id"] for r in back} == set(want)
    eight = [tuple(r["ids"]) for r in back if r["doc_id"] == 8]
    assert len(eight) == 4 and len(set(eight)) == 2
    again = pieces.encode(frame.repartition(4), MODEL, samples=2)
    key = lambda rows: sorted((str(r["doc_id"]), r["sample"], str(r["ids"])) for r in rows)
    assert key(again.collect()) == key(made.collect())
    assert pieces.encode(nothing, MODEL).count() == 0
