"""Conversation repair against brute force, whole and in blocks."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int"
WHITE = " \t\n\x0b\x0c\r"


def best(rows):
    """Cheapest (cost, initials, lines) by trying all edits, forward, row by row; rows: (role, text, must go, breaks off)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(at):
        for _ in range(3):
            for state, (c, e, lines) in list(at.items()):
                for to in step[state]:
                    if to != "s":
                        found = (c + 3, e + "I", [*lines, name[to] + ":"])
                        if to not in at or found[:2] < at[to][:2]:
                            at[to] = found
        return at

    at = inserted({"": (0, "", [])})
    for role, text, gone, cut in rows:
        after = {}

        def put(state, found):
            if state not in after or found[:2] < after[state][:2]:
                after[state] = found

        for state, (c, e, lines) in at.items():
            put(state, (c + 4, e + "D", lines))
            for to in step[state]:
                if not gone and role[:1] == to:
                    put(to, (c + 3 * cut, e + "K", [*lines, f"{role}:{text}"]))
                if not gone and to != "s":
                    put(to, (c + 3 + 3 * cut, e + "R", [*lines, f"{name[to]}:{text}"]))
        at = inserted(after)
    return min((at[s] for s in ("", "a") if s in at), key=lambda x: x[:2])


def expected(rows):
    """What repair() gives, by conversation, from (conv_id, turn, role, text, present)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, there in rows if c == conv and there]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in own if t is not None]
        cost, audit, lines = best(marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["Yes.", "No?", "And then", "", " \n", "\u00a0", None, "What!\t ", "é", "long " * 4000 + "end."]
    out = []
    for conv in [None, *range(150)]:
        for turn in range(r.choice((0, 1, 2, 3, 5, 8, 13))):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle", "écho")) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(texts) if r.random() < 0.4 else f"turn {turn} of {conv}."
            out.append((conv, None if r.random() < 0.1 else turn + (r.random() < 0.1), role, text, r.random() < 0.95))
    out += [(500, None, "user", "same.", True)] * 40 + [(500, t, "user", "same.", True) for t in range(30)]
    out += [(501, 1, "user", "gone", False)] * 3
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], "clash", 1, r[4]) for r in rows], SCHEMA + ", there boolean").repartition(3)


@pytest.mark.parametrize("most", [{}, {"most_rows": 2}, {"most_rows": 5, "most_bytes": 200}])
def test_against_all_edits(spark, rows, most):
    want = expected(rows)
    got = repair.repair(frame(spark, rows), present=F.col("there"), **most).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: x[:8] for c, x in want.items()} and len(got) == len(want)
    turns = sorted(repair.repaired_turns(frame(spark, rows), present=F.col("there"), **most).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"]))
    lines = {}
    for r in turns:
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert lines == {c: x[8] for c, x in want.items() if x[8]}


def test_cheapest_and_least():
    assert best([("user", "a.", False, False)])[:2] == (3, "KI")
    assert best([("assistant", "a.", False, False), ("assistant", "b.", False, False)])[:2] == (3, "RK")
    assert best([("tool", "a.", False, False)])[:2] == (4, "D")


def test_edge_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.repaired_turns(none).count() == 0 and repair.repair(repair.damaged(none), present=F.col("present")).count() == 0
    same = [(1, 1, "user", "Hi.", True)] * 50
    assert repair.repair(frame(spark, same)).first()["audit"] == "K" + "D" * 49 + "I"


def test_damage(spark, rows):
    own = [(*r[:4], "clash", 1) for r in rows]
    got = repair.damaged(spark.createDataFrame(own, SCHEMA)).collect()
    want = []
    for conv, turn, role, text, *_ in own:
        name = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in name(text) if c not in ".!?") if code == 2 else name(text)
        want += [(conv, turn, "user" if code == 4 else name(role), text, code != 0)] * (1 + (code == 3))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    # nothing but the second of two equal rows is a duplicate where damage repeats one
    assert all(r["conv_id"] is None or r["present"] in (True, False) for r in got)
