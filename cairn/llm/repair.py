"""Repair of conversation structure by the cheapest edits.

Repaired turns follow the grammar (system? (user assistant)+)?, or nothing is left. A backward pass computes the cost to
go from every row and grammar state; a forward pass then walks from the start and takes, among the edits that keep to
the cheapest cost, the one whose initial is least. Rows that must go (blank, repeated) only ever add a D before what
follows, so both passes run over the other rows, for many conversations at once.

A conversation of any length is split: costs to go are linear in the costs behind a block (in the sense of minimum and
sum), so a block is a 4 x 4 table of costs and, once the costs behind it are known, a map of four states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import frugal, without, written

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of keeping a row that breaks off.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Where an inserted or rerolled turn leads; where a kept one of initial s, u, a or another leads (-1: nowhere).
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Costs once no row is left: what has to be inserted then.
LAST = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
NAMES = pa.array(["", "", "user", "assistant"])
D, I, K, R = (ord(x) for x in "DIKR")


def _with_inserts(c: np.ndarray) -> np.ndarray:
    c[:, 2] = np.minimum(c[:, 2], c[:, 3] + INSERT)
    c[:, 3] = np.minimum(c[:, 3], c[:, 2] + INSERT)
    c[:, 0] = np.minimum(c[:, 0], c[:, 2] + INSERT)
    c[:, 1] = np.minimum(c[:, 1], c[:, 2] + INSERT)
    return c


def costs_to_go(start: np.ndarray, initial: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows + sequences) x 4: the least cost from before each row, and behind the last one, of each sequence.

    start: n + 1 offsets of the sequences; initial: 0 to 3 for s, u, a, others; end: costs behind each sequence."""
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    at = start[1:] + np.arange(len(size))  # where the costs behind a sequence stand
    out = np.empty((len(initial) + len(size), 4), np.int64)
    out[at] = end
    for t in range(int(size.max(initial=0))):
        live = order[: np.searchsorted(falling, -t, "left")]
        after = out[at[live] - t]
        row = start[live + 1] - 1 - t
        whole = cut[row] * CUT
        to = np.stack([after[:, 2], after[:, 2], after[:, 3], after[:, 2]], axis=1) + REROLE
        kept = KEPT[:, initial[row]].T
        stay = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), FAR)
        out[at[live] - t - 1] = _with_inserts(np.minimum(np.minimum(to, stay) + whole[:, None], after + DELETE))
    return out


def walk(start: np.ndarray, initial: np.ndarray, cut: np.ndarray, lead: np.ndarray, cost: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ASCII-least cheapest edits of each sequence from its entry state.

    lead: deletions that stand before each row. Returns sequence, code, times, row and state after of the edits in
    order, and the state in which each sequence ends."""
    size = np.diff(start)
    state, done = entry.copy(), np.zeros(len(size), np.int64)
    live = np.flatnonzero(size > 0)
    fresh = np.ones(len(size), bool)
    told: list[tuple[np.ndarray, ...]] = []
    while len(live):
        row = start[live] + done[live]
        new = live[fresh[live] & (lead[row] > 0)]
        if len(new):
            at = start[new] + done[new]
            told.append((new, np.full(len(new), D), lead[at], np.full(len(new), -1), state[new]))
        fresh[live] = False
        here, s = row + live, state[live]
        left = cost[here, s]
        on = NEXT[s]
        keep = KEPT[s, initial[row]]
        whole = cut[row] * CUT
        drop = cost[here + 1, s] + DELETE == left
        put = ~drop & (cost[here, on] + INSERT == left)
        stay = ~drop & ~put & (keep >= 0) & (cost[here + 1, np.maximum(keep, 0)] + whole == left)
        code = np.where(drop, D, np.where(put, I, np.where(stay, K, R)))
        state[live] = np.where(drop, s, np.where(stay, keep, on))
        told.append((live, code, np.ones(len(live), np.int64), np.where(put, -1, row), state[live]))
        done[live] += ~put
        fresh[live] = ~put
        live = live[done[live] < size[live]]
    if not told:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, state
    seq, code, times, row, after = (np.concatenate(x) for x in zip(*told, strict=True))
    order = np.argsort(seq, kind="stable")
    return seq[order], code[order], times[order], row[order], after[order], state


def closing(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and state after of the inserts that end whole conversations, in order."""
    two, one = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
    seq, after = np.concatenate([two, two, one]), np.concatenate([np.full(len(two), 2), np.full(len(two), 3), np.full(len(one), 3)])
    order = np.argsort(seq, kind="stable")
    return seq[order], after[order]


def _edits(n: int, seq: np.ndarray, code: np.ndarray, times: np.ndarray) -> list[str]:
    """The edits' initials of n sequences."""
    letters = np.repeat(code, times).astype(np.uint8).tobytes().decode()
    ends = np.cumsum(np.bincount(seq, times, n)).astype(np.int64).tolist()
    return [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _lines(seq: np.ndarray, code: np.ndarray, row: np.ndarray, after: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Sequence, code, role and text of the turns that stand after the edits."""
    stands = code != D
    seq, code, row, after = seq[stands], code[stands], row[stands], after[stands]
    kept, named = pa.array(code == K), NAMES.take(pa.array(after))
    old = pa.array(row, mask=row < 0)
    return seq, code, pc.if_else(kept, roles.take(old), named), pc.fill_null(texts.take(old), "")


def _joined(n: int, seq: np.ndarray, role: pa.Array, text: pa.Array) -> pa.Array:
    """The `role:text` lines of n sequences, newline-joined."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.binary_join_element_wise(role, text, ":")), "\n")


def _one(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name)
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def _starts(col: pa.Array) -> np.ndarray:
    """Offsets of the runs of equal values (nulls equal), and the length."""
    if not len(col):
        return np.zeros(1, np.int64)
    codes = np.asarray(pc.dictionary_encode(col, null_encoding="encode").indices)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(col)]])


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that end where a run of equal values in `column` ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        last = int(_starts(_one(table, column))[-2])
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bad_pairs(initial: np.ndarray) -> np.ndarray:
    """Whether the pair of each row and the one before is none of su, ua, au."""
    a, b = initial[:-1], initial[1:]
    return np.concatenate([[False], ~(((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2)))])


def _rows_of(table: pa.Table) -> dict:
    """Faults, and rows without those that must go, of a table of whole conversations in order."""
    start = _starts(_one(table, "conv"))
    n = len(start) - 1
    conv = np.repeat(np.arange(n), np.diff(start))
    there = np.asarray(_one(table, "present"))
    roles, texts, turns = _one(table, "role"), _one(table, "text"), _one(table, "turn")
    codes = [np.asarray(pc.dictionary_encode(x).indices).astype(np.int64) for x in (roles, texts)]
    blank, cut, initial = (np.asarray(_one(table, x)) for x in ("blank", "cut", "initial"))
    rows = np.flatnonzero(there)
    again = np.ones(len(rows), bool)
    again[np.unique((conv[rows] * (codes[0].max(initial=0) + 1) + codes[0][rows]) * (codes[1].max(initial=0) + 1) + codes[1][rows], return_index=True)[1]] = False
    blank, cut, again = blank[rows], cut[rows], again & ~blank[rows]
    gone = blank | again
    c, first = conv[rows], np.ones(len(rows), bool)
    first[1:] = c[1:] != c[:-1]
    count = lambda mask: np.bincount(c[mask], minlength=n)
    # gaps
    known = np.asarray(turns.is_valid())[rows]
    t, ct = np.asarray(turns.fill_null(0))[rows][known], c[known]
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, ct, t)
    np.maximum.at(most, ct, t)
    new = np.ones(len(t), bool)
    new[1:] = (ct[1:] != ct[:-1]) | (t[1:] != t[:-1])
    gaps = np.where(np.bincount(ct, minlength=n) > 0, most - least + 1 - np.bincount(ct[new], minlength=n), 0)
    live = np.flatnonzero(~gone)
    before = np.cumsum(gone)
    lead = np.diff(before[live], prepend=0)
    at = np.concatenate([[0], np.cumsum(np.bincount(c[live], minlength=n))])
    # a conversation's first row does not count what must go in the one before; what goes behind its last row stands apart
    edge = np.concatenate([[0], before])[np.searchsorted(c, np.arange(n + 1))]
    heads = at[:-1][np.diff(at) > 0]
    lead[heads] = before[live[heads]] - edge[c[live[heads]]]
    tail = np.diff(edge) - np.bincount(c[live], lead, n).astype(np.int64)
    return {
        "conv": _one(table, "conv").take(pa.array(start[:-1])), "gaps": gaps, "blank": count(blank), "duplicate": count(again), "truncated": count(cut & ~gone),
        "illegal": count(_bad_pairs(initial[rows]) & ~first), "forced": np.bincount(c[gone], minlength=n), "start": at, "initial": initial[rows][live], "cut": cut[live], "lead": lead, "tail": tail,
        "roles": roles.take(pa.array(rows[live])), "texts": texts.take(pa.array(rows[live])),
    }


def _with_tail(n: int, edits: tuple, tail: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """edits (sequence, code, times, row, state after) with what is deleted behind the last row and inserted at the end."""
    ends, after = closing(state)
    gone = np.flatnonzero(tail > 0)
    less = np.full(len(gone), -1)
    parts = [edits, (gone, np.full(len(gone), D), tail[gone], less, less), (ends, np.full(len(ends), I), np.ones(len(ends), np.int64), np.full(len(ends), -1), after)]
    seq, code, times, row, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(seq, kind="stable")
    return seq[order], code[order], times[order], row[order], after[order]


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "position long, edit string, role string, text string"


def _small(turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole conversations from rows in order: a row each, or their turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "conv"):
            x = _rows_of(table)
            n = len(x["conv"])
            cost = costs_to_go(x["start"], x["initial"], x["cut"], np.tile(LAST, (n, 1)))
            *edits, state = walk(x["start"], x["initial"], x["cut"], x["lead"], cost, np.zeros(n, np.int64))
            seq, code, times, row, after = _with_tail(n, tuple(edits), x["tail"], state)
            of, kind, role, text = _lines(seq, code, row, after, x["roles"], x["texts"])
            if turns:
                first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])[of]
                letters = pa.array([chr(k) for k in kind], pa.string())
                yield pa.RecordBatch.from_arrays([x["conv"].take(pa.array(of)), pa.array(np.arange(len(of)) - first), letters, role, text], names=["conv", "position", "edit", "role", "text"])
                continue
            hashes = [hashlib.sha256(s.as_buffer()).hexdigest() for s in _joined(n, of, role, text)]
            total = cost[x["start"][:-1] + np.arange(n), 0] + DELETE * x["forced"]
            yield pa.RecordBatch.from_arrays([x["conv"], *(pa.array(x[k].astype(np.int64)) for k in ("gaps", "blank", "duplicate", "truncated", "illegal")), pa.array(total), pa.array(_edits(n, seq, code, times), pa.string()), pa.array(hashes, pa.string())], names=["conv", *(f.split()[0] for f in SUMMARY.split(", "))])

    return frugal(run)


# --- conversations too long for one task ---

BLOCK = "part int, block int, conv {0}, rows long, start_initial int, end_initial int, pairs long, blank long, duplicate long, truncated long, forced long, initial binary, cut binary, lead array<long>, tail long, roles array<string>, texts array<string>, costs array<long>"


def _blocks(most_rows: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order (each with its number of copies, and whether the first is new) to blocks: a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for b in batches:
            starts = _starts(b.column("conv"))
            weight = np.cumsum(np.asarray(pc.binary_length(b.column("text"))).astype(np.int64))
            cuts = [0]
            for end in starts[1:].tolist():
                while cuts[-1] < end:
                    base = weight[cuts[-1]]
                    cuts.append(min(end, cuts[-1] + most_rows, max(cuts[-1] + 1, int(np.searchsorted(weight, base + most_bytes, "right")))))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                x = b.slice(lo, hi - lo)
                n, new, blank, cut, initial = (np.asarray(x.column(c)) for c in ("n", "new", "blank", "cut", "initial"))
                live = new & ~blank
                forced = n - live
                before, at = np.cumsum(forced), np.flatnonzero(live)
                # copies of a live row go behind it
                lead = np.diff(np.concatenate([[0], before[at] - forced[at]]))
                size = len(at)
                unit = np.full((4, 4), FAR)
                np.fill_diagonal(unit, 0)
                cost = costs_to_go(np.arange(5) * size, np.tile(initial[at], 4), np.tile(cut[at], 4), unit)[np.arange(4) * (size + 1)]
                values = [part, block, x.column("conv")[0], int(n.sum()), int(initial[0]), int(initial[-1]), int(_bad_pairs(initial).sum() + (n - 1).sum()), int(n[blank].sum()), int((n - new)[~blank].sum()), int((cut & live).sum()), int(forced.sum()), initial[at].astype(np.uint8).tobytes(), cut[at].astype(np.uint8).tobytes(), lead.tolist(), int(forced.sum() - lead.sum()), x.column("role").take(pa.array(at)).to_pylist(), x.column("text").take(pa.array(at)).to_pylist(), cost.T.reshape(-1).tolist()]
                names = [f.split()[0] for f in BLOCK.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v.as_py()], v.type) if isinstance(v, pa.Scalar) else pa.array([v], _TYPES.get(k)) for k, v in zip(names, values, strict=True)], names=names)
                block += 1

    return frugal(run)


_TYPES = {"part": pa.int32(), "block": pa.int32(), "start_initial": pa.int32(), "end_initial": pa.int32(), "initial": pa.binary(), "cut": pa.binary(), "lead": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "costs": pa.list_(pa.int64())}


def _streamed(name: str, begin: Callable, step: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks in order; what `step` carries from one to the next begins anew at each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, conv, began = None, None, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not began or r["conv"] != conv:
                    carried, conv, began = begin(), r["conv"], True
                value, carried = step(r, carried)
                out.append({"part": r["part"], "block": r["block"], name: value})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("block", pa.int32()), (name, pa.list_(pa.int64()) if name == "behind" else pa.int64())]))

    return run


def _behind(r: dict, end: np.ndarray) -> tuple[list[int], np.ndarray]:
    return end.tolist(), (np.array(r["costs"]).reshape(4, 4) + end).min(axis=1)


def _solved(b: pa.RecordBatch, entries: int) -> Iterator[tuple[dict, tuple]]:
    """Each block with the edits from its entry state, or from each of four."""
    for r in b.to_pylist():
        initial, cut, lead = np.frombuffer(r["initial"], np.uint8), np.frombuffer(r["cut"], np.uint8), np.array(r["lead"], np.int64)
        size = len(initial)
        cost = costs_to_go(np.array([0, size]), initial, cut, np.array([r["behind"]]))
        entry = np.arange(4) if entries == 4 else np.array([r["entry"]])
        yield r, walk(np.arange(entries + 1) * size, np.tile(initial, entries), np.tile(cut, entries), np.tile(lead, entries), np.tile(cost, (entries, 1)), entry)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r, (*_, state) in _solved(b, 4):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "block": pa.array([r["block"]], pa.int32()), "exits": pa.array([state.tolist()], pa.list_(pa.int64()))})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits and lines of each block; those that close a conversation are added behind its last one."""
    for b in batches:
        for r, (seq, code, times, row, after, _) in _solved(b, 1):
            of, kind, role, text = _lines(seq, code, row, after, pa.array(r["roles"], pa.string()), pa.array(r["texts"], pa.string()))
            letters = "".join(map(chr, kind))
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "block": pa.array([r["block"]], pa.int32()), "audit": [_edits(1, seq, code, times)[0] + "D" * r["tail"]], "edits": [letters], "role": pa.array([role.to_pylist()], pa.list_(pa.string())), "text": pa.array([text.to_pylist()], pa.list_(pa.string()))})


def _finished(turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks in order to conversations: one digest runs through the lines of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def emit(letters: str, roles: list[str], texts: list[str]) -> pa.RecordBatch:
            at = pa.array(range(now["lines"], now["lines"] + len(roles)), pa.int64())
            for role, text in zip(roles, texts, strict=True):
                now["hash"].update(("\n" if now["lines"] else "").encode() + f"{role}:{text}".encode())
                now["lines"] += 1
            return pa.RecordBatch.from_arrays([pa.array([now["conv"]] * len(roles), now["type"]), at, pa.array(list(letters), pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv", "position", "edit", "role", "text"])

        def close() -> pa.RecordBatch:
            more = [["user", "assistant"], ["assistant"]][now["state"] - 1] if now["state"] in (1, 2) else []
            last = emit("I" * len(more), more, [""] * len(more))
            if turns:
                return last
            values = [now[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            return pa.RecordBatch.from_arrays([pa.array([now["conv"]], now["type"]), *(pa.array([v], pa.int64()) for v in values), pa.array(["".join(now["audit"]) + "I" * len(more)], pa.string()), pa.array([now["hash"].hexdigest()])], names=["conv", *(f.split()[0] for f in SUMMARY.split(", "))])

        for b in batches:
            kind = b.schema.field("conv").type
            for r in b.to_pylist():
                if now is None or r["conv"] != now["conv"]:
                    if now is not None:
                        yield close()
                    now = {"conv": r["conv"], "type": kind, "hash": hashlib.sha256(), "lines": 0, "audit": [], "gaps": r["gaps"], "cost": min(c + e for c, e in zip(r["costs"][:4], r["behind"], strict=True)), "initial": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                for k in ("blank", "duplicate", "truncated"):
                    now[k] += r[k]
                now["cost"] += DELETE * r["forced"]
                now["illegal"] += r["pairs"] + (now["initial"] is not None and bool(_bad_pairs(np.array([now["initial"], r["start_initial"]]))[1]))
                now |= {"initial": r["end_initial"], "state": r["exits"][r["entry"]]}
                now["audit"].append(r["audit"])
                lines = emit(r["edits"], r["role"], r["text"])
                if turns:
                    yield lines
        if now is not None:
            yield close()

    return frugal(run)


def _large(rows: DataFrame, conv: str, turns: bool, most_rows: int, most_bytes: int) -> DataFrame:
    """The same for conversations of any length: equal rows are counted, the others dealt by order to blocks."""
    same = rows.where("present").groupBy("conv", "turn", "role", "text", "blank", "cut", "initial").agg(F.count("*").alias("n"))
    same = same.withColumns({"key": F.sha2("text", 256), "order": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    least = same.groupBy("conv", "role", "key").agg(F.min("order").alias("first"))
    marked = same.alias("a").join(least.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.key") == F.col("b.key")))
    marked = marked.select("a.conv", "turn", "a.role", "text", "blank", "cut", "initial", "n", F.expr("`order` <=> `first`").alias("new"))
    dealt = marked.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    blocks = written(dealt.mapInArrow(_blocks(most_rows, most_bytes), BLOCK.format(conv)), "repair-blocks")
    small = [c for c in blocks.columns if c not in ("roles", "texts")]
    at = ["part", "block"]
    falling = blocks.select("conv", *at, "costs").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    behind = written(falling.mapInArrow(_streamed("behind", LAST.copy, _behind), "part int, block int, behind array<long>"), "repair-behind")
    exits = written(blocks.select(*small).join(behind, at).mapInArrow(_exits, "part int, block int, exits array<long>"), "repair-exits")
    rising = blocks.select("conv", *at).join(exits, at).repartition("conv").sortWithinPartitions("conv", *at)
    entries = rising.mapInArrow(_streamed("entry", lambda: 0, lambda r, state: (state, r["exits"][state])), "part int, block int, entry long")
    known = written(behind.join(exits, at).join(entries, at), "repair-entries")
    pieces = blocks.join(known, at).mapInArrow(frugal(_pieces), "part int, block int, audit string, edits string, role array<string>, text array<string>")
    turn = F.col("turn")
    gaps = rows.where("present").groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    facts = blocks.select("conv", *at, "start_initial", "end_initial", "pairs", "blank", "duplicate", "truncated", "forced", "costs").join(known, at)
    facts = facts.alias("f").join(gaps.alias("g"), F.col("f.conv").eqNullSafe(F.col("g.conv"))).select("f.*", "gaps")
    ordered = facts.join(pieces, at).repartition("conv").sortWithinPartitions("conv", *at)
    return ordered.mapInArrow(_finished(turns), f"conv {conv}, {TURNS if turns else SUMMARY}")


def _repair(conversations: DataFrame, turns: bool, conv: str, turn: str, role: str, text: str, present: Column | None, most_rows: int, most_bytes: int) -> DataFrame:
    kind = conversations.schema[conv].dataType.simpleString()
    words, speaker = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), speaker.alias("role"), words.alias("text"), (F.lit(True) if present is None else present).alias("present"))
    rows = rows.withColumns({
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "cut": ~F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?"),
        "initial": F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3),
    })
    size = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("present").alias("some"))
    long = written(size.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).where("some").select("conv"), "repair-long")
    done, order = rows, ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    above = long.count()
    if above:
        done = without(rows, long, {"conv": F.col("conv")}, "repair-gone")
    out = done.repartition("conv").sortWithinPartitions(*order).mapInArrow(_small(turns), f"conv {kind}, {TURNS if turns else SUMMARY}")
    if above:
        names = long.withColumnRenamed("conv", "long_conv")
        large = rows.join(F.broadcast(names) if above <= 1_000_000 else names, F.col("conv").eqNullSafe(F.col("long_conv")), "left_semi")
        out = out.unionByName(_large(large, kind, turns, most_rows, most_bytes))
    return out.withColumnRenamed("conv", conv)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, most_rows: int = 4096, most_bytes: int = 4_000_000) -> DataFrame:
    """A row a conversation: its gaps and faults, the cost and initials of the cheapest edits, and the SHA-256 of the
    repaired `role:text` lines.

    Rows go by turn (nulls first), those of one turn by role and text. Null roles and texts are one space, so they are
    blank; null conversation ids are one conversation; repeated rows are duplicates. `present` marks the rows that count:
    a conversation of none has zeros, no edits and the hash of nothing. Very long texts are read whole; conversations of
    over `most_rows` rows or `most_bytes` are worked on in blocks of that size, only their digest runs through one task
    (a SHA-256 has no other way). An empty table gives none; other columns are not read."""
    return _repair(conversations, False, conv, turn, role, text, present, most_rows, most_bytes)


def repaired_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, most_rows: int = 4096, most_bytes: int = 4_000_000) -> DataFrame:
    """The turns after the edits of repair(): conversation, position (from 0), edit (K, R or I), role, text.

    Inserted turns have empty texts; a conversation of which nothing is left has no row; the rest is as in repair()."""
    return _repair(conversations, True, conv, turn, role, text, present, most_rows, most_bytes)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations after the damage of the contract, by crc32 of `conv_id:turn` modulo 20: 0 drops the row (present is
    false then), 1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 sets the role user; nulls are
    read as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("code"))
    code = F.col("code")
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.explode(F.when(code == 0, F.array(F.lit(False))).when(code == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("present"))
