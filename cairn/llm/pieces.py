"""SentencePiece segmentations: sampling without replacement by perturbed A-star search, and decoding.

A text's lattice holds every way to write it in vocabulary pieces. Pieces have log-probabilities; backward sums give
each subtree of partial segmentations its exact total. Adding Gumbel noise top-down (a subtree's noise is the maximum
of its children's) makes the k best perturbed leaves an exact sample of k distinct segmentations without replacement,
and makes the perturbed total of a subtree an exact bound: best-first search pops leaf after leaf in order.

As pieces never reach over the start of a run of spaces, nor between characters that stand side by side in no piece,
the lattice is a chain: a text is a chain of words, a word one of units. Distinct units are laid out once, in arrays that
a task keeps from slice to slice; a popped subtree runs down to its leaf for all documents at once, and the siblings
left beside its path join the agenda. Siblings deep in a text have negligible mass; they wait as one item with the
noise of their maximum and are split up only when popped. All noise is a hash of seed, row key and position.

The vocabulary file is of the BPE kind and has merge ranks, no probabilities; pieces get those of a Zipf-Mandelbrot
law of the rank, sharpened by `alpha`.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _BASE, frugal, give_back, mix, _powers, seeded_table, slices, text_bytes, uniform

U64 = np.uint64
np.seterr(over="ignore")  # hashes wrap around
_BYTE = seeded_table(256, 101)
SPACE = "▁"
SLICE = 1 << 18  # bytes of text drawn at a time
KEEP = 1 << 18  # bytes of distinct units beyond which a task starts its lattices anew; they take some 70 times that
LONG = 256  # bytes and steps up to which words go side by side; what is longer goes node by node
HEAD = 16  # nodes of a path whose siblings join the agenda one by one
C_SAMPLE, C_WORD, C_STEP, C_SIDE = (U64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def bytes_hash(piece: bytes) -> int:
    h, p = 0, 1
    for b in piece:
        h = (h + int(_BYTE[b]) * p) & (2**64 - 1)
        p = p * _BASE & (2**64 - 1)
    return h


class Table:
    """Numbers by 64-bit hashes, found by probing."""

    def __init__(self, bits: int) -> None:
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -2, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        if 2 * (self.used + len(hashes)) > 1 << self.bits:
            full = np.flatnonzero(self.values != -2)
            hashes, numbers = np.concatenate([self.keys[full], hashes]), np.concatenate([self.values[full], numbers])
            self._room((2 * len(hashes)).bit_length())
        self.used += len(hashes)
        at = self._slot(hashes)
        while len(hashes):
            free = np.flatnonzero(self.values[at] == -2)
            self.keys[at[free]], self.values[at[free]] = hashes[free], numbers[free]
            left = self.keys[at] != hashes  # the place is another's, maybe since just now
            hashes, numbers, at = hashes[left], numbers[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -2 where there is none."""
        at = self._slot(hashes)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != hashes) & (out != -2))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            here = out[todo] = self.values[at]
            go = (here != -2) & (self.keys[at] != hashes[todo])
            todo, at = todo[go], at[go]
        return out


class Vocabulary:
    """Pieces as bytes (spaces for the space mark) with scores, and a probing table of their hashes and prefixes."""

    def __init__(self, path: str, alpha: float = 0.5, shift: float = 2.7) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        raw = np.array([model.get_score(i) for i in range(n)])
        rank = np.where(raw > -1e8, -raw, 100.0)
        self.byte_id = np.zeros(256, np.int32)
        usable = []
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            elif model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                rank[i] = n
                self.bytes.append(bytes([b]))
            else:
                self.bytes.append(model.id_to_piece(i).replace(SPACE, " ").encode())
                usable.append(i)
        logs = -np.log(np.maximum(rank, 0) + shift)
        used = np.array([bool(b) for b in self.bytes])
        self.score = alpha * (logs - np.log(np.exp(logs[used]).sum()))
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.spelt = pa.array(self.bytes, pa.large_binary())
        entries: dict[int, int] = {}
        for i in usable:
            for cut in range(1, len(self.bytes[i])):
                entries.setdefault(bytes_hash(self.bytes[i][:cut]), -1)
        for i in usable:
            entries[bytes_hash(self.bytes[i])] = i
        pairs = {two for i in usable for two in itertools.pairwise(self.bytes[i].decode())}
        self.pairs = np.sort(np.array([bytes_hash("".join(two).encode()) for two in pairs], U64))
        self.joined = np.zeros(1 << 16, bool)  # by the bytes on either side: whether a piece may reach from one to the other
        self.joined[[a.encode()[-1] << 8 | b.encode()[0] for a, b in pairs]] = True
        self.table = Table(19)
        self.table.add(np.array(list(entries), U64), np.array(list(entries.values()), np.int64))
        self.one = self.find(_BYTE)  # by a byte
        self.two = self.find((_BYTE[:, None] + _BYTE * U64(_BASE)).ravel())  # by two

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id, -1: only a prefix of pieces, -2: neither."""
        return self.table.find(hashes)


@functools.lru_cache(4)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.room, self.used = np.empty(KEEP, kind), 0

    def add(self, more: np.ndarray) -> np.ndarray:
        """Appends; returns all there is."""
        end = self.used + len(more)
        if end > len(self.room):
            wider = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            wider[: self.used] = self.room[: self.used]
            self.room = wider
        self.room[self.used : end] = more
        self.used = end
        return self.room[:end]


class Lattices:
    """Lattices of the distinct units met so far, edges sorted by source node; a unit of m bytes has nodes base .. base + m."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.known = Table(16)
        kinds = {"base": np.int64, "end": np.int64, "text": np.uint8, "first": np.int64, "src": np.int32, "dst": np.int32, "piece": np.int32, "closes": bool, "logp": np.float64, "stop": np.float64}
        self.columns = {name: Column(kind) for name, kind in kinds.items()}
        self._append(**{name: np.zeros(int(name == "first"), kind) for name, kind in kinds.items()})

    def _append(self, **more: np.ndarray) -> None:
        for name, values in more.items():
            setattr(self, name, self.columns[name].add(values))

    def kinds_of(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of units, given by the hashes of their bytes; those not met before are laid out."""
        kinds = self.known.find(names)
        new = np.flatnonzero(kinds < 0)
        if len(new):
            distinct, example, of = np.unique(names[new], return_index=True, return_inverse=True)
            before, example = len(self.base), new[example]
            self._lay_out(data, starts[example], sizes[example])
            self.known.add(distinct, np.arange(before, len(self.base)))
            kinds[new] = before + of
        return kinds

    def _lay_out(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        vocab, n_words, total = self.vocab, len(starts), int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        text = data[np.repeat(starts - first, sizes) + np.arange(total)]
        left = np.repeat((first + sizes).astype(np.int32), sizes) - np.arange(total, dtype=np.int32)
        power, inverse = _powers(total)
        cum = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[text] * power[:total])])
        boundary = np.ones(total + 1, bool)
        boundary[:-1] = (text & 0xC0) != 0x80
        boundary[first] = True
        at_lead = np.flatnonzero(boundary[:-1])
        char = np.diff(at_lead, append=total)
        found: list[tuple[np.ndarray, np.ndarray | int, np.ndarray | int]] = []  # edges by length: sources, sizes, pieces
        known = np.zeros(total, np.int8)
        alive, length = at_lead, 0
        while len(alive):
            length += 1
            if length == 1:
                got = vocab.one[text[alive]]
            elif length == 2:
                got = vocab.two[text[alive].astype(np.int64) << 8 | text[alive + 1]]
            else:
                got = vocab.find((cum[alive + length] - cum[alive]) * inverse[alive])
            hit = np.flatnonzero((got >= 0) & boundary[alive + length])
            at = alive[hit]
            found.append((at, length, got[hit]))
            if length < 5:
                known[at] |= 1 << length
            alive = alive[(got > -2) & (left[alive] > length)]
        lost = np.flatnonzero((char > 4) | (known[at_lead] >> np.minimum(char, 4) & 1 == 0))
        found.append((at_lead[lost], char[lost], -1))
        each = np.zeros(total + 1, np.int64)
        for at, _, _ in found:
            each[at] += 1
        place = np.cumsum(each) - each
        opens, count = place.copy(), each[:-1]
        edges = int(place[-1])
        size, piece = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for a, n, p in reversed(found):  # longer pieces first: they are likelier
            put = place[a]
            size[put], piece[put] = n, p
            place[a] += 1
        score = vocab.score[piece]
        lost = np.flatnonzero(piece < 0)
        at = np.repeat(np.arange(total, dtype=np.int32), count)
        byte_sum = np.concatenate([[0.0], np.cumsum(vocab.score[vocab.byte_id[text]])])
        score[lost] = byte_sum[at[lost] + size[lost]] - byte_sum[at[lost]]
        del found, known, cum, byte_sum, alive, got, place, each
        src = at + np.repeat(np.arange(n_words, dtype=np.int32), sizes)[at]
        dst = src + size
        base = first + np.arange(n_words)
        end, nodes = base + sizes, total + n_words
        first = np.repeat(edges, nodes + 1)
        inner = np.ones(nodes, bool)
        inner[end] = False
        inner = np.flatnonzero(inner)
        first[inner] = opens[:-1]
        first[end] = opens[base + sizes - np.arange(n_words)]
        beta = np.full(nodes, -np.inf)
        beta[end] = 0.0
        self._back(beta, src, dst, score, np.minimum(left[at], LONG + 1).astype(np.uint16))
        for w in np.flatnonzero(sizes > LONG).tolist():
            _far_back(beta, first, dst, int(base[w]), int(end[w]), score)
        with np.errstate(invalid="ignore"):
            logp = score + beta[dst] - beta[src]
        logp[~np.isfinite(logp)] = -np.inf
        stop = np.exp(logp)
        node = np.flatnonzero(first[1:] > first[:-1])
        here, behind = first[node], first[node + 1]
        while len(here):
            more = here + 1 < behind
            here, behind = here[more] + 1, behind[more]
            stop[here] += stop[here - 1]
        with np.errstate(invalid="ignore"):
            stop /= np.repeat(stop[first[node + 1] - 1], first[node + 1] - first[node])
        spelt = np.zeros(nodes, np.uint8)
        spelt[inner] = text
        ended = np.zeros(nodes, bool)
        ended[end] = True
        above, before = len(self.text), len(self.src)
        self._append(base=base + above, end=end + above, text=spelt, first=first[1:] + before, src=src + np.int32(above), dst=dst + np.int32(above), piece=piece, closes=ended[dst], logp=logp, stop=stop)

    def _back(self, beta: np.ndarray, src: np.ndarray, dst: np.ndarray, score: np.ndarray, height: np.ndarray) -> None:
        """Backward sums of all nodes up to LONG from their ends, side by side: the nearest first."""
        order = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[order], np.arange(1, LONG + 2))
        order = order[: cuts[-1]]
        if not len(order):
            return
        node, to, value = src[order], dst[order], score[order]
        opens = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count, node = np.diff(opens, append=len(order)), node[opens]
        groups = np.searchsorted(opens, cuts)
        for s, e, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if s == e:
                continue
            got = value[s:e] + beta[to[s:e]]
            start = opens[a:b] - s
            top = np.maximum.reduceat(got, start)
            safe = np.where(np.isfinite(top), top, 0.0)
            got -= np.repeat(safe, count[a:b])
            with np.errstate(divide="ignore"):
                beta[node[a:b]] = safe + np.log(np.add.reduceat(np.exp(got), start))

    def walk(self, node: int, end: int, u: np.ndarray) -> list[int]:
        """The edges of a path from node to its unit's end, drawn like step(), one by one."""
        first = self.first[node : end + 1].tolist()
        lo = first[0]
        stop, to = self.stop[lo : first[-1]].tolist(), (self.dst[lo : first[-1]] - node).tolist()
        at, last, out = 0, end - node, []
        for x in u.tolist():
            if at >= last:
                break
            e = bisect.bisect_left(stop, x, first[at] - lo, first[at + 1] - 1 - lo)
            out.append(lo + e)
            at = to[e]
        return out

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, in proportion to its probability."""
        edge = self.first[node]
        todo = np.flatnonzero(self.stop[edge] < u)
        while len(todo):
            here = edge[todo] + 1
            edge[todo] = here
            todo = todo[self.stop[here] < u[todo]]
        return edge


def _far_back(beta: np.ndarray, opens: np.ndarray, dst: np.ndarray, base: int, end: int, score: np.ndarray) -> None:
    """Backward sums of a long unit's nodes that lie further than LONG from its end, one by one."""
    last = end - LONG
    first = opens[base : last + 1].tolist()
    lo = first[0]
    values, to = score[lo : first[-1]].tolist(), (dst[lo : first[-1]] - base).tolist()
    sums = beta[base : end + 1].tolist()
    for node in range(last - base - 1, -1, -1):
        got = [values[e - lo] + sums[to[e - lo]] for e in range(first[node], first[node + 1])]
        top = max(got, default=-math.inf)
        if top > -math.inf:
            sums[node] = top + math.log(sum([math.exp(x - top) for x in got]))
    beta[base:last] = sums[: last - base]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of words (a run of spaces and what follows up to the next), and each text's word offsets."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    s = np.flatnonzero(start)
    return s, np.diff(np.concatenate([s, [len(data)]])), np.searchsorted(s, offsets)


def cut_long_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, cum: np.ndarray, inverse: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Starts of words, long ones cut wherever no piece holds the two neighbouring characters: no piece crosses there."""
    long = np.flatnonzero(size > 64)
    if not len(long):
        return start
    first = np.cumsum(size[long]) - size[long]
    at = np.repeat(start[long] - first, size[long]) + np.arange(int(size[long].sum()))
    lead = (data[at] & 0xC0) != 0x80
    owner = np.repeat(np.arange(len(long)), size[long])[lead]
    at = at[lead]
    same = owner[1:] == owner[:-1]
    before, here = at[:-1][same], at[1:][same]
    byte = data[here]
    ends = np.minimum(here + 1 + (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0), len(data))
    two = (cum[ends] - cum[before]) * inverse[before]
    found = np.minimum(np.searchsorted(vocab.pairs, two), len(vocab.pairs) - 1)
    return np.union1d(start, here[vocab.pairs[found] != two])


def units_of(data: np.ndarray, start: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Starts of units: of words, and inside them wherever no piece holds the two bytes around."""
    begins = np.zeros(len(data), bool)
    begins[1:] = ~vocab.joined[data[:-1].astype(np.uint16) << 8 | data[1:]]
    begins &= (data & 0xC0) != 0x80
    begins[start] = True
    return np.flatnonzero(begins)


class Batch:
    """Samples of a batch of texts (with the leading space already in place)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocab: Vocabulary, lattices: Lattices) -> None:
        self.vocab, self.keys, self.lattice = vocab, keys, lattices
        start, size, self.words = words_of(data, offsets)
        power, inverse = _powers(len(data))
        cum = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * power[: len(data)])])
        cut = cut_long_words(data, start, size, cum, inverse, vocab)
        if len(cut) > len(start):
            start, self.words = cut, np.searchsorted(cut, offsets)
        unit = units_of(data, start, vocab)
        size = np.diff(unit, append=len(data))
        name = mix((cum[unit + size] - cum[unit]) * inverse[unit] + size.astype(U64))
        self.kind = lattices.kinds_of(name, data, unit, size)
        self.units = np.append(np.searchsorted(unit, start), len(unit))  # the first unit of each word
        self.opens = self.units[self.words]  # and of each text
        self.word = np.append(np.repeat(np.arange(len(start)), np.diff(self.units)), len(start))
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.words))
        self.nth = np.arange(len(start)) - self.words[:-1][self.doc]

    def run_down(self, sample: int, from_unit: np.ndarray, from_node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fresh paths from unit from_unit[d] of each text at node from_node[d] (-1: its start) to the text's end; docs
        with from_unit < 0 take no part. Returns edges in order, and each text's edge offsets."""
        x = self.lattice
        begin_unit = np.where(from_unit < 0, self.opens[1:], self.opens[:-1] + np.maximum(from_unit, 0))
        begin = self.word[begin_unit]
        count = self.words[1:] - begin
        head = np.cumsum(count) - count
        who = np.repeat(begin - head, count) + np.arange(int(count.sum()))
        unit, last = self.units[who], self.units[who + 1] - 1
        some = np.flatnonzero(count > 0)
        unit[head[some]] = begin_unit[some]
        node = x.base[self.kind[unit]]
        some = some[from_node[some] >= 0]
        node[head[some]] = from_node[some]
        seed = self.keys[self.doc[who]] + C_SAMPLE * U64(sample + 1) + C_WORD * self.nth[who].astype(U64)
        at, each, got, slot, step = np.arange(len(who)), np.zeros(len(who), np.int64), [], [], 0
        while len(at) and step < LONG:
            edge = x.step(node, uniform(mix(seed + C_STEP * U64(step))))
            got.append(edge)
            slot.append(at)
            step += 1
            node = x.dst[edge]
            closed = np.flatnonzero(x.closes[edge])
            word = at[closed]
            over = unit[word] == last[word]
            on = word[~over]
            unit[on] += 1
            node[closed[~over]] = x.base[self.kind[unit[on]]]
            each[word[over]] = step
            stays = np.ones(len(at), bool)
            stays[closed[over]] = False
            at, node, seed = at[stays], node[stays], seed[stays]
        far = [(a, self._walk(int(unit[a]), int(last[a]), n, z, step)) for a, n, z in zip(at.tolist(), node.tolist(), seed, strict=True)]
        for a, more in far:
            each[a] = step + len(more)
        place = np.cumsum(each) - each
        edge = np.empty(int(each.sum()), np.int64)
        for n, (a, e) in enumerate(zip(slot, got, strict=True)):
            edge[place[a] + n] = e
        for a, more in far:
            edge[place[a] + step : place[a] + step + len(more)] = more
        before = np.concatenate([[0], np.cumsum(each)])
        return edge, before[np.concatenate([[0], np.cumsum(count)])]

    def _walk(self, unit: int, last: int, node: int, seed: U64, step: int) -> list[int]:
        """The edges from a node of a unit to the end of the word whose last unit is `last`, one by one."""
        x, out = self.lattice, []
        kinds = self.kind[unit : last + 1].tolist()
        most = int(x.end[kinds].sum() - x.base[kinds].sum())
        u = uniform(mix(seed + C_STEP * np.arange(step, step + most, dtype=U64)))
        for n, kind in enumerate(kinds):
            out += x.walk(int(x.base[kind]) if n else node, int(x.end[kind]), u[len(out) :])
        return out

    def draw(self, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text up to k (edges, log-probability, log inclusion score), best perturbed first."""
        x, docs = self.lattice, len(self.words) - 1
        agenda: list[list] = [[] for _ in range(docs)]
        paths: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in range(docs)]
        noise = -np.log(-np.log(uniform(mix(self.keys + C_SIDE))))
        from_unit, from_node = np.zeros(docs, np.int64), np.full(docs, -1, np.int64)
        popped: list = [(g, -1, 0, -1) for g in noise.tolist()]
        for sample in range(k):
            edge, at = self.run_down(sample, from_unit, from_node)
            logs, at = x.logp[edge], at.tolist()
            active = [d for d in range(docs) if popped[d] is not None]
            starts = []
            for d in active:
                g, parent, cut, first = popped[d]
                s, e = at[d], at[d + 1]
                if parent < 0:
                    paths[d].append((edge[s:e], logs[s:e], g))
                    starts.append(0)
                else:
                    old, old_lp, _ = paths[d][parent]
                    paths[d].append((np.concatenate([old[:cut], [first], edge[s:e]]), np.concatenate([old_lp[:cut], x.logp[[first]], logs[s:e]]), g))
                    starts.append(cut + 1)
            self._beside(agenda, paths, active, starts, k - sample)
            if sample + 1 == k:
                break
            from_unit, from_node = np.full(docs, -1, np.int64), np.full(docs, -1, np.int64)
            for d in range(docs):
                popped[d] = None
                while agenda[d]:
                    g, parent, cut, first = heapq.heappop(agenda[d])
                    if first < 0:
                        self._beside(agenda, paths, [d], [cut], k - sample, number=parent, maximum=-g)
                        continue
                    popped[d] = (-g, parent, cut, first)
                    closed = bool(x.closes[first])
                    from_unit[d] = np.count_nonzero(x.closes[paths[d][parent][0][:cut]]) + closed
                    from_node[d] = -1 if closed else x.dst[first]
                    break
        out = []
        for d in range(docs):
            kappa = -agenda[d][0][0] if agenda[d] else -np.inf
            got = []
            for path, lp, _ in paths[d]:
                total = float(lp.sum())
                gap = total - kappa
                inclusion = 0.0 if gap > 30 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))
                got.append((path, total, inclusion))
            out.append(got)
        return out

    def _beside(self, agenda: list[list], paths: list[list], docs: list[int], starts: list[int], wanted: int, number: int | None = None, maximum: float | None = None) -> None:
        """Puts the siblings beside nodes start .. start + HEAD of each text's newest path (or path `number`) on its
        agenda, and the rest of that path's siblings as one item. All their noise is under the path's; with `maximum`
        they come from such an item that was popped, and their maximum is that. Of one call, only the `wanted` + 1
        largest can be popped or be the score behind the last sample, so only those are put there."""
        x = self.lattice
        chosen = [paths[d][-1 if number is None else number] for d in docs]
        parts = [p[0][s : s + HEAD] for p, s in zip(chosen, starts, strict=True)]
        size = np.array([len(p) for p in parts], np.int64)
        if not size.sum():
            return
        path, lp = np.concatenate(parts), np.concatenate([p[1][s : s + HEAD] for p, s in zip(chosen, starts, strict=True)])
        owner = np.repeat(np.arange(len(docs)), size)
        opens = np.cumsum(size) - size
        prefix = np.array([float(p[1][:s].sum()) for p, s in zip(chosen, starts, strict=True)])
        rest = np.array([float(p[1][s + HEAD :].sum()) for p, s in zip(chosen, starts, strict=True)])
        cum = np.concatenate([[0.0], np.cumsum(lp)])
        before = prefix[owner] + cum[:-1] - cum[opens][owner]
        low = x.first[x.src[path]]
        count = x.first[x.src[path] + 1] - low
        spread = np.cumsum(count) - count
        edges = np.repeat(low - spread, count) + np.arange(int(count.sum()))
        node = np.repeat(np.arange(len(path)), count)
        keep = (edges != path[node]) & np.isfinite(x.logp[edges])
        edges, node = edges[keep], node[keep]
        where = before[node] + x.logp[edges]
        who, cut = owner[node], np.array(starts, np.int64)[owner[node]] + node - opens[owner[node]]
        tail = np.flatnonzero(rest < 0)
        with np.errstate(divide="ignore"):
            where = np.concatenate([where, prefix[tail] + cum[(opens + size)[tail]] - cum[opens[tail]] + np.log(-np.expm1(rest[tail]))])
        who, cut = np.concatenate([who, tail]), np.concatenate([cut, np.array(starts, np.int64)[tail] + HEAD])
        edges = np.concatenate([edges, np.full(len(tail), -1)])
        if not len(where):
            return
        keys = self.keys[np.array(docs)][who] + C_SIDE * np.array([len(paths[d]) + 1 if number is None else number + 1001 for d in docs], U64)[who]
        u = uniform(mix(keys + C_WORD * cut.astype(U64) + C_STEP * (edges - x.first[x.src[np.maximum(edges, 0)]] + 2).astype(U64) * (edges >= 0) + C_SAMPLE * U64(77)))
        g = np.array([p[2] for p in chosen])[who] if maximum is None else np.full(len(who), maximum)
        with np.errstate(over="ignore"):
            noise = where - np.log(np.exp(where - g) - np.log(u))
        if maximum is not None:
            weight = np.exp(where - where.max())
            spin = uniform(mix(keys[:1] + C_WORD * U64(starts[0] + 1) + C_STEP))[0]
            noise[min(int(np.searchsorted(np.cumsum(weight), spin * weight.sum())), len(where) - 1)] = maximum
        order = np.lexsort((-noise, who))
        first = np.flatnonzero(np.concatenate([[True], who[order][1:] != who[order][:-1]]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
        order = order[rank <= wanted]
        path_of = [len(paths[d]) - 1 if number is None else number for d in docs]
        for i, v, c, e in zip(who[order].tolist(), noise[order].tolist(), cut[order].tolist(), edges[order].tolist(), strict=True):
            heapq.heappush(agenda[docs[i]], (-v, path_of[i], c, e))

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, characters outside the vocabulary as bytes; and how many each edge gives."""
        x = self.lattice
        piece = x.piece[edges]
        count = np.ones(len(edges), np.int64)
        lost = np.flatnonzero(piece < 0)
        if not len(lost):
            return piece, count
        size = (x.dst[edges[lost]] - x.src[edges[lost]]).astype(np.int64)
        count[lost] = size
        out = np.repeat(piece, count)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        opens = (np.cumsum(count) - count)[lost]
        out[np.repeat(opens, size) + inner] = self.vocab.byte_id[x.text[np.repeat(x.src[edges[lost]], size) + inner]]
        return out, count


def decode_bytes(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The bytes that ids spell, the leading space still in place."""
    return text_bytes(vocab.spelt.take(pa.array(ids)))[0]


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every non-empty text."""
    real = offsets[:-1][np.diff(offsets) > 0]
    moved = np.insert(data, real, 32)
    return moved, offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


def encode_batch(texts: pa.Array, keys: np.ndarray, vocab: Vocabulary, samples: int, lattices: Lattices | None = None) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list[float], list[float], list[bool]]:
    """Rows of (text index, sample number), flat ids with offsets, log-probabilities, inclusion scores, round trips."""
    data, offsets = with_space(*text_bytes(texts))
    rows, numbers, probs, inclusions, whole = [], [], [], [], []
    if not len(data):
        return list(range(len(texts))), [1] * len(texts), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
    batch = Batch(data, offsets, keys, vocab, lattices or Lattices(vocab))
    drawn = batch.draw(samples)
    edges, counts = [], []
    for d, got in enumerate(drawn):
        if not got:
            got = [(np.zeros(0, np.int64), 0.0, 0.0)]
        for n, (path, p, q) in enumerate(got):
            rows.append(d)
            numbers.append(n + 1)
            probs.append(p)
            inclusions.append(q)
            edges.append(path)
            counts.append(len(path))
    flat, each = batch.ids(np.concatenate(edges).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    spelt = decode_bytes(flat, vocab)
    size = np.concatenate([[0], np.cumsum(vocab.length[flat])])[ends]
    for r, d in enumerate(rows):
        whole.append(np.array_equal(spelt[size[r] : size[r + 1]], data[offsets[d] : offsets[d + 1]]))
    return rows, numbers, flat, ends, probs, inclusions, whole


def encode(docs: DataFrame, model_path: str, samples: int = 2, alpha: float = 0.5, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`samples` distinct sampled segmentations of every text, drawn without replacement.

    Returns id, sample (1: highest perturbed), ids, n_pieces, log_prob, log_inclusion (log of the probability of being
    among the samples given the rest), round_trip (ids decode to the text). Fewer rows only where a text has
    fewer segmentations; an empty text has one, without pieces; a null text one with null ids. Equal ids (and
    null ones) draw alike; repeated rows each give rows; an empty table gives none. Whole texts of any length are
    encoded; other columns are not read. `model_path` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path, alpha)
        lattices = Lattices(vocab)
        for b in batches:
            for part in slices(b, "t", SLICE):
                texts = part.column("t")
                keys = mix(np.asarray(part.column("key")).astype(np.int64).view(U64))
                if len(lattices.text) > KEEP:
                    lattices = Lattices(vocab)
                    give_back()  # not after every slice: touching the memory anew takes a fifth of the time
                rows, numbers, flat, ends, probs, inclusions, whole = encode_batch(texts, keys, vocab, samples, lattices)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                null = np.asarray(part.column("empty"))[rows]
                if null.any():
                    lists = pa.array([None if z else x for x, z in zip(lists.to_pylist(), null, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), lists, pa.array(np.diff(ends)), pa.array(probs), pa.array(inclusions), pa.array(whole)],
                    names=[id_col, "sample", "ids", "n_pieces", "log_prob", "log_inclusion", "round_trip"],
                )

    text = F.col(text_col).cast("string")
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("key"), text.isNull().alias("empty"), F.coalesce(text, F.lit("")).alias("t"))
    return frame.mapInArrow(frugal(run), f"`{id_col}` long, sample int, ids array<int>, n_pieces long, log_prob double, log_inclusion double, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with `text`, what its ids spell; null ids give null, no ids the empty text; broken UTF-8 is replaced.

    Repeated rows give repeated rows, an empty table none; other columns stay, but a column `text` is replaced."""
    columns = [c for c in encoded.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path, 1.0)
        for b in batches:
            texts = [None if x is None else bytes(decode_bytes(np.array(x, np.int64), vocab)[1:]).decode("utf-8", "replace") for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.select(*columns).mapInArrow(frugal(run), f"{fields}, text string")
