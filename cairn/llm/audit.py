"""How filters overlap: what each removes in every order in which they can be applied.

Five filters judge a document: A too few words, B too few different ones, C too many capitals, D any of some symbols,
E a text that a smaller id has. The first four are read off the bytes of Arrow buffers, many texts at once; from then on
only counts by the set of failed filters travel.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, _powers, frugal, mix, seeded_table, slices, text_bytes

FILTERS = "ABCDE"
#: Bytes of text that are taken at once, in whole documents; and in prefix sums, in any case.
SLICE = 2_000_000
#: Words up to so many bytes are compared eight bytes at a time, longer ones one by one.
SHORT = 256
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_START = np.ones(256, bool)  # of a code point
_START[128:192] = False
_BYTE = seeded_table(256, 41)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)


def counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, by prefix sums."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo in range(0, len(flags), SLICE):
        sums = np.concatenate([[0], np.cumsum(flags[lo : lo + SLICE])])
        out += np.diff(sums[np.clip(offsets - lo, 0, len(sums) - 1)])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of visible bytes; none reaches over two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_WHITE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[offsets] = True
    return np.flatnonzero(edge[:-1] & word), np.flatnonzero(edge[1:] & word) + 1


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from prefix sums over stretches of them."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        till = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, "right")))
        lo, hi = start[at], end[till - 1]
        power, inverse = _powers(int(hi - lo))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo])])
        out[at:till] = mix((sums[end[at:till] - lo] - sums[start[at:till] - lo]) * inverse[start[at:till] - lo])
        at = till
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of `size` bytes at a and at b are equal."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))
    equal = np.ones(len(a), bool)
    rest = np.flatnonzero(size <= SHORT)
    for k in range(0, SHORT, 8):
        if not len(rest):
            break
        mask = _MASK[np.minimum(size[rest] - k, 8)]
        equal[rest] &= (eights[a[rest] + k] & mask) == (eights[b[rest] + k] & mask)
        rest = rest[size[rest] > k + 8]
    for i in np.flatnonzero(size > SHORT):
        equal[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return equal


def distinct_words(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of different words of each text: hashes are sorted, equal ones verified byte by byte."""
    n = len(offsets) - 1
    text = np.searchsorted(offsets, start, "right") - 1
    keys = mix(hashed(data, start, end) ^ mix(text.astype(U64)))
    order = np.argsort(keys, kind="stable")
    alike = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[alike], order[alike + 1]
    size = end - start
    match = (text[a] == text[b]) & (size[a] == size[b])
    match[match] = same_bytes(data, start[a[match]], start[b[match]], size[a[match]])
    out = np.bincount(text, minlength=n) - np.bincount(text[a[match]], minlength=n)
    for t in np.unique(text[np.concatenate([a[~match], b[~match]])]):  # where two words share a hash
        own = slice(*np.searchsorted(text, [t, t + 1]))
        out[t] = len({data[s:e].tobytes() for s, e in zip(start[own], end[own], strict=True)})
    return out


def measured(docs: DataFrame, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, symbols: str = "#$%&*|", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row a document: id, part (null: empty), fails (bits 0 to 3 for A to D) and a 128-bit key of its text.

    Null texts are empty; words are runs of other characters than ASCII white space; whole texts count, however long
    (a word takes some 50 bytes while its text is read); repeated rows stay; an empty table gives none; other columns
    are not read."""
    symbol = np.zeros(256, bool)
    symbol[list(symbols.encode("ascii"))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, "t", SLICE):
                data, offsets = text_bytes(piece.column("t"))
                start, end = word_bounds(data, offsets)
                words = np.diff(np.searchsorted(start, offsets))
                judged = (
                    words < min_words,
                    100 * distinct_words(data, offsets, start, end) < distinct_percent * words,
                    100 * counted(_CAPITAL[data], offsets) > capital_percent * counted(_START[data], offsets),
                    counted(symbol[data], offsets) > 0,
                )
                fails = sum(f.astype(np.int32) << k for k, f in enumerate(judged))
                keys = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in itertools.pairwise(offsets)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("part"), pa.array(fails, pa.int32()), pa.array(keys, pa.binary())], names=["id", "part", "fails", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return frame.mapInArrow(frugal(run), f"id {kind}, part string, fails int, key binary")


def failures(found: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """Documents counted by part and set of failed filters (E is added here), with those of good and of toxic ones.

    found: what measured() returns. Rows are counted before they are dealt, so neither an id, nor a text, nor a part
    that many rows share meets in one task: a text's rows are told apart by part and label only when its least id is
    looked for. A null id has no smaller one, and is none to others; labels that repeat an id count once."""
    each = found.groupBy("id", "part", "fails", "key").agg(F.count("*").alias("n"))
    told = labels.groupBy(F.col(label_id).alias("label_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    joined = each.join(told, F.col("id") == F.col("label_id"), "left").select("id", "part", "fails", "key", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    texts = joined.groupBy("key", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    # a text has as many rows here as it has parts and labels
    first = F.min("least.id").over(Window.partitionBy("key"))
    kept = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("kept", kept)
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails"), F.col("kept").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **limits: int | str) -> DataFrame:
    """A row for each part, order of the filters and step: what is kept after it, removed there, removed earlier though
    failing there, failing nothing else, good and toxic documents removed there, and the filter's sum over all orders.

    All 120 orders of 5 filters come from one count by set of failed filters (32 a part): whoever fails k filters is
    removed by each of them in 120 / k orders. Rows without documents have zeros; a part is there if a document has it,
    so an empty table gives no rows. limits: as of measured(), which also says what nulls and long texts give."""
    counts = failures(measured(docs, **limits), labels)
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    steps = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda test: sum((F.when(test(place[f]), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})

    def total(what: str, test: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("sets", test), F.lit(0).cast("long"), lambda acc, s: acc + s[what])

    own, before = F.col("own"), F.col("before")
    has = lambda s, mask: s["fails"].bitwiseAND(mask) != 0
    here = lambda s: has(s, own) & ~has(s, before)
    share = F.aggregate(F.filter("sets", lambda s: has(s, own)), F.lit(0).cast("long"), lambda acc, s: acc + s["n"] * (F.lit(len(orders)) / F.bit_count(s["fails"])).cast("long"))
    return steps.select(
        "part", "filter_order", "step", total("n", lambda s: ~has(s, own.bitwiseOR(before))).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda s: has(s, own) & has(s, before)).alias("redundant"), total("n", lambda s: s["fails"] == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )
