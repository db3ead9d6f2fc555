"""N-gram Jaccard join with Bayesian pruning of MinHash candidates and exact verification.

1. Every document becomes a MinHash signature of its set of word n-grams; equal texts form one class.
2. Classes that agree on a band of the signature meet in that band's bucket; buckets of equal membership are merged,
   large buckets are cut into chunks, and each pair of chunks is one unit of work.
3. Within a unit, a pair counts only in its lowest common band. Its MinHash values are compared a few at a time, and
   it is dropped once the posterior probability of a similarity at or over the threshold falls below the tolerance.
4. Pairs that are left travel packed; their n-gram sets are fetched and compared exactly. What leaves a unit is one
   row a class: its number of linked documents and the root of its tree of links, never the pairs themselves.
5. Trees merge into connected components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, frugal, give_back, mix, seeded_table, slices, text_bytes, without, word_hashes, written

U64 = np.uint64
_SPREAD = seeded_table(64, 23) | U64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's n-grams of words, with offsets; a text of fewer words has one n-gram of all."""
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    if not len(words):
        return words, np.zeros(len(offsets), np.int64)
    grams = np.zeros(len(words), U64)
    for k in range(n):
        grams[: len(words) - k] += words[k:] * _SPREAD[k]
    left = np.repeat(at[1:], count) - np.arange(len(words))
    keep = left >= n
    for d in np.flatnonzero((count > 0) & (count < n)):
        grams[at[d]] = np.add.reduce(words[at[d] : at[d + 1]] * _SPREAD[: count[d]]) + U64(count[d])
        keep[at[d]] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return mix(grams[keep]), ends[at]


def signatures(grams: np.ndarray, offsets: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """MinHash values, documents x size, of non-empty documents (empty ones keep the largest value)."""
    out = np.full((len(offsets) - 1, size), 0xFFFFFFFF, np.uint32)
    real = np.flatnonzero(np.diff(offsets) > 0)
    if not len(real):
        return out
    a, b = seeded_table(size, seed) | U64(1), seeded_table(size, seed + 1)
    starts = offsets[:-1][real]
    for k in range(size):
        values = ((grams * a[k] + b[k]) >> U64(32)).astype(np.uint32)
        out[real, k] = np.minimum.reduceat(values, starts)
    return out


def least_matches(step: int, size: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): below, P(similarity >= threshold | matches) < tolerance.

    Under a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    out = []
    for n in range(step, size + 1, step):
        total, m = 0.0, -1
        while total < tolerance and m <= n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _pairs(bucket: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) that share a bucket, batch by batch. Side 2: a unit of one chunk; 0 and 1: across two."""
    n = len(bucket)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.diff(edge)
    small = np.repeat(size <= 48, size)
    index = np.flatnonzero(small)
    for d in range(1, 48):
        a = index[index + d < n]
        a = a[bucket[a] == bucket[a + d]]
        if not len(a):
            break
        index = a
        ok = (side[a] == 2) | (side[a] != side[a + d])
        yield a[ok], a[ok] + d
    for s, m in zip(edge[:-1][size > 48], size[size > 48], strict=True):
        for i in range(s, s + m - 1):
            b = np.arange(i + 1, s + m)
            if side[i] != 2:
                b = b[side[b] != side[i]]
            yield np.full(len(b), i), b


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []
    n = 0
    for a, b in parts:
        held.append((a, b))
        n += len(a)
        if n >= at_least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def prune(a: np.ndarray, b: np.ndarray, band: np.ndarray, sig: np.ndarray, rows: int, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose lowest common band is the bucket's and that survive the incremental comparison."""
    matches, last = np.zeros(len(a), np.int32), 0
    for n, fewest in steps:
        same = sig[a, last:n] == sig[b, last:n]
        matches += same.sum(1, dtype=np.int32)
        whole = same.reshape(len(a), (n - last) // rows, rows).all(2)
        bands = np.arange(last // rows, n // rows)
        earlier = (whole & (bands[None, :] < band[a][:, None])).any(1)
        keep = (matches >= fewest) & ~earlier
        a, b, matches, last = a[keep], b[keep], matches[keep], n
    return a, b


def verify(a: np.ndarray, b: np.ndarray, grams: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's sets (sorted distinct n-gram hashes) have a Jaccard similarity at or over the threshold."""
    _, codes = np.unique(grams, return_inverse=True)
    size = np.diff(offsets)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    linked = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else [0]
    whole = math.floor(threshold * 1_000_000 + 0.5)
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        x = a[s]
        own = codes[offsets[x] : offsets[x + 1]]
        mark[own] = True
        for t in range(s, e, 4096):
            ys = b[t : min(e, t + 4096)]
            spans = size[ys]
            ends = np.cumsum(spans)
            at = np.repeat(offsets[ys] - (ends - spans), spans) + np.arange(ends[-1])
            common = np.add.reduceat(mark[codes[at]].astype(np.int64), ends - spans)
            linked[t : t + len(ys)] = common * 1_000_000 >= whole * (size[x] + spans - common)
        mark[own] = False
    out = np.empty(len(a), bool)
    out[order] = linked
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component under the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(again := root[root], root):
            root = again
        open_edges = root[a] != root[b]
        a, b = a[open_edges], b[open_edges]
    return root


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (u, v); alternating star contraction."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: links larger neighbours to the smallest of the node and its neighbours; small: the rest likewise."""
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = e.join(low, "u")
        out = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    seen = None
    e = written(oriented, "edges")
    while True:
        before, e = e, written(star(star(e, True), False), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sized(frame: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    return F.broadcast(frame) if rows <= most else frame


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text (null apart from empty)."""
    return [F.xxhash64(text, F.lit(1)).alias("k1"), F.xxhash64(text, F.lit(2), F.length(text)).alias("k2")]


def _classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, rows: int = 4, bands: int = 24, step: int = 16, tolerance: float = 1e-4, unit_docs: int = 2048, unit_grams: int = 1_500_000, pack_pairs: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k1, k2, uid of every document; classes: k1, k2, root, class_id, n_links of every text)."""
    size = rows * bands
    steps = least_matches(step, size, threshold, tolerance / max(1, size // step))  # a share for each look
    text = F.col(text_col).cast("string")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                grams, at = shingle_hashes(*text_bytes(part.column("t")), n)
                values = signatures(grams, at, size)
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), pa.array(np.diff(at).astype(np.int32)), sig], names=["id", "k1", "k2", "grams", "sig"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *text_keys(text), F.coalesce(text, F.lit("")).alias("t"))
    signed = written(keyed.mapInArrow(frugal(sign), "id long, k1 long, k2 long, grams int, sig binary").withColumn("uid", F.monotonically_increasing_id()), "signed")
    classes = written(signed.groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), F.min("id").alias("low"), F.max("grams").alias("grams")), "classes")
    reps = signed.where("grams > 0").join(classes.select("uid", "copies"), "uid")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, bands, rows).astype(U64)
            key = np.zeros((b.num_rows, bands), U64)
            for r in range(rows):
                key = mix(key * _SPREAD[r + 8] + sig[:, :, r])
            key = mix(key + np.arange(1, bands + 1, dtype=U64) * _SPREAD[20]).view(np.int64)
            uid, grams = (np.asarray(b.column(c)) for c in ("uid", "grams"))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows)), pa.array(np.repeat(uid, bands)), pa.array(np.repeat(grams, bands))], names=["bucket", "band", "uid", "grams"])

    banded = reps.select("uid", "grams", "sig").mapInArrow(frugal(band), "bucket long, band int, uid long, grams int")
    met = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.first("band").alias("band"), F.sum(F.col("grams").cast("long")).alias("mass"), F.min("uid").alias("low"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("mark")).where("n > 1")
    kept = met.groupBy("n", "mark", "low").agg(F.min_by(F.struct("bucket", "band", "mass"), F.struct("band", "bucket")).alias("b")).select("b.*", "n")
    chunks = F.greatest(F.ceil(F.col("n") / unit_docs), F.ceil(F.col("mass") / unit_grams)).cast("int")
    kept = written(kept.select("bucket", "band", chunks.alias("chunks")), "buckets")
    members = banded.select("bucket", "uid").join(_sized(kept, kept.count()), "bucket")
    chunk = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    members = members.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    unit = F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    members = members.select(unit.alias("unit"), "band", side.alias("side"), "uid").join(reps.select("uid", "sig", "grams"), "uid")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by unit; a unit is never cut."""
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            units = np.asarray(b.column("unit"))
            cut = int(np.searchsorted(units, units[-1], "left"))
            if cut or (rest and np.asarray(rest[-1].column("unit"))[-1] != units[0]):
                yield from block(pa.Table.from_batches([*rest, b.slice(0, cut)]))
                rest = [b.slice(cut)]
            else:
                rest.append(b)
        if rest:
            yield from block(pa.Table.from_batches(rest))

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        units, uid, bands_of, sides, grams = (np.asarray(t.column(c)) for c in ("unit", "uid", "band", "side", "grams"))
        if not len(units):
            return
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(uid), size)
        first, second, mass, pack = [], [], 0, 0

        def packed() -> pa.RecordBatch:
            nodes, codes = np.unique(np.concatenate([*first, *second]), return_inverse=True)
            ids = uid[nodes]
            distinct, again = np.unique(ids, return_inverse=True)
            half = len(codes) // 2
            pairs = again[codes].astype(np.int32)
            name = int(mix(np.array([int(units[nodes[0]]) & (2**64 - 1)], U64) + U64(pack))[0].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([distinct.tolist()], pa.list_(pa.int64())), pa.array([pairs[:half].tobytes()]), pa.array([pairs[half:].tobytes()])], names=["pack", "uids", "a", "b"])

        waiting, count = 0, 0
        for a, b in _gathered(_pairs(units, sides), 200_000):
            a, b = prune(a, b, bands_of, sig, rows, steps)
            if not len(a):
                continue
            first.append(a)
            second.append(b)
            waiting += len(a)
            count = len(np.unique(np.concatenate([*first, *second])))
            mass = int(grams[np.unique(np.concatenate([*first, *second]))].sum())
            if waiting >= pack_pairs or mass >= 2 * unit_grams or count >= 2 * unit_docs:
                yield packed()
                first, second, waiting, pack = [], [], 0, pack + 1
        if first:
            yield packed()

    ordered = members.repartition("unit").sortWithinPartitions("unit")
    packs = written(ordered.select("unit", "uid", "band", "side", "grams", "sig").mapInArrow(frugal(candidates), "pack long, uids array<long>, a binary, b binary"), "packs")
    wanted = packs.select(F.col("pack").alias("into"), F.explode("uids").alias("uid"))
    needed = written(wanted.select("uid").distinct().join(classes, "uid").select("uid", "k1", "k2", "copies"), "needed")
    sources = docs.select(*text_keys(text), text.alias("t")).join(_sized(needed, needed.count()), ["k1", "k2"]).select("uid", "copies", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                grams, at = shingle_hashes(*text_bytes(part.column("t")), n)
                unique = [np.unique(grams[s:e]).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("copies"), pa.array(unique, pa.binary())], names=["uid", "copies", "set"])

    found = sources.mapInArrow(frugal(sets), "uid long, copies long, set binary").dropDuplicates(["uid"])
    brought = wanted.join(found, "uid").select("into", "uid", "copies", "set")

    def check(pack: pa.Table, brought: pa.Table) -> pa.Table:
        ids = np.asarray(brought.column("uid"))
        order = np.argsort(ids)
        ids, copies = ids[order], np.asarray(brought.column("copies"))[order]
        sets = brought.column("set").to_pylist()
        grams = [np.frombuffer(sets[i], U64) for i in order]
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, U64)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        ea, eb = [], []
        for uids, left, right in zip(*(pack.column(c).to_pylist() for c in ("uids", "a", "b")), strict=True):
            at = np.searchsorted(ids, np.array(uids))
            a, b = at[np.frombuffer(left, np.int32)], at[np.frombuffer(right, np.int32)]
            good = verify(a, b, flat, offsets, threshold)
            a, b = a[good], b[good]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            ea.append(a)
            eb.append(b)
        if ea:
            root = _roots(len(ids), np.concatenate(ea), np.concatenate(eb))
        some = links > 0
        give_back()
        return pa.table({"uid": pa.array(ids[some]), "root": pa.array(ids[root][some]), "links": pa.array(links[some])})

    checked = written(packs.select("pack", "uids", "a", "b").groupBy("pack").cogroup(brought.groupBy("into")).applyInArrow(check, "uid long, root long, links long"), "links")
    discard(kept, packs, needed)
    links = checked.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    joined = classes.join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("class_id"))
    return signed.select("id", "k1", "k2", "uid"), joined.join(lowest, "root").select("k1", "k2", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row for each row of docs: id, class_id (the smallest id of its component), n_links.

    Two documents are linked if the Jaccard similarity of their sets of n-word grams (words lower-cased A-Z) is at or
    over the threshold; n_links counts the other documents linked to a document, copies included. A text of fewer
    than n words is one gram; texts without words (null, empty) link only to equal texts, null being its own text.
    Repeated rows are copies; null ids form classes like others (a class of null ids only has a null class_id); an
    empty table gives no rows; other columns are not read. A pair at the threshold is missed with a probability of
    (1 - threshold**rows)**bands, 3e-6 as given, plus 1.2e-4 by the looks together, each of which has its share of the
    tolerance (for a similarity of exactly 0.8, before conditioning on a common band; 5.3e-5 at 0.81, 2.4e-6 at 0.85).
    """
    documents, classes = _classes(docs, id_col, text_col, **options)
    return documents.join(classes, ["k1", "k2"]).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row of docs for each class of similar(): that of the smallest id (null ids last), with the columns of docs."""
    documents, classes = _classes(docs, id_col, text_col, **options)
    rows = written(documents.join(classes.select("k1", "k2", "root"), ["k1", "k2"]), "rows")
    order = F.struct(F.col("id").isNull(), "id", "uid")
    first = rows.groupBy("root").agg(F.min_by(F.struct("id", "k1", "k2"), order).alias("first"))
    judged = rows.join(first, "root").withColumn("stays", F.struct("id", "k1", "k2").eqNullSafe(F.col("first")))
    key = text_keys(F.col(text_col).cast("string"))
    left = without(docs, judged.where(~F.col("stays")), {"id": F.col(id_col).cast("long"), "k1": key[0], "k2": key[1]}, "dropped")
    repeated = judged.where("stays").groupBy("root").count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates([id_col, text_col])
