"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id). A size-weighted sample of those keys gives quantile boundaries that cut
the order into many ranges of about equal bytes; a range that turns out overfull is subdivided by splitters sampled
inside it. Exact sums over the ranges then place every row at its byte offset in the whole order. Rows of more than a
hundredth of a shard, of which there can be a hundred a shard at most, are dealt first, largest to the emptiest shard;
the others fill what each shard has left in the order of their offsets, so shards are equal to within such a hundredth
wherever no single row is larger than a shard.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written

LOWEST = -(2**63)


def _assign(frame: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds `part`: the number of splitters at or below (key, rank)."""
    keys = np.array([k for k, _ in splitters], dtype=np.int64)
    ids = np.array([i for _, i in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series, rank: pd.Series) -> pd.Series:
        key, rank = key.to_numpy(), rank.to_numpy()
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = low.copy()
        tied = np.flatnonzero(high > low)
        for at in np.unique(low[tied]):
            rows = tied[low[tied] == at]
            out[rows] += np.searchsorted(ids[at : high[rows[0]]], rank[rows], "right")
        return pd.Series(out.astype(np.int32))

    return frame.withColumn("part", part("key", "rank"))


def _splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Weighted quantiles of (key, rank, weight). A key met by one splitter only starts its range as a whole."""
    if ranges < 2 or not sample:
        return []
    sample = sorted(sample)
    cum = np.cumsum([w for _, _, w in sample])
    at = sorted(set(np.minimum(np.searchsorted(cum, cum[-1] * np.arange(1, ranges) / ranges), len(sample) - 1).tolist()))
    picked, out = [sample[i][:2] for i in at], []
    for n, (key, rank) in enumerate(picked):
        hot = n and picked[n - 1][0] == key
        out.append((key, rank if hot else LOWEST))
    return sorted(set(out))


def _filled(load: list[int], rest: int) -> list[float]:
    """How much of `rest` each shard takes so that all are as full as the loads allow."""
    level, open_loads = 0.0, sorted(load)
    for n in range(1, len(load) + 1):
        level = (rest + sum(open_loads[:n])) / n
        if n == len(load) or level <= open_loads[n]:
            break
    return [max(0.0, level - x) for x in load]


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, rows_a_range: int = 2_000_000, keys_a_range: int = 16, seed: int = 7) -> DataFrame:
    """Every row of docs in one of `shards` shards of near-equal bytes.

    Size is the text's UTF-8 bytes (a null text has none) plus `overhead`; a null text has the CRC-32 of no bytes, 0.
    Equal texts stay in one shard while their group has at most a hundredth of a shard's bytes; larger groups are
    cut by id. Very long texts are read whole; one larger than a shard makes its shard that much larger. Repeated rows each get a slot; a null id sorts first; an empty table gives no rows; other columns are
    not read. Returns id, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    keyed = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(text).alias("key"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("rank"),
        ),
        "shard-keys",
    )
    whole = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = whole / shards
    large = keyed.where(F.col("size") > target / 100)  # at most a hundred a shard
    load, dealt, again = [0] * shards, [], Counter()
    for size, key, rank in sorted((tuple(r) for r in large.select("size", "key", "rank").collect()), key=lambda x: (-x[0], x[1], x[2])):
        shard = load.index(min(load))
        load[shard] += size
        dealt.append((key, rank, again[key, rank], shard))
        again[key, rank] += 1
    keyed = keyed.where(F.col("size") <= target / 100)
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(8 * shards, -(-rows // rows_a_range))
    draw = F.shiftrightunsigned(F.xxhash64("key", "rank", F.lit(seed)), 11) / F.lit(float(2**53))

    def sampled(frame: DataFrame, mass: int, wanted: int) -> list[tuple[int, int, float]]:
        """About `wanted` keys, each with a chance in proportion to its size, and the bytes it stands for."""
        each = mass / max(wanted, 1)
        return [(r[0], r[1], max(float(r[2]), each)) for r in frame.where(draw < F.col("size") / F.lit(each)).select("key", "rank", "size").collect()] if mass else []

    splitters = _splitters(sampled(keyed, total, keys_a_range * ranges), ranges)
    full = 2 * total / max(ranges, 1)
    while True:  # until nothing is added: the sums below belong to the final splitters
        placed = _assign(keyed, splitters)
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("part").agg(F.sum("size"), F.count("*")).collect()}
        over = [p for p, (size, count) in sums.items() if size > full and count > 1]
        if not over:
            break
        mass = sum(sums[p][0] for p in over)
        extra = -(-2 * mass // max(1, int(full)))
        more = sampled(placed.where(F.col("part").isin(over)), mass, keys_a_range * extra)
        by_part: dict[int, list] = {}
        for x in more:
            p = int(np.searchsorted(np.array([s[0] for s in splitters], dtype=np.int64), x[0], "right"))
            by_part.setdefault(p, []).append(x)
        # a hot key has no inner key boundary: its ids become the splitters
        added = {x for xs in by_part.values() for x in _splitters(xs, int(2 * sum(w for *_, w in xs) / max(1.0, full)) + 1)}
        hot = {k for k, r in added if r != LOWEST}
        grown = sorted(set(splitters) | added | {(k, LOWEST) for k in hot})
        if grown == splitters:
            break
        splitters = grown
    parts, at_bytes, at_rows, offsets = sorted(sums), 0, 0, []
    for p in parts:
        offsets.append((p, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[p][0], at_rows + sums[p][1]
    start = spark.createDataFrame(offsets, "part int, byte_start long, row_start long")
    inside = W.partitionBy("part").orderBy("key", "rank")
    group = W.partitionBy("part", "key")
    size = F.col("size")
    before = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - size
    room = _filled(load, total)
    cuts = np.cumsum(room)[:-1].tolist()
    placed = (
        _assign(keyed, splitters)
        .withColumn("before", before)
        .withColumn("row", F.row_number().over(inside) - 1)
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_before", F.min("before").over(group))
        .join(F.broadcast(start), "part")
    )
    together = F.col("group_size") <= F.lit(target / 100)
    middle = F.col("byte_start") + F.when(together, F.col("group_before") + F.col("group_size") / 2).otherwise(F.col("before") + size / 2)
    placed = placed.withColumn("shard", reduce(lambda n, cut: n + (middle >= F.lit(cut)).cast("int"), cuts, F.lit(0))).withColumn("position", F.col("row_start") + F.col("row"))
    filled = {r[0]: (r[1], r[2]) for r in placed.groupBy("shard").agg(F.min("position"), F.count("*")).collect()}
    first = spark.createDataFrame([(n, at) for n, (at, _) in filled.items()], "shard int, shard_start long")
    columns = lambda slot: (F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = placed.join(F.broadcast(first), "shard").select(*columns(F.col("position") - F.col("shard_start")))
    if not dealt:
        return out
    slots, at = [], {n: count for n, (_, count) in filled.items()}
    for key, rank, nth, shard in dealt:
        slots.append((key, rank, nth, shard, at.setdefault(shard, 0)))
        at[shard] += 1
    homes = spark.createDataFrame(slots, "key long, rank long, nth int, shard int, slot long")
    numbered = large.withColumn("nth", F.row_number().over(W.partitionBy("key", "rank").orderBy("size")) - 1)
    return out.unionByName(numbered.join(F.broadcast(homes), ["key", "rank", "nth"]).select(*columns(F.col("slot"))))
