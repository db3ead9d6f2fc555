"""Quality selection by importance resampling.

Two bags of hashed unigrams (words and runs of punctuation) and bigrams are fitted, one to target (labelled good) and
one to all text. A document's log importance weight is the log-ratio of the two models, the sum over its features (or,
with a common length, their mean times that length), and documents are drawn without replacement by the Gumbel top-k
trick: the k largest of weight plus a Gumbel variate seeded by the row's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal, mix, seeded_table, slices, text_bytes, uniform, word_hashes, written

U64 = np.uint64
_PAIR = U64(0x9FB21C651E98DF25)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every pair of neighbours, and n + 1 offsets of each text's features."""
    words, at = word_hashes(data, offsets, punctuation=True)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    out = np.empty(2 * n, np.int64)
    out[::2] = (words % U64(buckets)).astype(np.int64)
    out[1:-1:2] = (mix(words[:-1] * _PAIR + words[1:]) % U64(buckets)).astype(np.int64)
    valid = np.ones(2 * n, bool)
    valid[1::2][at[1:][at[1:] > at[:-1]] - 1] = False  # no pair over the end of a text
    before = np.concatenate([[0], np.cumsum(valid)])
    return out[valid], before[2 * at]


def _threshold(scored: DataFrame, k: int) -> tuple[float, int] | None:
    """Key and tie hash of the k-th row by (key descending, tie ascending), by counting bins instead of sorting all."""
    low, high = scored.agg(F.min("draw"), F.max("draw")).first()
    if low is None:
        return None
    frame, before = scored, 0
    for _ in range(3):
        if not high > low:
            break
        width = (high - low) / 4096
        binned = F.least(F.lit(4095), F.floor((F.col("draw") - F.lit(low)) / F.lit(width)))
        counts = dict(frame.groupBy(binned.alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if before + counts[b] >= k:
                break
            before += counts[b]
        frame = frame.where(binned == b)
        if counts[b] <= 100_000:
            break
        low, high = frame.agg(F.min("draw"), F.max("draw")).first()
    need = k - before
    # equal rows are one entry: what is left is at most the rows of a small bin or a few draws that many rows share
    for draw, tie, rows in frame.groupBy("draw", "tie").count().orderBy(F.desc("draw"), "tie").limit(need).collect():
        need -= rows
        if need <= 0:
            return draw, tie
    return None


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.75, buckets: int = 10_000, length: float | None = None, bound: int = 100_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", target: str = "quality = 1 and toxic = 0") -> DataFrame:
    """One row for each row of docs: id, n_features, log_weight, draw, selected.

    selected marks the top ceil(fraction * rows) draws, the sample, exactly as many; ties go to the smaller hash of the
    row's key, and of rows equal in id and text, which share a draw, as many are selected as are still wanted at the cut.
    log_weight is the log-ratio of target to raw text; with `length` it is the mean log-ratio of the text's features
    times that, which weighs long and short texts alike. Raw counts cover all documents; the target model takes the
    labelled documents of `target`, of which at most about `bound` (the documented bound), drawn by id hash. Texts
    without words are drawn last (log_weight is minus infinity's stand-in, -1e9). Null texts count as empty; very long
    ones are read whole; an empty table gives no rows; no labels: all weights are 0. Other columns are not read.
    """
    good = labels.where(target).select(F.col(id_col).cast("long").alias("g")).distinct()
    n_good = good.count()
    if n_good > bound:
        good = good.where(F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * bound / n_good))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    flagged = rows.join(F.broadcast(good), rows["id"] == F.col("g"), "left").select(F.col("g").isNotNull().alias("good"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                found, at = features(*text_bytes(part.column("t")), buckets)
                raw += np.bincount(found, minlength=buckets)
                mask = np.repeat(np.asarray(part.column("good")), np.diff(at))
                wanted += np.bincount(found[mask], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(wanted[used])], names=["bucket", "raw", "good"])

    sums = flagged.mapInArrow(frugal(count), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()
    raw, wanted = np.ones(buckets), np.ones(buckets)
    for b, r, g in sums:
        raw[b] += r
        wanted[b] += g
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum()) if wanted.sum() > buckets else np.zeros(buckets)
    salt = seeded_table(1, seed)[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                data, offsets = text_bytes(part.column("t"))
                found, at = features(data, offsets, buckets)
                n = np.diff(at)
                weight, real = np.full(len(n), -1e9), np.flatnonzero(n > 0)
                if len(real):
                    weight[real] = np.add.reduceat(ratio[found], at[:-1][real])
                    if length is not None:
                        weight[real] *= length / n[real]
                tie = mix(np.asarray(part.column("key")).astype(np.int64).view(U64) + salt)
                draw = weight - np.log(-np.log(uniform(tie)))
                yield pa.record_batch([part.column("id"), pa.array(n), pa.array(weight), pa.array(draw), pa.array((tie >> U64(1)).astype(np.int64))], names=["id", "n", "weight", "draw", "tie"])

    keyed = rows.select("id", F.xxhash64("id", F.xxhash64("t")).alias("key"), "t")
    scored = written(keyed.mapInArrow(frugal(score), "id long, n long, weight double, draw double, tie long"), "resample")
    k = int(np.ceil(fraction * scored.count()))
    columns = lambda chosen: (F.col("id").alias(id_col), F.col("n").alias("n_features"), F.col("weight").alias("log_weight"), "draw", chosen.alias("selected"))
    if not k:
        return scored.select(*columns(F.lit(False)))
    draw, tie = _threshold(scored, k)
    above = (F.col("draw") > draw) | ((F.col("draw") == draw) & (F.col("tie") < tie))
    at_cut = (F.col("draw") == draw) & (F.col("tie") == tie)
    wanted = k - scored.where(above).count()
    kinds = scored.where(at_cut).groupBy("id", "n", "weight", "draw", "tie").count().orderBy("id", "n").collect()  # equal rows: one kind
    if wanted == sum(x["count"] for x in kinds):
        return scored.select(*columns(above | at_cut))
    out = scored.where(~at_cut).select(*columns(above))
    for x in kinds:  # equal rows cannot be told apart: they are written anew, the first of them selected
        values = scored.sparkSession.createDataFrame([tuple(x)[:-1]], scored.schema)
        copies = scored.sparkSession.range(x["count"]).select((F.col("id") < max(0, wanted)).alias("chosen"))
        out = out.union(copies.crossJoin(F.broadcast(values)).select(*columns(F.col("chosen"))))
        wanted -= x["count"]
    return out
