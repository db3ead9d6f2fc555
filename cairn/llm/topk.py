"""Exact top-k inner products by no-random-access aggregation over sorted component lists.

Vectors are collapsed to distinct ones and dealt to groups. A group keeps, for every dimension, a list of its vectors
from the large end of that component and one from the small end, so every query reads each dimension from the end
that its own component favours, with a weight that is not negative. All lists are read to the same depth, which grows
in steps. At a depth, a vector's upper bound is what was read of it plus, for each list where it was not met, what
that list still offers (its frontier); its lower bound takes the list's last value instead; a vector met nowhere has
the sum of all frontiers. A query stops where that sum is under its k-th best lower bound and few vectors are still
open, and the scores of those are resolved. The bound that the first group gives is where all other groups start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import frugal_table, written

#: Depths at which the bounds are looked at, as shares of a list.
DEPTHS = (1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1)
#: A query resolves its open vectors when they are at most this share of the group: that is cheaper than reading on.
FEW = 1 / 8
AT_ONCE = 256  # queries whose bounds are held in memory together
PAIRS = 1 << 15  # scores resolved at once


class Lists:
    """The sorted lists of a group of integer vectors (rows x dimensions), two for each dimension."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, width = vectors.shape
        peak = float(np.abs(vectors).max(initial=0))
        exact = peak * peak * 2 * max(width, 1)  # no sum or bound is larger
        kind = np.float32 if exact < 2**24 else np.float64
        self.slack = 0.5 if exact < 2**53 else 1e-9 * exact  # scores are whole numbers
        self.dense = vectors.astype(kind) if exact < 2**53 else vectors
        both = np.concatenate([vectors, -vectors], 1).astype(kind).T  # lists x rows
        self.order = np.argsort(-both, axis=1, kind="stable")
        self.values = np.take_along_axis(both, self.order, 1)
        self.depths = sorted({max(1, round(n * share)) for share in DEPTHS}) if n else []
        self.front = self.values[:, [d - 1 for d in self.depths]]  # lists x depths
        self.worst = self.values[:, -1:]
        self._read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """What all lists give down to a depth: by list and vector, the excess over the frontier, and whether it was met."""
        if at not in self._read:
            depth = self.depths[at]
            excess, met = np.zeros_like(self.values), np.zeros_like(self.values)
            np.put_along_axis(excess, self.order[:, :depth], self.values[:, :depth] - self.front[:, at : at + 1], 1)
            np.put_along_axis(met, self.order[:, :depth], 1, 1)
            self._read[at] = excess, met
        return self._read[at]

    def search(self, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of all vectors that may be among a query's k best, the k best surely among them.

        floors: the k-th best score already known for each query, or minus infinity."""
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], 1).astype(self.values.dtype)
        floors, offers = floors.astype(np.float64), weights @ self.front
        todo, found = np.arange(len(queries)), []
        for at in range(len(self.depths)):
            last = at + 1 == len(self.depths)
            stay = []
            # where a vector that was met nowhere can still reach a known bound, there is nothing to decide yet
            waits = (offers[todo, at] >= floors[todo] - self.slack) & np.isfinite(floors[todo]) & (not last)
            stay.append(todo[waits])
            ready = todo[~waits]
            for s in range(0, len(ready), AT_ONCE):
                mine = ready[s : s + AT_ONCE]
                excess, met = self.read(at)
                upper = weights[mine] @ excess + offers[mine, at : at + 1]
                opened = upper >= (floors[mine] - self.slack)[:, None]
                many = np.flatnonzero(opened.sum(1) > FEW * len(self.vectors))
                if len(many) and upper.shape[1] >= k:
                    gaps = weights[mine[many]] * (self.front[:, at] - self.worst[:, 0])
                    lower = upper[many] - gaps.sum(1, keepdims=True) + gaps @ met
                    kth = np.partition(lower, lower.shape[1] - k, 1)[:, lower.shape[1] - k]
                    floors[mine[many]] = np.maximum(floors[mine[many]], kth)
                    opened[many] = upper[many] >= (floors[mine[many]] - self.slack)[:, None]
                done = (opened.sum(1) <= FEW * len(self.vectors)) & (offers[mine, at] < floors[mine] - self.slack) | last
                stay.append(mine[~done])
                q, v = np.nonzero(opened[done])
                found.append(self._resolve(queries, mine[done][q], v, floors))
            todo = np.concatenate(stay)
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3))

    def _resolve(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked = queries.astype(self.dense.dtype)
        scores = np.zeros(len(q), np.int64)
        for s in range(0, len(q), PAIRS):
            scores[s : s + PAIRS] = np.einsum("ij,ij->i", asked[q[s : s + PAIRS]], self.dense[v[s : s + PAIRS]])
        good = scores >= floors[q] - self.slack
        return q[good], v[good], scores[good]


def first_of_each(owner: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Indices of the first k of each owner by `order` (first key first)."""
    by = np.lexsort((*order[::-1], owner))
    start = np.flatnonzero(np.concatenate([[True], owner[by][1:] != owner[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.concatenate([start, [len(by)]])))
    return by[rank < k]


def components(vector: Column) -> Column:
    """floor(64 x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(64.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 8_192, group_rows: int = 8_192) -> DataFrame:
    """For each row whose id is divisible by `every`: its k best other rows (all, if fewer) by integer inner product.

    Returns query_id, rank, vec_id, score; ties go to the smaller id. Rows with a null id, a null vector, or null or
    non-finite components take no part; vectors meet only vectors of their own length; an empty table gives no rows;
    a repeated query row is answered once, its copies being candidates; a score that no long holds is an overflow
    error; other columns are not read.
    Of one vector only the k + 1 smallest ids can be among a query's k best and itself, so those stand for all of its
    rows, and queries of one vector are answered together. Groups of about `group_rows` vectors meet blocks of about
    `query_rows` queries: the queries are copied to the groups, and a group is copied only to further blocks.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base = base.select("id", components(F.col("v")).alias("v"))
    nearest = W.partitionBy("v").orderBy("id")
    kept = base.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    distinct = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queried = base.where(F.col("id") % every == 0).select("id", "v").distinct()
    keys = [F.xxhash64(F.lit(n), F.col("v")).alias(f"k{n}") for n in (1, 2)]
    distinct = written(distinct.select("v", "ids", F.size("v").alias("size"), *keys), "topk-vectors")
    queried = written(queried.select("id", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("own"), "v", F.size("v").alias("size"), *keys), "topk-queries")
    asked = queried.select("v", "size", "k1", "k2").distinct()
    groups, blocks = max(1, -(-distinct.count() // group_rows)), max(1, -(-asked.count() // query_rows))
    held = distinct.withColumn("group", F.pmod("k1", F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod("k2", F.lit(blocks)).cast("int"))

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        width = asked.column("size")[0].as_py() if len(asked) else 0
        matrix, queries = (np.asarray(x.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(len(x), width) for x in (held, asked)) if len(asked) and len(held) else (np.zeros((0, 0), np.int64),) * 2
        floors = np.array([-np.inf if f is None else f for f in asked.column("floor").to_pylist()])
        q, v, score = Lists(matrix).search(queries, floors[: len(queries)], k + 1)
        lists = held.column("ids").combine_chunks()
        ids, size = np.asarray(lists.flatten(), dtype=np.int64), np.asarray(lists.value_lengths(), dtype=np.int64)
        each = size[v]
        ends = np.cumsum(each)
        entry = np.repeat((np.cumsum(size) - size)[v] - (ends - each), each) + np.arange(int(each.sum()))
        q, score, ids = np.repeat(q, each), np.repeat(score, each), ids[entry]
        best = first_of_each(q, k + 1, -score, ids)
        at = pa.array(q[best], pa.int64())
        return pa.table({"k1": asked.column("k1").take(at), "k2": asked.column("k2").take(at), "vec_id": pa.array(ids[best]), "score": pa.array(score[best])})

    def met(asked: DataFrame, held: DataFrame) -> DataFrame:
        by = ("size", "group", "block")
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(frugal_table(answer), "k1 long, k2 long, vec_id long, score long")

    found = written(met(asked.withColumn("group", F.lit(0)).withColumn("floor", F.lit(None).cast("long")), held.where("group = 0")), "topk-first")
    if groups > 1:
        known = found.groupBy("k1", "k2").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
        others = asked.join(known, ["k1", "k2"], "left").withColumn("group", F.explode(F.sequence(F.lit(1), F.lit(groups - 1))))
        found = found.union(met(others, held.where("group > 0")))
    best = W.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    tops = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("top"))
    answers = queried.select(F.col("id").alias("query_id"), "own", "k1", "k2").join(tops, ["k1", "k2"])
    self_at = F.array_position("top", F.struct((-F.col("own")).alias("less"), F.col("query_id").alias("vec_id"))).cast("int")
    others = F.when(self_at > 0, F.concat(F.slice("top", F.lit(1), self_at - 1), F.slice("top", self_at + 1, F.lit(k + 1)))).otherwise(F.col("top"))
    out = answers.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
