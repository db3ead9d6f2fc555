"""Recency-frequency-monetary segmentation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import total, whole_days
from ..functions.values import SEGMENTS

FEATURES = ("Recency", "Frequency", "Monetary")


def rfm_table(orders: DataFrame, snapshot: str | None = None) -> DataFrame:
    """One row a person: days since the last order (before `snapshot`, by default a day after the last of all), orders, spend."""
    if snapshot is None:
        at = orders.agg((F.max("order_purchase_timestamp") + F.expr("interval 1 day")).alias("_snapshot"))
    else:
        at = orders.sparkSession.range(1).select(F.lit(snapshot).cast("timestamp_ntz").alias("_snapshot"))
    sums = orders.where("customer_unique_id is not null").groupBy("customer_unique_id").agg(F.max("order_purchase_timestamp").alias("_last"), F.count_distinct("order_id").alias("Frequency"), total(F.col("total_payment_value")).alias("Monetary"))
    return sums.join(F.broadcast(at)).select("customer_unique_id", whole_days(F.col("_last"), F.col("_snapshot")).alias("Recency"), "Frequency", "Monetary")


def nearest(columns: tuple[str, ...], centres: list[list[float]]) -> Column:
    """Number of the nearest centre; the smallest number of equals."""
    gap = lambda c: sum((F.col(n).cast("double") - F.lit(float(v))) * (F.col(n).cast("double") - F.lit(float(v))) for n, v in zip(columns, c, strict=True))
    gaps = F.array(*[gap(c) for c in centres])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def named_segments(table: DataFrame, cluster: str = "Cluster", names: tuple[str, ...] = SEGMENTS) -> DataFrame:
    """cluster, mean Monetary and the segment name that its rank of it gives; clusters beyond the names get none."""
    means = table.groupBy(cluster).agg(F.avg("Monetary").alias("mean_monetary"))
    rank = F.row_number().over(W.orderBy(F.desc("mean_monetary"), cluster))  # a row a cluster
    return means.withColumn("Segment", F.get(F.array(*[F.lit(n) for n in names]), rank - 1))


def segment_profile(table: DataFrame) -> DataFrame:
    """Segment, rounded means and customers."""
    return table.groupBy("Segment").agg(*[F.bround(F.avg(c), 2).alias(c) for c in FEATURES], F.count("*").alias("customer_count")).orderBy("Segment")


@dataclass
class Segmentation:
    """Scaling, centres (in scaled space) and the name of each cluster."""

    means: list[float]
    deviations: list[float]
    centres: list[list[float]]
    names: dict[int, str]

    def assign(self, table: DataFrame) -> DataFrame:
        scaled = {f"_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(FEATURES, self.means, self.deviations, strict=True)}
        found = table.withColumns(scaled).withColumn("Cluster", nearest(tuple(scaled), self.centres)).drop(*scaled)
        pairs = [F.lit(x) for kv in self.names.items() for x in kv]
        return found.withColumn("Segment", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("Cluster")), F.lit("Unknown")))

    def predict(self, recency: float, frequency: float, monetary: float) -> dict:
        """Cluster and name of one person, on the driver."""
        if recency < 0 or frequency < 1 or monetary < 0:
            raise ValueError("recency >= 0, frequency >= 1 and monetary >= 0 are needed")
        x = [(v - m) / s for v, m, s in zip((recency, frequency, monetary), self.means, self.deviations, strict=True)]
        gaps = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in self.centres]
        k = gaps.index(min(gaps))
        return {"cluster_id": k, "segment_name": self.names.get(k, "Unknown")}

    def save(self, spark: SparkSession, path: str) -> None:
        state = json.dumps({"means": self.means, "deviations": self.deviations, "centres": self.centres, "names": {str(k): v for k, v in self.names.items()}})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Segmentation:
        state = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(state["means"], state["deviations"], state["centres"], {int(k): v for k, v in state["names"].items()})


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances: points x centres."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _drawn(points: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to 1 for each point, by its values and the salt alone."""
    h = np.full(len(points), np.random.SeedSequence(salt).generate_state(1, np.uint64)[0])
    with np.errstate(over="ignore"):
        for bits in (points + 0.0).view(np.uint64).reshape(points.shape).T:
            h = (h ^ bits) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)) / float(1 << 53)


def _passed(frame: DataFrame, work: Callable[[np.ndarray], dict[tuple[int, int], list[float]]], width: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of what `work` makes of each batch of points, by start and place: partitions sum first, and few rows travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in work(np.stack([np.asarray(c) for c in b.columns], axis=1)).items():
                    total[k] = total.get(k, 0.0) + np.asarray(v, float)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([float(total[k][i]) for k in keys], pa.float64()) for i in range(width))], names=["s", "p", *(f"x{i}" for i in range(width))])

    fields = ", ".join(["s int", "p int", *(f"x{i} double" for i in range(width))])
    rows = frame.mapInArrow(run, fields).groupBy("s", "p").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(width)]).collect()  # starts x clusters
    return {(r["s"], r["p"]): np.array(r[2:]) for r in rows}


def _seeded(frame: DataFrame, clusters: int, starts: int, seed: int, rounds: int) -> list[np.ndarray]:
    """First centres of every start by over-sampling in parallel: in each round a point joins a start's candidates with a
    probability by its distance to them; candidates weigh by the points nearest to them, and the driver picks among the
    few, each by weight and distance."""
    names = list(frame.columns)
    mean = np.zeros((1, len(names)))
    candidates = [mean for _ in range(starts)]
    for n in range(rounds):
        held = [c.copy() for c in candidates]
        cost = _passed(frame, lambda x, held=held: {(s, 0): [_distances(x, c).min(axis=1).sum()] for s, c in enumerate(held)}, 1)
        scale = [2 * clusters / max(cost[s, 0][0], 1e-300) if (s, 0) in cost else 0.0 for s in range(starts)]

        def drawn(batches: Iterator[pa.RecordBatch], n: int = n, held: list = held, scale: list = scale) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack([np.asarray(c) for c in b.columns], axis=1)
                for s, c in enumerate(held):
                    some = x[_drawn(x, seed, s, n) < scale[s] * _distances(x, c).min(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), *(pa.array(some[:, i]) for i in range(x.shape[1]))], names=["s", *names])

        kind = ", ".join(["s int", *(f"`{c}` double" for c in frame.columns)])
        for r in sorted(frame.mapInArrow(drawn, kind).collect()):  # twice the clusters of each start, on average
            candidates[r[0]] = np.vstack([candidates[r[0]], np.array(r[1:])])
    kept = [np.unique(c[1:], axis=0) if len(c) > 1 else c for c in candidates]
    weigh = lambda x: {(s, int(p)): [float(m)] for s, c in enumerate(kept) for p, m in zip(*np.unique(_distances(x, c).argmin(axis=1), return_counts=True), strict=True)}
    weights = _passed(frame, weigh, 1)
    out = []
    for s, c in enumerate(kept):
        w, r = np.array([weights[s, p][0] if (s, p) in weights else 0.0 for p in range(len(c))]), np.random.default_rng([seed, s])
        chosen = [int(r.choice(len(c), p=w / w.sum()))] if w.sum() else [0]
        while len(chosen) < clusters:
            far = w * _distances(c, c[chosen]).min(axis=1)
            chosen.append(int(r.choice(len(c), p=far / far.sum())) if far.sum() > 0 else chosen[-1])
        out.append(c[chosen])
    return out


def kmeans(frame: DataFrame, clusters: int, seed: int = 42, starts: int = 10, iterations: int = 50, rounds: int = 3, tolerance: float = 1e-4) -> tuple[np.ndarray, float, list[float]]:
    """Centres and cost of the best of `starts` runs of Lloyd's iteration over all columns of frame, and every run's cost.

    All runs share each pass over the rows, so passes grow with iterations, not with starts. A run rests once no centre
    moves by more than the tolerance; an empty cluster keeps its centre; rows with a null take no part; no rows are an
    error. Repeated rows weigh as often as they occur."""
    points = frame.select(*[F.col(c).cast("double").alias(c) for c in frame.columns]).na.drop()
    if points.isEmpty():
        raise ValueError("there are no rows to cluster")
    centres, moving = _seeded(points, clusters, starts, seed, rounds), set(range(starts))

    def assigned(x: np.ndarray, held: list[np.ndarray], of: set[int]) -> dict[tuple[int, int], list[float]]:
        out: dict[tuple[int, int], list[float]] = {}
        for s in of:
            d = _distances(x, held[s])
            near, cost = d.argmin(axis=1), d.min(axis=1)
            for p in np.unique(near):
                own = near == p
                out[s, int(p)] = [float(own.sum()), float(cost[own].sum()), *x[own].sum(axis=0).tolist()]
        return out

    for _ in range(iterations):
        if not moving:
            break
        held, of = [c.copy() for c in centres], set(moving)
        for (s, p), sums in _passed(points, lambda x, held=held, of=of: assigned(x, held, of), 2 + len(points.columns)).items():
            centres[s][p] = sums[2:] / sums[0]
        moving = {s for s in of if ((centres[s] - held[s]) ** 2).sum(axis=1).max() > tolerance**2}
    last = _passed(points, lambda x: assigned(x, centres, set(range(starts))), 2 + len(points.columns))
    costs = [sum(float(v[1]) for (s, _), v in last.items() if s == n) for n in range(starts)]
    best = int(np.argmin(costs))
    return centres[best], costs[best], costs


def fit_segments(table: DataFrame, clusters: int = 4, seed: int = 42, starts: int = 10, iterations: int = 50) -> Segmentation:
    """The best of `starts` k-means runs on the standardised table."""
    sums = table.agg(*[x for c in FEATURES for x in (F.avg(c), F.stddev_pop(c))]).first()
    means, deviations = [float(x) for x in sums[::2]], [float(x) or 1.0 for x in sums[1::2]]
    scaled = table.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip(FEATURES, means, deviations, strict=True)]).persist()
    centres, _, _ = kmeans(scaled, clusters, seed, starts, iterations)
    scaled.unpersist()
    fitted = Segmentation(means, deviations, centres.tolist(), {0: ""})
    ranked = named_segments(fitted.assign(table).drop("Segment")).collect()
    fitted.names = {r["Cluster"]: r["Segment"] for r in ranked if r["Segment"] is not None}
    return fitted
