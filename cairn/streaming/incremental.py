"""Incremental forms of the batch figures; extensions, as no batch operator needs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import scoring


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by window and kind; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", kind, "n", "total")


def first_seen(reviews: DataFrame, key: str = "review_id", time: str = "review_creation_date", late: str = "1 day") -> DataFrame:
    """Reviews without repeats of an id within the watermark."""
    return reviews.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def translating(reviews: DataFrame, load: Callable[[], scoring.Model], path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch translated and appended under its own number, so a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        scoring.translate_step(batch, load).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reviews.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
