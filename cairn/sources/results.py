"""Result documents: JSON with a header, free of NaN and infinities; lookups over a folder of them."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

from .tables import _fs, exists


def safe(value: object) -> object:
    """Plain JSON values: NaN and infinities are null, times are ISO text, rows are objects."""
    if isinstance(value, Row):
        return {k: safe(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [safe(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if hasattr(value, "item"):
        return safe(value.item())
    return value


def document(payload: dict, schema_version: str = "1.0", now: datetime.datetime | None = None) -> dict:
    """Header, then the payload, which wins where names clash."""
    at = now or datetime.datetime.now(datetime.UTC)
    return {"generated_at": at.isoformat(), "schema_version": schema_version, **safe(payload)}


def write_json(spark: SparkSession, path: str, payload: dict, schema_version: str = "1.0") -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(json.dumps(document(payload, schema_version), ensure_ascii=False, indent=2, allow_nan=False).encode())
    out.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Puts text into the file at `path` in one step: readers see the old content or the new."""
    fs, at = _fs(spark, path)
    fresh = at.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(text.encode())
    out.close()
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = fs.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), qualified, how)


def records(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """Rows of a report as objects; a report is small, more than `limit` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    return [safe(r) for r in rows]


class Results:
    """Named documents of a folder, read once."""

    def __init__(self, spark: SparkSession, base: str, names: tuple[str, ...]) -> None:
        self.documents: dict[str, dict] = {}
        for n in names:
            path = f"{base}/{n}.json"
            if exists(spark, path):
                self.documents[n] = json.loads(spark.read.text(path, wholetext=True).first()[0])

    def get(self, name: str) -> dict | None:
        return self.documents.get(name)

    def available(self) -> list[str]:
        return sorted(self.documents)

    def is_ready(self) -> bool:
        return bool(self.documents)
