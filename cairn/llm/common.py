"""Helpers that the corpus operators share: scratch tables, Arrow batching, keyed hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
#: Words of the text contracts: runs of digits, letters and all characters beyond ASCII (case kept).
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one only where it is unset and all
    tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    _tables.append((again, path))
    return again


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], name: str, most: int = 1_000_000) -> DataFrame:
    """The rows of docs whose keys (column of dropped: expression on docs) do not occur in dropped, nulls equal.

    The dropped keys are written first; they are broadcast only up to `most` rows, beyond that the join shuffles."""
    gone = written(dropped.select(*keys).distinct(), name).select(*[F.col(k).alias(f"gone_{n}") for n, k in enumerate(keys)])
    same = None
    for n, value in enumerate(keys.values()):
        test = value.eqNullSafe(F.col(f"gone_{n}"))
        same = test if same is None else same & test
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, same, "left_anti")


#: Scratch tables that are still there, oldest first.
_tables: list[tuple[DataFrame, str]] = []


def _delete(entries: list[tuple[DataFrame, str]]) -> None:
    for entry in entries:
        df, path = entry
        _tables.remove(entry)
        context = df.sparkSession.sparkContext
        if context._jvm is None:
            continue
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def discard(*done: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    _delete([e for e in _tables if any(e[0] is d for d in done)])


def scratch_count() -> int:
    return len(_tables)


def keep_newest(since: int) -> None:
    """Deletes the tables written since there were `since` of them, but for the newest."""
    _delete(_tables[since:-1])


def _at_exit() -> None:
    try:
        _delete(list(_tables))
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the folder is scratch
        return


atexit.register(_at_exit)


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function after which a worker gives memory it no longer uses back: idle workers stay alive beside busy ones."""

    def wrapped(batches: Batches) -> Batches:
        def counted() -> Batches:
            for b in batches:
                yield b
                give_back()

        yield from run(counted())
        give_back()

    return wrapped


def frugal_table(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups' tables."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose `column` (strings) holds about max_bytes each; one row at least."""
    col = batch.column(column)
    offsets = np.frombuffer(col.buffers()[1], dtype=_offset_type(col.type))[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _offset_type(kind: pa.DataType) -> type:
    return np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets in them; null counts as empty."""
    offsets = np.frombuffer(col.buffers()[1], dtype=_offset_type(col.type))[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) from 64-bit hashes."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def seeded_table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE_HASH = seeded_table(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_HASH = _BYTE_HASH[_LOWER]
#: 1: of words (as in RAW_WORD), 2: other visible characters, 0: white space and controls.
_CLASS = np.array([1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 * (32 < b < 127) for b in range(256)], dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("b", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            _POW[key] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, base, U64))])
    return _POW["b"], _POW["i"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of texts, and n + 1 offsets of each text's words.

    With punctuation, runs of other visible characters are words too.
    """
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    if not punctuation:
        kind &= 1
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    s = np.flatnonzero(edge[:-1] & (kind > 0))
    e = np.flatnonzero(edge[1:] & (kind > 0))
    power, inverse = _powers(len(data))
    total = np.cumsum(_BYTE_HASH[data] * power[: len(data)])
    before = np.where(s > 0, total[s - 1], U64(0))
    return mix((total[e] - before) * inverse[s]), np.searchsorted(s, offsets)
