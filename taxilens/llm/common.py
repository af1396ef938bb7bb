"""Helpers shared by the operators of this subpackage.

Text is handled in two ways.  Where a byte-level rule is enough (ASCII white
space, ASCII case), tasks work on the flat UTF-8 buffer of an Arrow column
with numpy: word bounds, word hashes and shingles come out of a few vector
passes.  Where code points matter, tasks use Python strings.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxilens.session import prepare, scratch_path

#: ``[^\x20\x09-\x0D]+`` is a word in every contract of this subpackage.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True

#: Text handled at once by the numpy passes of one task.
CHUNK_BYTES = 2 << 20

U = np.uint64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A given table; the path may be any that Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet under a fresh name in the shared checkpoint
    folder and read back: it cuts the lineage, and what follows survives the
    loss of executors without running the earlier stages again.  Shuffle
    files of the stages before it are of no more use; Spark frees them when
    the driver's JVM collects its garbage, so it is asked to."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    schema = df.schema
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees shuffle files of plans that nothing refers to any more: those of
    a frame that the last ``written`` was given, too, which its caller still
    held while it ran."""
    spark.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (two multiply-xorshift rounds)."""
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def _byte_values(fold_case: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if fold_case:
        v[65:91] = v[97:123]
    return v


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        out = np.full(size, base, dtype=U)
        out[0] = 1
        np.cumprod(out, out=out)
        if n > 4 * CHUNK_BYTES:  # one long text; not worth keeping
            return out
        _POW[base] = have = out
    return have


def prefix_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Prefix sums P of value(byte) * base**i; see :func:`range_hash`."""
    p = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_VALUES[fold_case][data] * powers(_BASE, len(data))[:len(data)], out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end): equal strings have equal hashes
    wherever they lie.  64 bits."""
    ipw = powers(_INV, len(p))
    return mix((p[end] - p[start]) * ipw[start] + (end - start).astype(U))


def rolling_hash(p: np.ndarray, k: int) -> np.ndarray:
    """:func:`range_hash` of every k consecutive bytes."""
    n = max(0, len(p) - k)
    return mix((p[k:k + n] - p[:n]) * powers(_INV, len(p))[:n] + U(k))


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offs, body = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(body, dtype=np.uint8)[off[0]:off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, at least one row each."""
    if batch.num_rows == 0:
        return
    arr = batch.column(column).cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, .. (counts[i] values) for every i, joined."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - begin, counts)


class Words:
    """Word bounds of a piece of the column: ``start``/``end`` byte positions,
    ``first`` (n+1): words before each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        ink = ~IS_SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = ink
        after = np.empty(len(data) + 1, bool)
        after[-1] = False
        after[:-1] = ink
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        self.start = np.flatnonzero(after & (~before | cut))
        self.end = np.flatnonzero(before & (~after | cut))
        self.first = np.searchsorted(self.start, off)
        self.data, self.off = data, off

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        return range_hash(prefix_sums(self.data, fold_case), self.start, self.end)


_M = U(0x2545F4914F6CDD1D)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(h) - k + 1 values; those
    that cross documents are the caller's to leave out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _M
        out += h[j:n + j]
    return mix(out + U(k))


#: What tasks of an operator keep in a Python worker for their next ones, by
#: name; tasks of other operators free it before they start.  Powers are made
#: anew by the tasks that need them.
KEPT: dict[str, dict] = {"powers": _POW}


def _free(keep: str | None) -> None:
    """At the top of the module, so that a task finds this worker's ``KEPT``:
    what a function inside another refers to is sent along as a copy."""
    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()


def _give_back() -> None:
    """Memory that the task no longer uses goes back to the system: a worker
    that waits for its next task, maybe of another operator, holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: str | None = None) -> DataFrame:
    """``mapInArrow``; workers free what other operators keep, but ``keep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _free(keep)
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


#: The side of a join that is broadcast if it has at most so many bytes.
SMALL_BYTES = 24 << 20


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows come to no more than
    SMALL_BYTES; otherwise Spark joins it by shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= SMALL_BYTES else table


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with one value of ``key`` after another, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = 0
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for c in cut.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, c - at)])
            held, at = [], c
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def word_count(text="text"):
    """Number of words of a text as a column; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def union_find(n: int) -> tuple[Callable[[int], int], Callable[[int, int], bool]]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        parent[max(i, j)] = min(i, j)
        return True

    return find, join
