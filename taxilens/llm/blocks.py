"""Blocks of tokenised documents, words by number, and packed exchanges.

A map task cuts its stretch of the corpus into blocks of some MB of text,
whose words are told apart exactly (Arrow dictionary encoding, no hashes).
Only a block's *distinct* words are rows of Spark joins: they are counted
over all blocks and get numbers in order of frequency.  Tables keyed by such
numbers move as packed columns, a binary value per block and destination,
whose size follows the distinct keys of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Text in a block; one text at least.  It bounds what a task holds at once.
BLOCK_BYTES = 12 << 20


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with only A-Z in lower case."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def bounds(ink: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of marked bytes; none crosses ``off``."""
    before = np.zeros(len(ink) + 1, bool)
    before[1:] = ink
    after = np.zeros(len(ink) + 1, bool)
    after[:-1] = ink
    cut = np.zeros(len(ink) + 1, bool)
    cut[off] = True
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def dictionary(data: np.ndarray, ink: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs as codes into their distinct texts, in order of appearance."""
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=off[1:])
    body = np.ascontiguousarray(data[ink])
    runs = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(body)])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, compressed byte plane by byte plane."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], "<i8").tobytes()]
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if n == 0 or int(c.max()) < 1 << (8 * w - (w == 8)))
        raw = np.ascontiguousarray(c.astype(f"<u{width}")).view(np.uint8).reshape(n, width)
        out += [bytes([width]), np.ascontiguousarray(raw.T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, "<i8", 2).tolist()
    if not n:
        return [np.zeros(0, np.int64) for _ in range(k)]
    at, out = 16, []
    for _ in range(k):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of an ascending column, the first against 0; cumsum undoes it."""
    return np.diff(sorted_values, prepend=0)


def order_of(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative keys.  Where key and place fit in 63 bits
    they are sorted as one number, several times faster than by argsort."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    most, bits = int(key.max()), max(1, (n - 1).bit_length())
    if most < 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    if most >= 1 << (63 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key.astype(np.int64) << bits) | np.arange(n)) & ((1 << bits) - 1)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, the place of each row's among them, and the
    first row of each."""
    order = order_of(key)
    in_order = key[order]
    new = np.ones(len(key), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return in_order[new], inverse, order[new]


def joined_key(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key per row, in the rows' lexicographic order, exact: what
    would not fit in 63 bits is ranked first."""
    key = columns[0]
    for c in columns[1:]:
        span = int(c.max()) + 1 if len(c) else 1
        if len(key) and (int(key.max()) + 1) * span >= 1 << 63:
            key = grouped(key)[1]
        key = key * span + c
    return key


def dealt_to(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The destination, below ``parts``, of each row, from all of its columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.int64)


def dealt(columns: list[np.ndarray], values: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows in order of their columns, packed by destination: the steps of the
    first column, the others, and the values."""
    to = dealt_to(columns, parts)
    order = order_of(to)
    cut = np.searchsorted(to[order], np.arange(parts + 1))
    for p in range(parts):
        rows = order[cut[p]:cut[p + 1]]
        if len(rows):
            yield p, pack(steps(columns[0][rows]), *(c[rows] for c in columns[1:]), *(v[rows] for v in values))


def numbered(rows: DataFrame, order: list[Column], name: str, first: int = 0, column: str = "id") -> DataFrame:
    """``rows`` written in ``order`` with consecutive numbers from ``first``.
    Numbers come from places inside sorted partitions and from sums over the
    partitions before; only these sums, a row a partition, meet."""
    place = F.monotonically_increasing_id()
    rows = rows.sort(*order).select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    rows = written(rows, name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(parts), "__part").withColumn(column, F.col("__at") + F.col("__before") + F.lit(first)).drop("__part", "__at", "__before")
