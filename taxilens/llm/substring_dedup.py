"""Suffix-array dedup of byte strings: every byte covered by a 50-byte string
that also starts in a document with a smaller id is removed.

Shards of segments (see :mod:`repeats`) are sorted by induced sorting over
prefix doubling (:mod:`suffix`); suffixes whose common prefix is 50 and more are one
string, whose first document is the least of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prefix_sums, ranges, rolling_hash
from .repeats import Repeats, byte_keys, byte_units, firsts, in_several, window_runs
from .suffix import sort_suffixes

WINDOW = 50
GRAM = 24


def suffix_search(payloads: list[bytes], docs: np.ndarray, window: int):
    """For the windows of each payload, the least document with an equal one."""
    size = np.array([len(p) for p in payloads], np.int64)
    start = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\0".join(payloads) + b"\0", np.uint8)
    count = np.maximum(size - window + 1, 0)
    at, owner = ranges(start, count), np.repeat(np.arange(len(size)), count)
    # equal windows have equal hashes, so the sort needs no more of a segment than its windows whose hash comes again
    hashes = rolling_hash(prefix_sums(data), window)[at]
    order = np.argsort(hashes)
    again = np.sort(order[in_several(firsts(hashes[order]))])
    out = docs[owner]
    if len(again):
        head = np.flatnonzero(firsts(owner[again]))
        first, last = again[head], again[np.append(head[1:], len(again)) - 1]
        size = at[last] - at[first] + window
        raw = np.zeros(int(size.sum()) + len(size), np.uint16)
        begin = np.cumsum(size + 1) - size - 1
        raw[ranges(begin, size)] = data[ranges(at[first], size)].astype(np.uint16) + 1
        sa, lcp = sort_suffixes(raw)
        whole = np.repeat(docs[owner[first]], size + 1)[sa]
        least = np.empty(len(raw), docs.dtype)
        head = np.flatnonzero(lcp < window)
        least[sa] = np.repeat(np.minimum.reduceat(whole, head), np.diff(np.append(head, len(sa))))
        n = last - first + 1
        out[ranges(first, n)] = least[ranges(begin, n)]
    return window_runs(owner, at - start[owner], out)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``;
    kept is what is left of the UTF-8 bytes.

    Null text is empty.  A null id is smaller than any other.  Of rows with
    equal ids neither makes the other lose anything.  Texts shorter than a
    window lose nothing.  An empty table gives no rows.  Other columns are
    not read.
    """
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, listed, spans in zip(b.column("text"), b.column("listed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs = np.frombuffer(spans, "<i8").reshape(-1, 2) if spans is not None else np.array([[0, len(raw)]] if listed else [], np.int64).reshape(-1, 2)
                cuts = np.concatenate(([0], runs.ravel(), [len(raw)])).tolist()
                kept = b"".join(raw[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2)) if len(runs) else raw
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept"].append(kept)
            yield pa.record_batch({"doc_id": b.column("doc_id")} | {k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    found = Repeats(docs, byte_units(GRAM), F.octet_length("text").cast("long"), window, GRAM, suffix_search, byte_keys)
    return found.apply(fn, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

