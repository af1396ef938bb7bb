"""Substring dedup of words: a word covered by a window of 50 words that also
starts in a document with a smaller id is removed.

Each shard of segments (see :mod:`repeats`) has an FM-index of its strings;
the segments are streamed through it backwards, and places whose matching
statistic reaches 50 learn the first document of their window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, word_count
from .fm_index import FMIndex
from .repeats import Repeats, window_runs, word_keys, word_units

WINDOW = 50
GRAM = 8


def fm_search(payloads: list[bytes], docs: np.ndarray, window: int):
    """For the windows of each payload, the least document with an equal one."""
    size = np.array([len(p) for p in payloads], np.int64)
    w = Words(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate(([0], np.cumsum(size))))
    names, ids = np.unique(w.hashes(), return_inverse=True)
    strings = [ids[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    index = FMIndex(strings, len(names))
    run = index.depth_run(window)
    least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, docs[index.owner[index.sa]])
    owner, place, match = index.matching(strings, window)
    return window_runs(owner, place, least[match])


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``; kept is
    the remaining words joined by one space, as UTF-8.

    Null text has no words.  A null id is smaller than any other.  Of rows
    with equal ids neither makes the other lose anything.  Texts shorter than
    a window lose nothing.  An empty table gives no rows.  Other columns are
    not read.
    """
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, left = [], [], []
            for text, listed, spans in zip(b.column("text"), b.column("listed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.as_py().encode().split()  # bytes split at exactly these six bytes
                n.append(len(words))
                if spans is not None:
                    cuts = [0, *np.frombuffer(spans, "<i8").tolist(), len(words)]
                    words = [x for i in range(0, len(cuts), 2) for x in words[cuts[i]:cuts[i + 1]]]
                elif listed:
                    words = []
                gone.append(n[-1] - len(words))
                left.append(b" ".join(words))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(left, pa.binary())})

    found = Repeats(docs, word_units(GRAM), word_count(), window, GRAM, fm_search, word_keys)
    return found.apply(fn, "doc_id long, n_words long, n_removed long, kept binary")


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

