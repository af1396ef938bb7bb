"""Benchmark decontamination by the CGK embedding and bit sampling.

Texts are sequences of terms, runs of ASCII letters and digits and of all
bytes above ASCII, A-Z lower-cased.  A document is contaminated if some
stretch of it is within the edit distance limit of a benchmark item.

1. With at most e edits an item of m terms keeps a run of (m - e) / (e + 1)
   terms.  Limits are set so that this is SEED terms and more; the places
   where a document has SEED consecutive terms of an item name all windows,
   of the item's size, that need a look.  No document or place is left out.
2. The CGK random walk maps a window and its item to strings of three times
   their length: each step writes the current term, and a random bit of
   term and step decides whether to move on.  Small edit distance becomes
   small Hamming distance.  Bit sampling reads SAMPLES places; window and
   item meet if they agree there in any of several independent tables.
   Their number comes from the collision rate of items with random edits up
   to their limit, so that the chance to miss one is below 1 - RECALL.
3. What met is verified by exact edit distance of the item against any
   stretch around the window.

Items come in blocks of bounded size that pass over the documents one after
another; documents never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, documents, flat, gram_hash, map_arrow, mix, pieces, prefix_sums, range_hash

SEED = 3
#: Edits allowed, as a share of an item's terms.
EDITS = 0.2
SAMPLES = 2
RECALL = 0.99
TABLES = (4, 48)
BLOCK_BYTES = 4 << 20
#: Embeddings made at once, one window's at least.
EMBED_BYTES = 16 << 20

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and terms before each document."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(ink[1:] & (~ink[:-1] | cut))
    end = np.flatnonzero(ink[:-1] & (~ink[1:] | cut))
    return range_hash(prefix_sums(data, True), start, end), np.searchsorted(start, off)


def edit_limit(m: int, share: float = EDITS) -> int:
    """The most edits, up to the share, that leave a run of SEED terms."""
    e = int(share * m)
    while e and -(-(m - e) // (e + 1)) < SEED:
        e -= 1
    return e


def cgk_keys(x: np.ndarray, m: np.ndarray, tables: int) -> np.ndarray:
    """Bit samples of the embeddings: x (windows, places) padded, m their
    lengths; one key for each window and table."""
    n, width = x.shape
    steps = 3 * width
    out = np.zeros((steps, n, tables), U)
    at = np.zeros((n, tables), np.int64)
    row = np.arange(n)[:, None]
    table = mix(np.arange(tables, dtype=U) + U(77))
    inside = np.concatenate((x, np.zeros((n, 1), U)), axis=1)
    for t in range(steps):
        sym = inside[row, np.minimum(at, m[:, None])]
        out[t] = sym
        at += (mix(sym ^ (table + U(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) & U(1)).astype(np.int64)
    key = np.zeros((n, tables), U)
    rng = np.random.default_rng(5)
    for share in rng.random((SAMPLES, tables)):
        place = (share[None] * (3 * m)[:, None]).astype(np.int64)
        key = mix(key * U(31) + out[place, row, np.arange(tables)[None]] + U(1))
    return key


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    m = np.array([len(s) for s in seqs], np.int64)
    x = np.zeros((len(seqs), int(m.max(initial=1))), U)
    for i, s in enumerate(seqs):
        x[i, :len(s)] = s
    return x, m


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to a stretch of text, its end)."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def tables_needed(items: list[np.ndarray], limits: list[int], recall: float = RECALL, seed: int = 3) -> int:
    """How often to repeat the sampling: from the collision rate of up to 200
    items with as many random edits as their limits allow, at its lower
    decile."""
    rng = np.random.default_rng(seed)
    pairs = [(s, e) for s, e in zip(items, limits, strict=True) if e][:200]
    if not pairs:
        return TABLES[0]
    rates = []
    for s, e in pairs:
        changed = list(s)
        for _ in range(e):
            i = int(rng.integers(len(changed)))
            kind = int(rng.integers(3))
            changed[i:i + (kind != 1)] = [] if kind == 2 else [rng.integers(1 << 62)]
        changed = np.array((changed + [0] * len(s))[:len(s)], U)
        a = cgk_keys(*padded([s, changed]), 64)
        rates.append(float((a[0] == a[1]).mean()))
    rate = max(np.quantile(rates, 0.1), 0.01)
    return int(min(max(math.ceil(math.log(1 - recall) / math.log(1 - min(rate, 0.999))), TABLES[0]), TABLES[1]))


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str], edits: float = EDITS):
        h, first = terms(*flat(pa.array(texts, pa.string())))
        keep = [i for i in range(len(ids)) if first[i + 1] - first[i] >= SEED]
        self.ids = [ids[i] for i in keep]
        self.seqs = [h[first[i]:first[i + 1]] for i in keep]
        self.limits = [edit_limit(len(s), edits) for s in self.seqs]
        self.tables = tables_needed(self.seqs, self.limits)
        seeds = [gram_hash(s, SEED) for s in self.seqs]
        seed = np.concatenate(seeds) if seeds else np.zeros(0, U)
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        x, m = padded(self.seqs)
        self.keys = cgk_keys(x, m, self.tables) if self.seqs else np.zeros((0, self.tables), U)

    def find(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """(document, item id, first term, end, distance) of every item found,
        once per document and item: the closest, then the first."""
        g = gram_hash(h, SEED)
        if not len(g) or not len(self.seed):
            return []
        at = np.flatnonzero(self.seed[np.minimum(np.searchsorted(self.seed, g), len(self.seed) - 1)] == g)
        doc = np.searchsorted(first[1:], at, side="right")
        within = at + SEED <= first[1:][doc]
        at, doc = at[within], doc[within]
        lo, hi = np.searchsorted(self.seed, g[at]), np.searchsorted(self.seed, g[at], side="right")
        which = np.repeat(np.arange(len(at)), hi - lo)
        row = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(which))
        windows = np.unique(np.stack((doc[which], self.item[row], at[which] - self.place[row]), axis=1), axis=0)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        at_once = max(1, EMBED_BYTES // max(1, 3 * max(map(len, self.seqs)) * self.tables * 8))
        for i in range(0, len(windows), at_once):
            d, it, start = windows[i:i + at_once].T
            x, m = padded([h[max(a, first[k]):min(a + len(self.seqs[j]), first[k + 1])] for k, j, a in zip(d, it, start, strict=True)])
            met = (cgk_keys(x, m, self.tables) == self.keys[it]).any(axis=1)
            for k, j, a in zip(d[met].tolist(), it[met].tolist(), start[met].tolist(), strict=True):
                e, s = self.limits[j], self.seqs[j]
                if (k, j) in best and best[k, j][0] == 0:
                    continue
                lo, hi = max(first[k], a - e), min(first[k + 1], a + len(s) + e)
                dist, end = best_stretch(s, h[lo:hi])
                if dist <= e:
                    back = best_stretch(s[::-1], h[lo:lo + end][::-1])[1]
                    best[k, j] = min(best.get((k, j), (dist + 1, 0, 0)), (dist, int(lo + end - back - first[k]), int(lo + end - first[k])))
        return [(k, self.ids[j], a, b, dist) for (k, j), (dist, a, b) in sorted(best.items())]


HITS = "array<struct<item_id:long,start:long,end:long,distance:long>>"


def with_hits(docs: DataFrame, items: DataFrame, column: str = "hits", edits: float = EDITS) -> DataFrame:
    """``docs`` with all its columns and ``column``: the items found in each
    row, with the terms they take up and their edit distance.

    Null and empty texts hold none.  Items with null text or fewer than SEED
    terms are left out, items with one text are each reported.  Null and
    repeated ids of documents do no harm: rows are looked at one by one.
    Empty tables give no rows, or no hits.  ``column`` must be a new name.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    hit_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "distance")]))
    cols = docs.columns
    out = docs.withColumn(column, F.array().cast(HITS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], edits))

        def fn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            look: Items = shared.value
            for b in batches:
                for part in pieces(b):
                    hits = part.column(column).to_pylist()
                    for k, item, a, z, dist in look.find(*terms(*flat(part.column("text")))):
                        hits[k].append({"item_id": item, "start": a, "end": z, "distance": dist})
                    yield pa.record_batch({c: part.column(c) for c in cols} | {column: pa.array(hits, hit_type)})

        out = map_arrow(out, fn, out.schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.array_sort(F.col("hits.item_id")).alias("item_ids"))
