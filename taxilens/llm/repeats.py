"""Windows of a fixed number of units (bytes or words) that occur in several
texts: how they are found, and which document has each first.

1. A window's anchor is the smallest hash among its k-grams, so equal windows
   have equal anchors.  Consecutive windows with one anchor are a segment.
2. Anchors that only one text has cannot hold a shared window; an index of
   (anchor, text) pairs drops them.
3. The segments of the other anchors are shared out by anchor.  A segment
   that is the only one of its anchor needs no search: all its windows lie
   in its holders.  Where an anchor has different segments, they go to
   shards, and a shard's index finds which windows equal which, and the
   smallest document of each.  An anchor whose segments have more than
   ANCHOR_BYTES goes to no shard: its windows become rows of their own, and
   the smallest document of equal ones is an aggregate.
4. Segments hand that document back to all their holders; those with a
   larger id lose the window.

Exact copies of a text, told by SHA-256, are left out from the start: each
but the one with the smallest id loses everything.  A row is told by its id
and a 64-bit hash of its text (version).  The index of anchors has 48 bits
of either; texts that agree in those keep all their anchors.

Occurrences are positions; only of the segments that are searched, bytes
move: each is cut from the text of one of its holders.  No anchor with many
segments is one group, so a hot text or passage never meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BYTES, U, Words, flat, gram_hash, map_arrow, mix, pieces, powers, prefix_sums, range_hash, ranges, release, rolling_hash, written

NO_ID = -(1 << 63)
#: Windows in a segment at most; periodic texts have one anchor throughout.
CAP = 256
FLUSH = 1 << 19
#: Texts in a sort of pairs at most: 16 bits beside an anchor's 48.
TEXTS = 1 << 16
PIECE_BYTES = 1 << 20
LOW48 = (1 << 48) - 1
#: Shards for each shuffle partition, at least.
SHARDS = 8
#: Bytes of segments in a shard on average, at most: a shard is searched in memory.
SHARD_BYTES = 2 << 20
#: Bytes of the distinct segments of an anchor that still go to one shard.
ANCHOR_BYTES = 1 << 18
#: The shard of segments that go to none.
WIDE = -1


@dataclass
class Units:
    """A piece of the column as units: units before each document, the byte
    bounds of units, and, made when asked for, prefix sums for hashes of
    ranges and the hash of the k-gram at each unit."""
    first: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    data: np.ndarray
    sum_up: Callable[[], np.ndarray]
    hash_grams: Callable[[np.ndarray], np.ndarray]

    @cached_property
    def sums(self) -> np.ndarray:
        return self.sum_up()

    @cached_property
    def gram(self) -> np.ndarray:
        return self.hash_grams(self.sums)

    def size(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Their number of bytes."""
        return b - a if self.start is None else self.end[b - 1] - self.start[a]

    def payload(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The bytes of the units [a, b), for each pair."""
        if self.start is not None:
            a, b = self.start[a], self.end[b - 1]
        off = np.zeros(len(a) + 1, np.int32)
        np.cumsum(b - a, out=off[1:])
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(self.data[ranges(a, b - a)])])


def byte_units(k: int) -> Callable[[np.ndarray, np.ndarray], Units]:
    def read(data: np.ndarray, off: np.ndarray) -> Units:
        return Units(off, None, None, data, lambda: prefix_sums(data), lambda p: rolling_hash(p, k))
    return read


def word_units(k: int) -> Callable[[np.ndarray, np.ndarray], Units]:
    def read(data: np.ndarray, off: np.ndarray) -> Units:
        w = Words(data, off)
        hashes = cache(w.hashes)

        def sum_up() -> np.ndarray:
            h = hashes()
            p = np.zeros(len(h) + 1, U)
            np.cumsum(h * powers(0x5851F42D4C957F2D, len(h))[:len(h)], out=p[1:])
            return p

        return Units(w.first, w.start, w.end, data, sum_up, lambda _: gram_hash(hashes(), k))
    return read


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if have < width else v


def segments(u: Units, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first unit, windows, anchor) of every segment."""
    count = np.maximum(0, np.diff(u.first) - window + 1)
    full = np.flatnonzero(count)
    if not len(full):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U),)
    start, end = u.first[full], u.first[full] + count[full]
    v = sliding_min(u.gram, window - k + 1)
    change = np.ones(len(v) + 1, bool)
    np.not_equal(v[1:], v[:-1], out=change[1:-1])
    change[start] = change[end] = True
    new = np.flatnonzero(change)
    size = np.diff(new)
    new = new[:-1]
    doc = np.searchsorted(end, new, side="right")
    inside = (doc < len(full)) & (new >= start[np.minimum(doc, len(full) - 1)])  # no window crosses documents
    doc, new, size = full[doc[inside]], new[inside], size[inside]
    parts = -(-size // CAP)
    place = ranges(np.zeros(len(new), np.int64), parts) * CAP
    s = np.repeat(new, parts) + place
    return np.repeat(doc, parts), s, np.minimum(CAP, np.repeat(size, parts) - place), v[s]


def byte_keys(payload: bytes, window: int) -> list[bytes]:
    """128-bit digests of the windows of a segment, in order."""
    return [hashlib.blake2b(payload[i:i + window], digest_size=16).digest() for i in range(len(payload) - window + 1)]


def word_keys(payload: bytes, window: int) -> list[bytes]:
    w = payload.split()  # bytes split at exactly the six bytes of white space
    return [hashlib.blake2b(b" ".join(w[i:i + window]), digest_size=16).digest() for i in range(len(w) - window + 1)]


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of 12 bytes: the low 48 bits of each."""
    out = np.empty((len(a), 12), np.uint8)
    out[:, :6] = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    out[:, 6:] = np.ascontiguousarray(b, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return out


def unpacked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    r = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 12)
    both = []
    for half in (r[:, :6], r[:, 6:]):
        wide = np.zeros((len(r), 8), np.uint8)
        wide[:, :6] = half
        both.append(wide.reshape(-1).view("<u8"))
    return both[0], both[1]


def dealt(key: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows by bucket of their key: (buckets that have any, their bytes)."""
    b = (key % U(buckets)).astype(np.uint16 if buckets <= TEXTS else np.int64)  # 16 bits are sorted by counting
    size = np.bincount(b, minlength=buckets)
    at = np.concatenate(([0], np.cumsum(size)))
    full = np.flatnonzero(size)
    rows = rows.view(f"V{rows.shape[1]}").reshape(-1)[np.argsort(b, kind="stable")]
    return full, [rows[at[i]:at[i + 1]].tobytes() for i in full]


def firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Which rows, sorted by these keys, differ from the row before."""
    out = np.zeros(len(sorted_keys[0]), bool)
    out[:1] = True
    for k in sorted_keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def in_several(first: np.ndarray) -> np.ndarray:
    """Which rows are not alone, by the marks of :func:`firsts`."""
    out = ~first
    out[:-1] |= ~first[1:]
    return out


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Repeats:
    """The search over ``docs``, for one kind of unit; ``length`` is the
    number of units of a text.

    search(payloads, docs, window) -> (segment, first window, windows,
    document) is what a shard does with its distinct segments;
    keys(payload, window) tells the windows of one segment apart.
    """

    def __init__(self, docs: DataFrame, units: Callable[[np.ndarray, np.ndarray], Units], length: Column, window: int, k: int, search, keys: Callable[[bytes, int], list[bytes]]):
        self.length = length
        self.spark = docs.sparkSession
        self.units, self.window, self.k, self.search, self.keys = units, window, k, search, keys
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", text_hash(F.col("text")).alias("version"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))

    def _pairs(self) -> DataFrame:
        """(bucket, known, pairs): packed anchors and texts.  Those of an anchor
        that a task sees in several texts are known to be shared and dealt by
        text; two of them, and all others, are dealt by anchor."""
        units, window, k, buckets = self.units, self.window, self.k, self.buckets

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, versions, texts, size = [], [], 0, 0

            def out():
                v, nth = np.unique(np.concatenate(versions) & U(LOW48), return_inverse=True)
                both = np.concatenate(held)
                both = np.sort((both & ~U(TEXTS - 1)) | nth.astype(U)[(both & U(TEXTS - 1)).astype(np.int64)])
                both = both[firsts(both)]
                a, v = both >> U(16), v[(both & U(TEXTS - 1)).astype(np.int64)]
                first = firsts(a)
                shared, two = in_several(first), first.copy()
                two[1:] |= first[:-1]
                rows = packed(a, v)
                full, raw = dealt(a[two], rows[two], buckets)
                sure, more = dealt(v[shared], rows[shared], buckets)
                return pa.record_batch({"bucket": pa.array(np.concatenate((full, sure))), "known": pa.array([False] * len(full) + [True] * len(sure)), "pairs": pa.array(raw + more, pa.binary())})

            for b in batches:
                for part in pieces(b, limit=PIECE_BYTES):
                    doc, _, _, anchor = segments(units(*flat(part.column("text"))), window, k)
                    if not len(doc):
                        continue
                    new = firsts(doc)
                    if texts + np.count_nonzero(new) > TEXTS and texts:
                        yield out()
                        held, versions, texts, size = [], [], 0, 0
                    held.append((anchor << U(16)) | (np.cumsum(new) + (texts - 1)).astype(U))
                    versions.append(part.column("version").to_numpy().astype(U)[doc[new]])
                    texts += len(versions[-1])
                    size += len(doc)
                    if size > FLUSH:
                        yield out()
                        held, versions, texts, size = [], [], 0, 0
            if size:
                yield out()

        return map_arrow(self.docs.select("version", "text"), fn, "bucket long, known boolean, pairs binary")

    def _shared_anchors(self, pairs: DataFrame) -> DataFrame:
        """(low, anchors): of each text, by 48 bits of its version, the anchors
        that other texts have too."""
        buckets = self.buckets

        def both(rows: pd.DataFrame) -> pd.DataFrame:
            known = rows["known"].to_numpy(bool)
            passed = rows.loc[known, ["bucket", "pairs"]]
            a, v = unpacked(rows.loc[~known, "pairs"].tolist())
            if not len(a):
                return passed
            order = np.argsort(a)
            order = order[in_several(firsts(a[order]))]
            a, v = a[order], v[order]
            order = np.lexsort((v, a))
            a, v = a[order], v[order]
            once = firsts(a, v)
            a, v = a[once], v[once]
            again = in_several(firsts(a))
            full, raw = dealt(v[again], packed(a[again], v[again]), buckets)
            return pd.concat((passed, pd.DataFrame({"bucket": full, "pairs": raw})))

        def by_text(rows: pd.DataFrame) -> pd.DataFrame:
            a, v = unpacked(rows["pairs"].tolist())
            order = np.lexsort((a, v))
            a, v = a[order], v[order]
            once = firsts(a, v)
            a, v = a[once], v[once]
            at = np.append(np.flatnonzero(firsts(v)), len(v))
            return pd.DataFrame({"low": v[at[:-1]].astype(np.int64), "anchors": [a[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]})

        two = pairs.groupBy("bucket").applyInPandas(both, "bucket long, pairs binary")
        return two.groupBy("bucket").applyInPandas(by_text, "low long, anchors binary")

    def _occurrences(self, texts: DataFrame) -> DataFrame:
        """(anchor, seg, version, id, pos, n, size) of segments of shared
        anchors; size is in bytes.  Null anchors stand for all there are."""
        units, window, k = self.units, self.window, self.k

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in pieces(b, limit=PIECE_BYTES):
                    u = units(*flat(part.column("text")))
                    doc, at, n, anchor = segments(u, window, k)
                    if not len(doc):
                        continue
                    low = anchor & U(LOW48)
                    cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    keep = np.zeros(len(doc), bool)
                    for i, have in enumerate(part.column("anchors")):
                        if not have.is_valid:
                            keep[cut[i]:cut[i + 1]] = True
                            continue
                        x = np.frombuffer(have.as_py(), "<u8")
                        mine = low[cut[i]:cut[i + 1]]
                        keep[cut[i]:cut[i + 1]] = x[np.minimum(np.searchsorted(x, mine), len(x) - 1)] == mine
                    doc, at, n, low = doc[keep], at[keep], n[keep], low[keep]
                    end = at + n + window - 1
                    seg = mix(range_hash(u.sums, at, end) ^ low).view(np.int64)
                    yield pa.record_batch({"anchor": pa.array(low.astype(np.int64)), "seg": pa.array(seg), "version": part.column("version").take(pa.array(doc)), "id": part.column("id").take(pa.array(doc)),
                                           "pos": pa.array(at - u.first[doc]), "n": pa.array(n), "size": pa.array(u.size(at, end).astype(np.int32))})

        return map_arrow(texts.select("id", "version", "anchors", "text"), fn, "anchor long, seg long, version long, id long, pos long, n long, size int")

    def _cut(self, segs: DataFrame, *keep: str) -> DataFrame:
        """(keep.., payload) of distinct segments (keep.., n, least, version,
        pos): a text that holds some is read once and cut.  Of rows equal in
        id and text more than one may be cut."""
        units, window = self.units, self.window
        lists = written(segs.groupBy(F.col("least").alias("id"), "version").agg(F.collect_list(F.struct("pos", "n", *keep)).alias("segs")), "repeat-holders")
        release(self.spark)  # the texts are shuffled next

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for b in batches:
                for part in pieces(b, limit=PIECE_BYTES):
                    rows = list(zip(part.column("id").to_pylist(), part.column("version").to_pylist(), strict=True))
                    new = [i for i, r in enumerate(rows) if r != (rows[i - 1] if i else last)]
                    last = rows[-1]
                    if len(new) < len(rows):
                        part = part.take(pa.array(new, pa.int64()))
                    u = units(*flat(part.column("text")))
                    x = part.column("segs")
                    doc = np.repeat(np.arange(part.num_rows), x.value_lengths().to_numpy())
                    x = x.flatten()
                    at = u.first[doc] + x.field("pos").to_numpy()
                    end = at + x.field("n").to_numpy() + window - 1
                    for i in range(0, len(at), 50_000):
                        s = slice(i, i + 50_000)
                        yield pa.record_batch({c: x.field(c)[s] for c in keep} | {"payload": u.payload(at[s], end[s])})

        texts = self.docs.select("id", "version", "text").join(lists, ["id", "version"])
        return map_arrow(texts.select("id", "version", "text", "segs"), fn, ", ".join([*(f"{c} long" for c in keep), "payload binary"]))

    def _found(self, occ: DataFrame) -> DataFrame:
        """(seg, o, n, least): n windows of a segment from its o-th on, and the
        smallest document that has them."""
        search, window = self.search, self.window
        # the holder is a row of the least id; of several, both see the same one first
        stats = written(occ.groupBy("anchor", "seg").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("n").alias("n"), F.min("size").alias("size"),
                                                         F.min_by("version", "id").alias("version"), F.min_by("pos", "id").alias("pos")), "repeat-segments")
        per = written(stats.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.sum("size").alias("bytes")).where("segs > 1"), "repeat-per-anchor")
        alone = stats.where(F.col("least") < F.col("most")).join(per, "anchor", "left_anti").select("seg", F.lit(0).cast("long").alias("o"), "n", "least")
        narrow = F.col("bytes") <= ANCHOR_BYTES
        shards = max(self.buckets * SHARDS, -(-(per.where(narrow).agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
        shard = F.when(narrow, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(WIDE).cast("long")
        several = stats.join(per, "anchor").select(shard.alias("shard"), "seg", "least", "most", "n", "version", "pos")
        # one pass over the texts for all: they are as large as all else together
        rows = written(self._cut(several, "shard", "seg", "least", "most"), "repeat-payloads")
        release(self.spark)

        def fn(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("seg")
            s, o, n, least = search(rows["payload"].tolist(), rows["least"].to_numpy(), window)
            own, most = rows["least"].to_numpy()[s], rows["most"].to_numpy()[s]
            use = (least < own) | (own < most)
            return pd.DataFrame({"seg": rows["seg"].to_numpy()[s[use]], "o": o[use], "n": n[use], "least": least[use]})

        found = alone.unionByName(rows.where(F.col("shard") != WIDE).groupBy("shard").applyInPandas(fn, "seg long, o long, n long, least long"))
        return found if per.where(~narrow).isEmpty() else found.unionByName(self._found_wide(rows.where(F.col("shard") == WIDE)))

    def _found_wide(self, rows: DataFrame) -> DataFrame:
        """As :meth:`_found`, for segments (seg, least, most, payload) of wide
        anchors: a row per window of a distinct segment."""
        keys, window = self.keys, self.window

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    part = b.slice(i, 1000)
                    each = [keys(p.as_py(), window) for p in part.column("payload")]
                    n = np.array([len(x) for x in each], np.int64)
                    at = pa.array(np.repeat(np.arange(len(n)), n))
                    yield pa.record_batch({c: part.column(c).take(at) for c in ("seg", "least", "most")} | {"o": pa.array(ranges(np.zeros(len(n), np.int64), n)), "key": pa.array([k for x in each for k in x], pa.binary())})

        windows = written(map_arrow(rows, cut, "seg long, least long, most long, o long, key binary"), "repeat-windows")
        first = windows.groupBy("key").agg(F.min("least").alias("first"))
        lost = windows.join(first, "key").where((F.col("first") < F.col("least")) | (F.col("least") < F.col("most")))
        lost = lost.groupBy("seg").agg(F.array_sort(F.collect_set(F.struct("o", "first"))).alias("lost"))

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("lost")
                size = x.value_lengths().to_numpy()
                flat_ = x.flatten()
                s, o, n, least = window_runs(np.repeat(np.arange(b.num_rows), size), flat_.field("o").to_numpy(), flat_.field("first").to_numpy())
                yield pa.record_batch({"seg": b.column("seg").take(pa.array(s)), "o": pa.array(o), "n": pa.array(n), "least": pa.array(least)})

        return map_arrow(lost, runs, "seg long, o long, n long, least long")

    def actions(self) -> DataFrame:
        """(id, version, spans): what documents lose.  Spans are pairs of
        units, sorted and merged, as int64; null stands for everything.
        Documents that lose nothing are not listed."""
        key = text_key(F.col("text")).alias("key")
        sets = written(self.docs.select("id", "version", key, self.length.alias("n")), "repeat-sets")
        first = sets.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("n").alias("n"), F.min("version").bitwiseAND(F.lit(LOW48)).alias("low"))
        first = written(first.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("low"))), "repeat-texts")
        shared = written(self._shared_anchors(self._pairs()), "repeat-anchors")
        release(self.spark)
        shared = first.select("low", "key", "texts", F.col("first").alias("id")).join(shared, "low", "left").where((F.col("texts") > 1) | F.col("anchors").isNotNull())
        shared = shared.select("key", "id", F.when(F.col("texts") == 1, F.col("anchors")).alias("anchors"))
        occ = written(self._occurrences(self.docs.select("id", "version", key, "text").join(shared, ["key", "id"])), "repeat-occurrences")
        release(self.spark)
        found = written(self._found(occ), "repeat-found")
        window = self.window
        spans = occ.select("seg", "version", "id", "pos").join(found, "seg").where(F.col("least") < F.col("id"))
        a = F.col("pos") + F.col("o")
        spans = spans.groupBy("id", "version").agg(F.collect_set(F.struct(a.alias("a"), (a + F.col("n") + F.lit(window - 1)).alias("b"))).alias("spans"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i in range(b.num_rows):
                    x = b.column("spans")[i].values
                    out.append(merged(x.field("a").to_numpy(), x.field("b").to_numpy()).tobytes())
                yield pa.record_batch({"id": b.column("id"), "version": b.column("version"), "spans": pa.array(out, pa.binary())})

        spans = map_arrow(spans, merge, "id long, version long, spans binary")
        copies = sets.join(first.where(F.col("first") < F.col("last")).select("key", "first"), "key").where((F.col("id") > F.col("first")) & (F.col("n") >= window))
        return written(spans.unionByName(copies.select("id", "version", F.lit(None).cast("binary").alias("spans")).distinct()), "repeat-actions")

    def apply(self, fn, schema: str) -> DataFrame:
        """``fn`` over batches (doc_id, text, listed, spans) of all documents."""
        todo = self.actions().withColumn("listed", F.lit(True))
        if (todo.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length("spans"), F.lit(0)))).first()[0] or 0) <= SMALL_BYTES:
            todo = F.broadcast(todo)
        rows = self.docs.join(todo, ["id", "version"], "left").select("doc_id", "text", F.coalesce("listed", F.lit(False)).alias("listed"), "spans")
        return map_arrow(rows, fn, schema)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximal runs of the intervals [a, b), as pairs."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    last = np.append(new[1:], True)
    return np.stack((a[new], b[last]), axis=1).astype("<i8")


def window_runs(owner: np.ndarray, place: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, o, n, least) from windows in order of segment and place."""
    if not len(owner):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1))))
    return owner[new], place[new], np.diff(np.append(new, len(owner))), least[new]
