"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact
intersection.

1. Every text becomes the sorted set of its 5-word shingles (64-bit hashes);
   equal sets are one class from here on, so exact copies cost one member.
2. Two sets with 100 |A n B| >= 80 |A u B| share one of the first
   n - ceil(0.8 n) + 1 shingles of each, in any common order.  The order is
   rare before frequent, then by hash.  An index of these prefixes gives
   lists of classes that share a shingle; equal lists count once.
3. Lists are cut into tiles of members next in size.  In a tile, members in
   the size band of each other are compared by bitmaps: A xor B differs in
   no more bits than A and B in elements, which bounds the overlap from
   above.  What passes is decided by exact intersection of the sorted
   arrays.  Pairs that are connected already are not looked at, and a tile
   returns a spanning forest of its links, so no group is ever expanded
   into its pairs.
   First round: each class in one of its lists, inside tiles.  Second: the
   lists that still span several components, all pairs of their tiles; the
   pairs that bitmaps leave open are joined to groups, whose tiles are then
   decided.  Classes whose bitmaps rule out every partner never move arrays.
4. Links make components.

Exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import U, Words, documents, flat, gram_hash, map_arrow, pieces, runs_of, small, union_find, written
from .graph import components

SHINGLE = 5
#: Links need 100 * intersection >= NUM * union.
NUM = 80
#: Shingles that tasks have seen so often in several of their documents come
#: last in the order, at most HEAVY_MAX of them (an order needs no more; it
#: changes cost, never results).
HEAVY = 64
HEAVY_MAX = 1 << 17
TILE = 128
FLUSH = 1 << 20


def need(a, b):
    """Least intersection of sets of these sizes that links them."""
    return -((-NUM * (a + b)) // (100 + NUM))


def prefix_length(n: int) -> int:
    return n - (NUM * n + 99) // 100 + 1


def shingle_sets(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every document of a piece."""
    w = Words(data, off)
    h = w.hashes(fold_case=True)
    g = gram_hash(h, SHINGLE)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a:b - SHINGLE + 1])
        else:
            yield gram_hash(h[a:b], b - a) if b > a else np.zeros(0, U)


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray) -> np.ndarray:
    """2n to 4n bits, a power of two, in words of 64."""
    bits = 1 << max(8, int(2 * len(s) - 1).bit_length())
    out = np.zeros(bits // 64, U)
    at = s & U(bits - 1)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that fewer bits would have given."""
    return np.bitwise_or.reduce(m.reshape(-1, words), axis=0)


def scan_sets(docs: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass: (doc_id, version, n, key, bits) of
    every document, and (token, seen) of shingles that lie in several documents of
    one task's stretch."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated():
            t = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            c = np.diff(np.append(at, len(t)))
            t, c = t[at][c > 1], c[c > 1]
            none = pa.nulls(len(t), pa.int64())
            return pa.record_batch({"doc_id": none, "version": none, "n": none, "key": none, "bits": pa.nulls(len(t), pa.binary()), "token": pa.array(t.view(np.int64)), "seen": pa.array(c.astype(np.int64))})

        for b in batches:
            for part in pieces(b):
                n, key, bits = [], [], []
                for s in shingle_sets(*flat(part.column("text"))):
                    n.append(len(s))
                    bits.append(bitmap(s).tobytes() if len(s) else None)
                    key.append(set_key(s))
                    held.append(s)
                    size += len(s)
                none = pa.nulls(len(n), pa.int64())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "version": part.column("version"), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.int64()), "bits": pa.array(bits, pa.binary()), "token": none, "seen": none})
                if size > 4 * FLUSH:
                    yield repeated()
                    held, size = [], 0
        if size:
            yield repeated()

    return map_arrow(docs, fn, "doc_id long, version long, n long, key long, bits binary, token long, seen long")


def prefix_index(docs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, index): packed (token, class, size) of all prefixes, by token."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    kind = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<u4")])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        held, size = [], 0

        def out():
            r = np.unique(np.concatenate(held))  # copies in one stretch go here
            bucket = (r["token"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            return pa.record_batch({"bucket": pa.array(full), "index": pa.array([r[order[at[k]:at[k + 1]]].tobytes() for k in full], pa.binary())})

        for b in batches:
            for part in pieces(b):
                for s in shingle_sets(*flat(part.column("text"))):
                    if not len(s):
                        continue
                    take = prefix_length(len(s))
                    t = s
                    if len(last):
                        often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        t = np.concatenate((s[~often], s[often]))
                    r = np.empty(take, kind)
                    r["token"], r["key"], r["n"] = t[:take], set_key(s), len(s)
                    held.append(r)
                    size += take
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return map_arrow(docs.select("text"), fn, "bucket long, index binary")


def shared_lists(index: DataFrame) -> DataFrame:
    """(list, key, n): the classes that share a shingle of their prefixes and
    have another one in their size band; equal lists of a bucket once."""
    kind = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<u4")])

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([np.frombuffer(x, kind) for x in rows["index"]])
        order = np.argsort(r["token"], kind="stable")
        t = r["token"][order]
        again = np.zeros(len(t), bool)
        again[1:] = t[1:] == t[:-1]
        r = r[order[again | np.append(again[1:], False)]]
        r = np.unique(r)
        at = np.append(np.flatnonzero(np.concatenate(([True], r["token"][1:] != r["token"][:-1]))), len(r)) if len(r) else np.zeros(1, np.int64)
        done, out = set(), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a < 2:
                continue
            n = np.sort(r["n"][a:b]).astype(np.int64)
            if not (NUM * n[1:] <= 100 * n[:-1]).any():
                continue
            keys = r["key"][a:b]
            name = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)
            if name not in done:
                done.add(name)
                out.append(pd.DataFrame({"list": name, "key": keys, "n": r["n"][a:b].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"list": [], "key": [], "n": []}).astype("int64")

    return index.groupBy("bucket").applyInPandas(fn, "list long, key long, n long").distinct()


def class_arrays(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the wanted classes, from one document each."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                yield pa.record_batch({"key": part.column("key"), "tokens": pa.array([s.tobytes() for s in shingle_sets(*flat(part.column("text")))], pa.binary())})

    rep = sets.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "version")).alias("rep"))
    rep = small(written(rep.select("key", F.col("rep.doc_id").alias("r_id"), F.col("rep.version").alias("r_version")), "jaccard-wanted"), 24)
    rows = docs.join(rep, docs["doc_id"].eqNullSafe(F.col("r_id")) & (docs["version"] == F.col("r_version"))).select("key", "text")
    return map_arrow(rows, fn, "key long, tokens binary").dropDuplicates(["key"])  # of repeated rows any serves


class Members:
    """The members of a tile by size, and which pairs can link."""

    def __init__(self, keys, n, bits, comp, side):
        order = np.lexsort((keys, n))
        self.order, self.keys, self.n = order, keys[order], n[order]
        self.comp, self.side = comp[order], side[order]
        self.two = bool((side != side[0]).any())  # two tiles: only pairs across
        self.bits = [np.frombuffer(bits[i], U) for i in order]
        self.narrow: dict[int, np.ndarray] = {}

    def partners(self, i: int) -> np.ndarray:
        """Later members that may link with i, by size, component and bitmap."""
        to = int(np.searchsorted(self.n, self.n[i] * 100 // NUM, side="right"))
        j = np.arange(i + 1, to)
        j = j[self.comp[j] != self.comp[i]]
        if self.two:
            j = j[self.side[j] != self.side[i]]
        if not len(j):
            return j
        words = len(self.bits[i])
        if words not in self.narrow:
            self.narrow[words] = np.stack([folded(b, words) if len(b) >= words else np.zeros(words, U) for b in self.bits])
        m = self.narrow[words]
        differ = np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)
        both = self.n[j] + self.n[i]
        return j[(both - differ) // 2 >= need(self.n[i], self.n[j])]


def tile_links(m: Members, tokens: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest, by index in ``m``, of the tile's links."""
    sets = [np.frombuffer(tokens[i], U) for i in m.order]
    mine = np.unique(m.comp, return_inverse=True)[1]
    find, join = union_find(int(mine.max(initial=-1)) + 1)
    out = []
    for i in range(len(sets)):
        for j in m.partners(i):
            if find(mine[i]) == find(mine[j]):
                continue
            a, b = sets[i], sets[j]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if np.count_nonzero(b[at] == a) >= need(len(a), len(b)):
                join(int(mine[i]), int(mine[j]))
                out.append((i, int(j)))
    return out


def _members(t: pa.Table) -> Members:
    return Members(*(t.column(c).to_numpy() for c in ("key", "n")), t.column("bits").to_pylist(), t.column("comp").to_numpy(), t.column("side").to_numpy())


def candidates(tiles: DataFrame) -> DataFrame:
    """(u, v): of each tile, a spanning forest of the components that have a
    pair the bitmaps leave open; tiles are rows (tile, side, key, n, comp,
    bits)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "tile"):
            m = _members(t)
            names, mine = np.unique(m.comp, return_inverse=True)
            _, join = union_find(len(names))
            e = [(int(mine[i]), c) for i in range(t.num_rows - 1) for c in np.unique(mine[m.partners(i)]).tolist() if join(int(mine[i]), c)]
            if e:
                e = np.array(e, np.int64)
                yield pa.record_batch({"u": pa.array(names[e[:, 0]]), "v": pa.array(names[e[:, 1]])})

    return map_arrow(tiles.repartition("tile").sortWithinPartitions("tile"), fn, "u long, v long")


def links_of(tiles: DataFrame) -> DataFrame:
    """(u, v) links of tiles: rows (tile, side, key, n, comp, bits, tokens)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "tile"):
            m = _members(t)
            e = np.array(tile_links(m, t.column("tokens").to_pylist()), np.int64).reshape(-1, 2)
            if len(e):
                yield pa.record_batch({"u": pa.array(m.keys[e[:, 0]]), "v": pa.array(m.keys[e[:, 1]])})

    return map_arrow(tiles.repartition("tile").sortWithinPartitions("tile"), fn, "u long, v long")


def paired_tiles(members: DataFrame) -> DataFrame:
    """(tile, side, key, n, comp) of members (list, key, n, comp): lists cut
    into chunks by size, a tile for every pair of chunks in the size band
    that does not lie in one component."""
    chunk = F.floor((F.row_number().over(Window.partitionBy("list").orderBy("n", "key")) - 1) / TILE)
    chunks = written(members.withColumn("chunk", chunk), "jaccard-chunks")
    bounds = chunks.groupBy("list", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    other = bounds.select("list", *(F.col(c).alias(f"o_{c}") for c in ("chunk", "lo", "c0", "c1")))
    pairs = bounds.join(other, "list").where((F.col("chunk") <= F.col("o_chunk")) & (F.col("o_lo") * NUM <= F.col("hi") * 100))
    pairs = pairs.where((F.col("c0") != F.col("c1")) | (F.col("o_c0") != F.col("o_c1")) | (F.col("c0") != F.col("o_c0")))
    halves = F.array_distinct(F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("side")),
                                      F.struct(F.col("o_chunk").alias("chunk"), F.when(F.col("chunk") == F.col("o_chunk"), 0).otherwise(1).alias("side"))))
    pairs = pairs.select("list", F.xxhash64("list", "chunk", "o_chunk").alias("tile"), F.explode(halves).alias("h")).select("list", "tile", "h.chunk", "h.side")
    return chunks.join(pairs, ["list", "chunk"]).select("tile", "side", "key", "n", "comp")


def verified(tiles: DataFrame, docs: DataFrame, sets: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """(u, v) links of tiles (tile, side, key, n, comp), by exact intersection."""
    tiles = written(tiles, f"jaccard-tiles-{name}")
    arrays = written(class_arrays(docs, sets, tiles.select("key").distinct()), f"jaccard-arrays-{name}")
    return written(links_of(tiles.join(bits, "key").join(arrays, "key").select("tile", "side", "key", "n", "comp", "bits", "tokens")), f"jaccard-links-{name}")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, version) for every row of
    ``docs``; component names the group whatever its ids, version is a hash of
    the text, by which rows with one id can be told apart.

    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing; their component is their own id.  Null ids do not
    count as smallest; a component of rows without ids has a null id.
    Repeated rows and ties are one class each and get the same answer.  An
    empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    rows = written(scan_sets(docs), "jaccard-sets")
    sets = rows.where(F.col("n").isNotNull()).select("doc_id", "version", "n", "key", "bits")
    seen = rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HEAVY)
    heavy = np.sort(np.array([r[0] for r in seen.orderBy(F.desc("seen"), "token").limit(HEAVY_MAX).select("token").collect()], np.int64).view(U))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = written(shared_lists(prefix_index(docs, heavy, buckets)), "jaccard-lists")

    bits = written(sets.select("key", "bits").join(lists.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "jaccard-bits")

    # first round: each class in one list, in tiles of neighbours by size
    one = lists.groupBy("key", "n").agg(F.min("list").alias("list"))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("n", "key")))
    one = one.select(F.xxhash64("list", F.floor(F.col("place") / TILE)).alias("tile"), F.lit(0).alias("side"), "key", "n", F.col("key").alias("comp"))
    open_pairs = written(candidates(one.join(bits, "key")), "jaccard-candidates-1")
    some = open_pairs.select(F.col("u").alias("key")).unionByName(open_pairs.select(F.col("v").alias("key"))).distinct()
    links = verified(one.join(some, "key"), docs, sets, bits, "1")
    label = components(links)

    # second round: lists that still span components.  Components with a pair
    # that bitmaps leave open are joined to groups, so a class moves its array
    # once for a group, not once for each of its lists
    named = lists.join(label, lists["key"] == label["node"], "left").select("list", "key", "n", F.coalesce("component", "key").alias("comp"))
    spans = named.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    named = written(named.join(spans, "list"), "jaccard-open")
    group = components(candidates(paired_tiles(named).join(bits, "key")))
    group = named.select("key", "n", "comp").distinct().join(group, F.col("comp") == F.col("node")).select(F.col("component").alias("list"), "key", "n", "comp")
    more = verified(paired_tiles(group), docs, sets, bits, "2")
    label = components(links.unionByName(more))

    sets = sets.join(label, sets["key"] == label["node"], "left").withColumn("component", F.coalesce("component", "key"))
    least = sets.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return sets.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component", "version")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("component", "version")


OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS s FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(s[i:i + 4], ' ') AS t
  FROM d, unnest(range(1, CASE WHEN len(s) = 0 THEN 1 ELSE greatest(2, len(s) - 3) END)) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 80 * (na.n + nb.n - p.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
