"""Phrase collocations by dynamic itemset counting.

The corpus lies in shards that are scanned in a cycle, one a step, and
phrases of all lengths are counted side by side.  A word counts from step 0.
A longer phrase becomes active once both of its subphrases (without the last,
without the first word) have reached the threshold: it counts from the step
after that, for one full cycle, so over every shard once, from whichever one
it began with.  Most phrases never become active, and none waits for a whole
scan of the shorter ones.

Words have numbers (only those that reach the threshold; others end a
phrase).  A task knows from the numbers' reach when a pair of words is
active.  Whether longer phrases may be is told by bit filters of the
subphrases that have reached the threshold, ever and within the last cycle,
of bounded size; what passes them by chance falls out in an exact join with
the subphrases, after the counts of a step are summed.

Counts move as packed columns, a value per block and destination.  A
destination holds the pairs of words that fall to it, with what they have
been counted so far; their number follows the counted words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bounds, dealt, dealt_to, dictionary, grouped, joined_key, lowered, numbered, pack, steps, unpack
from .common import documents, flat, map_arrow, pieces, release, written

THRESHOLD = 30
#: Words of the corpus for each destination of counts.
WORDS_PER_PART = 3_000_000
LONGEST = 4
SHARDS = 3
TOP = 2000
SCALE = 2_000_000
#: A phrase goes where a longer one has so many percent of its count.
ABSORBED = 80
UNKNOWN_LANG = "und"
#: Bits of the filter for each phrase in it, and at most.
FILTER_BITS, FILTER_MOST = 16, 1 << 30
_SLICE = 1 << 16

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True


def _read(docs: DataFrame, shards: int) -> DataFrame:
    """Blocks: codes, opens (a piece of a text begins), and the words with
    their lang and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for piece in pieces(b, "text", BLOCK_BYTES):
                data, off = flat(piece.column("text"))
                data = lowered(data)
                breaks = _BREAKS[data]
                ink = ~(breaks | _BLANKS[data])
                start, end = bounds(ink, off)
                codes, words = dictionary(data, ink, start, end)
                before = np.concatenate([[0], np.cumsum(breaks)])[start]
                doc = np.searchsorted(off, start, side="right") - 1
                opens = np.ones(len(start), bool)
                opens[1:] = (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])
                langs = piece.column("lang").dictionary_encode()
                lang, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary
                keys, codes, _ = grouped(codes * max(1, len(names)) + lang[doc] if len(codes) else codes)
                yield pa.record_batch({
                    "block": pa.array([(part << 32) + seq], pa.int64()), "shard": pa.array([(part + seq) % shards], pa.int32()),
                    "codes": pa.array([pack(codes)], pa.binary()), "opens": pa.array([pack(opens)], pa.binary()),
                    "words": pa.ListArray.from_arrays([0, len(keys)], words.take(pa.array(keys // max(1, len(names))))),
                    "langs": pa.ListArray.from_arrays([0, len(keys)], names.take(pa.array(keys % max(1, len(names)))).cast(pa.string())),
                    "counts": pa.ListArray.from_arrays([0, len(keys)], pa.array(np.bincount(codes, minlength=len(keys)), pa.int64()))})
                seq += 1

    return map_arrow(docs.select("text", F.coalesce(F.col("lang"), F.lit(UNKNOWN_LANG)).alias("lang")), run,
                     "block long, shard int, codes binary, opens binary, words array<string>, langs array<string>, counts array<long>")


def _name(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with codes into ``ids`` (0: a word under the threshold) and the
    reach of each."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes, = unpack(left.column("codes")[0].as_py())
        of_code = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        pos, ids, reach = (right.column(c).to_numpy() for c in ("pos", "id", "reach"))
        order = np.argsort(ids)
        of_code[pos[order]] = np.arange(1, len(ids) + 1)
        return pa.table({"block": left.column("block"), "shard": left.column("shard"), "opens": left.column("opens"), "codes": pa.array([pack(of_code[codes])], pa.binary()),
                         "ids": pa.array([pack(steps(np.concatenate([[0], ids[order]])))], pa.binary()), "reach": pa.array([pack(np.concatenate([[0], reach[order]]))], pa.binary())})

    asked = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("langs", "words")).alias("pos", "e")).select("of", "pos", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"))
    found = asked.join(words.select("lang", "word", "id", "reach"), ["lang", "word"]).select("of", "pos", "id", "reach")
    return blocks.drop("words", "langs", "counts").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        run, "block long, shard int, opens binary, codes binary, ids binary, reach binary")


class _Filter:
    """Two bits for each phrase that has reached the threshold, and two more
    in a second half for those that did so from step ``since`` on; in slices
    that tasks make one by one."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits, self.slices = bits, slices

    @staticmethod
    def slots(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
        return [dealt_to([np.full(len(columns[0]), salt), *columns], bits) for salt in (1, 2)]

    @classmethod
    def of(cls, phrases: DataFrame, columns: list[str], count: int, since: int) -> _Filter:
        bits = min(FILTER_MOST, max(_SLICE, 1 << (FILTER_BITS * count - 1).bit_length()))

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                late = b.column("reach").to_numpy() >= since
                at = np.concatenate(cls.slots([b.column(c).to_numpy() for c in columns], bits))
                at = np.unique(np.concatenate([at, at[np.tile(late, 2)] + bits]))
                yield pa.record_batch({"slice": pa.array(at // _SLICE), "at": pa.array(at % _SLICE)})

        def fill(key: tuple, table: pa.Table) -> pa.Table:
            out = np.zeros(_SLICE, bool)
            out[table.column("at").to_numpy()] = True
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "raw": pa.array([np.packbits(out).tobytes()], pa.binary())})

        rows = map_arrow(phrases.select(*columns, "reach"), slots, "slice long, at long").distinct().groupBy("slice").applyInArrow(fill, "slice long, raw binary")
        return cls(bits, {r["slice"]: bytes(r["raw"]) for r in rows.collect()})

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """The bits of all phrases and of the late ones; bounded by FILTER_MOST."""
        out = np.zeros(2 * self.bits // 8, np.uint8)
        for k, raw in self.slices.items():
            out[k * _SLICE // 8:(k + 1) * _SLICE // 8] = np.frombuffer(raw, np.uint8)
        return out[:self.bits // 8], out[self.bits // 8:]

    @classmethod
    def may_hold(cls, table: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        hit = np.ones(len(columns[0]), bool)
        for at in cls.slots(columns, 8 * len(table)):
            hit &= (table[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return hit


def _cols(k: int) -> list[str]:
    return [f"w{j}" for j in range(k)]


def _scan(named: DataFrame, shard: int, k: int, step: int, shards: int, filters: dict[int, _Filter], parts: int) -> DataFrame:
    """(part, blob): a shard's counts of phrases of k words, by block: of the
    pairs that are active at ``step``, with their first step, or of the longer
    phrases that may be."""
    shared = {j: named.sparkSession.sparkContext.broadcast(f) for j, f in filters.items() if j < k}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {j: f.value.halves() for j, f in shared.items()}
        for b in batches:
            for codes, opens, ids, reach in zip(*(b.column(c).to_pylist() for c in ("codes", "opens", "ids", "reach")), strict=True):
                seq, opens, ids, reach = unpack(codes)[0], unpack(opens)[0] > 0, np.cumsum(unpack(ids)[0]), unpack(reach)[0]
                ends = np.flatnonzero(seq > 0)  # places where a phrase of j words may end
                ok, late = seq > 0, None
                for j in range(2, k + 1):
                    ends = ends[ends > 0]
                    ends = ends[ok[ends - 1] & ~opens[ends]]
                    if j == 2:
                        first = np.maximum(reach[seq[ends - 1]], reach[seq[ends]]) + 1
                        ends = ends[(first <= step) & ((j < k) | (step < first + shards))]
                    elif j == k:
                        ends = ends[late[ends - 1] | late[ends]]  # else its cycle is over
                    if j < k:
                        words = [ids[seq[ends - j + 1 + i]] for i in range(j)]
                        hit = _Filter.may_hold(tables[j][0], words)
                        ends, words = ends[hit], [w[hit] for w in words]
                        ok = np.zeros(len(seq), bool)
                        ok[ends] = True
                        if j == k - 1:
                            late = np.zeros(len(seq), bool)
                            late[ends] = _Filter.may_hold(tables[j][1], words)
                        ends = np.flatnonzero(ok)
                if not len(ends):
                    continue
                key = seq[ends - k + 1]
                for i in range(1, k):
                    if i > 1:
                        key = grouped(key)[1]
                    key = key * len(ids) + seq[ends - k + 1 + i]
                distinct, inverse, at = grouped(key)
                words = [seq[ends[at] - k + 1 + i] for i in range(k)]
                values = [np.bincount(inverse, minlength=len(distinct))]
                if k == 2:
                    values.insert(0, np.maximum(reach[words[0]], reach[words[1]]) + 1)
                out = list(dealt([ids[w] for w in words], values, parts))
                yield pa.record_batch({"part": pa.array([p for p, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return map_arrow(named.where(F.col("shard") == shard).select("codes", "opens", "ids", "reach"), run, "part long, blob binary")


def _joined(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    """The rows of packed columns, one after another."""
    rows = [unpack(x) for x in blobs]
    return [np.concatenate([np.cumsum(r[j]) if j == 0 else r[j] for r in rows]) if rows else np.zeros(0, np.int64) for j in range(columns)]


_PAIRS = "part long, state binary, w0 array<long>, w1 array<long>, n array<long>, reach array<int>"


def _add_pairs(counts: DataFrame, state: DataFrame | None, step: int, shards: int, threshold: int) -> DataFrame:
    """The pairs of each destination after a step: all that count on or have
    reached the threshold, packed (w0, w1, first step, n, reach + 1 or 0), and
    those that have reached it."""
    def run(key: tuple, new: pa.Table, old: pa.Table | None = None) -> pa.Table:
        w0, w1, first, n = _joined(new.column("blob").to_pylist(), 4)
        o0, o1, o_first, o_n, o_reach = _joined(old.column("state").to_pylist() if old is not None else [], 5)
        w0, w1, first, n = (np.concatenate(x) for x in ((w0, o0), (w1, o1), (first, o_first), (n, o_n)))
        reach = np.concatenate([np.zeros(len(n) - len(o_n), np.int64), o_reach])
        distinct, inverse, at = grouped(joined_key([w0, w1]))
        total, top = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, n)
        np.maximum.at(top, inverse, reach)
        top = np.where((top == 0) & (total >= threshold), step + 1, top)
        w0, w1, first = w0[at], w1[at], first[at]
        on = (top > 0) | (first + shards - 1 > step)
        done = top > 0
        each = lambda x, kind: pa.array([x[done]], pa.list_(kind))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([pack(steps(w0[on]), w1[on], first[on], total[on], top[on])], pa.binary()),
                         "w0": each(w0, pa.int64()), "w1": each(w1, pa.int64()), "n": each(total, pa.int64()), "reach": each((top - 1).astype(np.int32), pa.int32())})

    if state is None:
        return counts.groupBy("part").applyInArrow(lambda key, new: run(key, new), _PAIRS)
    return counts.groupBy("part").cogroup(state.select("part", "state").groupBy("part")).applyInArrow(run, _PAIRS)


def _sum(counts: DataFrame, k: int) -> DataFrame:
    """(w0, w1, .., n) of the phrases of each destination."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        *words, n = _joined(table.column("blob").to_pylist(), k + 1)
        distinct, inverse, at = grouped(joined_key(words))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, n)
        return pa.table({**{c: pa.array(w[at]) for c, w in zip(_cols(k), words, strict=True)}, "n": pa.array(total)})

    return counts.groupBy("part").applyInArrow(run, ", ".join(f"{c} long" for c in [*_cols(k), "n"]))


def _active(counts: DataFrame, k: int, shorter: DataFrame, step: int, shards: int) -> DataFrame:
    """Counts of those phrases both of whose subphrases have reached the
    threshold and whose cycle runs at ``step``, with their first step."""
    own, less = _cols(k), _cols(k - 1)
    left = shorter.select(*[F.col(c).alias(f"w{j}") for j, c in enumerate(less)], F.col("reach").alias("reach_l"))
    right = shorter.select(*[F.col(c).alias(f"w{j + 1}") for j, c in enumerate(less)], F.col("reach").alias("reach_r"))
    counts = counts.join(left, own[:-1]).join(right, own[1:]).withColumn("first", F.greatest("reach_l", "reach_r") + 1)
    return counts.where((F.col("first") <= step) & (F.col("first") + shards > step)).select(*own, "first", "n")


def count_phrases(named: DataFrame, threshold: int, longest: int, shards: int, parts: int) -> dict[int, DataFrame]:
    """For each length from 2: (w0, w1, .., n) of the phrases with
    ``threshold`` occurrences and more."""
    state: dict[int, DataFrame] = {}
    reached: dict[int, DataFrame] = {}
    last: dict[int, tuple[int, int]] = {}  # phrases that have reached the threshold, and the step of the last to do so
    step = 0
    while True:
        step += 1
        # pairs whose cycle may run (words reach by step shards - 1), and longer
        # phrases of which a subphrase has reached the threshold within a cycle
        running = [k for k in range(2, longest + 1) if (step < 2 * shards if k == 2 else k - 1 in last and last[k - 1][0] and last[k - 1][1] >= step - shards)]
        if not running:
            return {k: r.select(*_cols(k), "n") for k, r in reached.items()}
        before = dict(reached)
        filters = {j: _Filter.of(before[j], _cols(j), last[j][0], step - shards) for j in range(2, max(running)) if j in last and last[j][0]}
        for k in running:
            counts = _scan(named, step % shards, k, step, shards, filters, parts)
            if k == 2:
                state[k] = written(_add_pairs(counts, state.get(k), step, shards, threshold), f"phrases-{k}-{step}")
                reached[k] = state[k].select(F.explode(F.arrays_zip("w0", "w1", "n", "reach")).alias("e")).select("e.*")
            else:
                rows = _active(_sum(counts, k), k, before[k - 1], step, shards)
                rows = rows.select(*_cols(k), "first", "n", F.lit(None).cast("int").alias("reach"))
                if k in state:
                    rows = rows.unionByName(state[k])
                rows = rows.groupBy(*_cols(k)).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("reach").alias("reach"))
                rows = rows.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= threshold, F.lit(step))))
                rows = rows.where(F.col("reach").isNotNull() | (F.col("first") + shards - 1 > step))
                state[k] = written(rows.select(*_cols(k), "first", "n", F.col("reach").cast("int").alias("reach")), f"phrases-{k}-{step}")
                reached[k] = state[k].where("reach IS NOT NULL")
            found = reached[k].agg(F.count(F.lit(1)), F.max("reach")).first()
            last[k] = found[0], -1 if found[1] is None else found[1]


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language
    that are most common for what their parts are.

    Null text has no words; a null lang is ``und``.  Equal scores and counts
    are ranked by phrase, in byte order.  Repeated rows count each time.  Very
    long texts are read whole.  An empty table, and a language without a
    phrase over the threshold, give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    blocks = written(_read(docs, shards), "phrases-blocks", "zstd")
    every = blocks.select("shard", F.explode(F.arrays_zip("langs", "words", "counts")).alias("e"))
    in_shard = [F.sum(F.when(F.col("shard") == s, F.col("e.counts")).otherwise(0)).alias(f"s{s}") for s in range(shards)]
    words = written(every.groupBy(F.col("e.langs").alias("lang"), F.col("e.words").alias("word")).agg(*in_shard), "phrases-words")
    so_far = [reduce(lambda a, b: a + b, [F.col(f"s{j}") for j in range(s + 1)]) for s in range(shards)]
    totals = written(words.groupBy("lang").agg(F.sum(so_far[-1]).alias("n")), "phrases-totals")
    reach = F.coalesce(*[F.when(c >= threshold, F.lit(s)) for s, c in enumerate(so_far)])
    often = words.select("lang", "word", so_far[-1].alias("f"), reach.alias("reach")).where("reach IS NOT NULL")
    often = written(numbered(often, [F.col("f").desc(), F.col("lang"), F.col("word")], "phrases-numbered", 1), "phrases-vocabulary")
    named = written(_name(blocks, often), "phrases-texts")
    release(spark)
    every_word = totals.agg(F.sum("n")).first()[0] or 0
    counted = count_phrases(named, threshold, longest, shards, max(1, -(-every_word // WORDS_PER_PART)))

    one = often.select(F.array("id").alias("key"), F.col("f").alias("a"))
    long = reduce(DataFrame.unionByName, [c.select(F.array(*_cols(k)).alias("key"), F.col("n").alias("a")) for k, c in counted.items()])
    counts = written(one.unionByName(long), "phrases-counts")
    size = F.size("key")
    found = counts.where(size > 1)
    # longer phrases that hold a shorter one, and the most common of them
    holders = found.where(size > 2).select("a", "key", F.explode(F.sequence(F.lit(2), size - 1)).alias("k")).select("a", "k", "key", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at"))
    holders = holders.select(F.expr("slice(key, at, k)").alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    wide = "decimal(38,0)"
    kept = found.join(holders, "key", "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * ABSORBED)).drop("most")
    cuts = kept.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr("slice(key, 1, k)").alias("head"), F.expr("slice(key, k + 1, size(key))").alias("tail"))
    cuts = cuts.join(counts.select(F.col("key").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("key").alias("tail"), F.col("a").alias("r")), "tail")
    cuts = cuts.withColumn("score", F.expr(f"CAST({SCALE} * CAST(a AS decimal(28,0)) AS {wide}) div CAST(CAST(l AS decimal(28,0)) + r AS {wide})"))
    best = cuts.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("key", F.posexplode("key").alias("pos", "id")).join(often.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(spelled, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    out = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS s FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(s[i:i + k - 1], ' ') AS p, count(*) AS f
  FROM w, unnest(range(1, {LONGEST + 1})) x(k), unnest(range(1, len(s) - k + 2)) y(i) GROUP BY ALL),
cand AS (SELECT lang, k, p, string_split(p, ' ') AS s, CAST(f AS HUGEINT) AS a FROM grams WHERE k > 1 AND f >= {THRESHOLD}),
held AS (
  SELECT lang, array_to_string(s[i:i + j - 1], ' ') AS p, max(a) AS most
  FROM cand, unnest(range(2, k)) x(j), unnest(range(1, k - j + 2)) y(i) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN held h ON h.lang = c.lang AND h.p = c.p WHERE h.most IS NULL OR 100 * h.most < {ABSORBED} * c.a),
cuts AS (
  SELECT c.lang, c.p, c.a, x.j, l.f AS l, r.f AS r, {SCALE} * c.a // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM kept c, unnest(range(1, c.k)) x(j)
  JOIN grams l ON l.lang = c.lang AND l.p = array_to_string(c.s[1:x.j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.p = array_to_string(c.s[x.j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS nth FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best WHERE nth = 1),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang)
SELECT r.lang, r.rank, r.p AS phrase, CAST(r.a AS BIGINT) AS a, r.l, r.r, n.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= {TOP}
"""
