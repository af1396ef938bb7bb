"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with absolute discounting, interpolated down to
the add-one unigram:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | h)   = (c(hw) - D) / c(h) + bow(h) * p(w | h')    for hw seen
               = bow(h) * p(w | h')                         for others
    bow(h)     = D * T(h) / c(h)

h' is h without its first word, T(h) the number of different words seen after
h, and D = (n1 + 1/2) / (n1 + 2 n2 + 1) for each length, from the n-grams
seen once and twice.  Its states are the seen contexts, with an arc per seen
n-gram that carries log p and leads to the longest seen context of what was
read, and one failure arc, to h', that carries log bow.  A text is read once
from left to right from the state of a text's start: where the state has no
arc for the word, failure arcs are followed, down to the root, which takes
any word.

The automaton of the whole corpus is on no machine.  Documents lie in blocks;
a block asks for the counts of the distinct n-grams it holds, of all lengths,
training documents or not.  Each destination merges the blocks' training
counts of its n-grams and answers every block in the order of its question;
it also sends how many words it saw after each context to the destination of
that context, so lengths are worked off from the longest down.  A block's
answers are all arcs and states that its texts can reach.  What an executor
holds is bounded by a block and by GRAMS_PER_PART; a hot word or n-gram is
one entry per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bounds, dealt, dealt_to, dictionary, grouped, joined_key, lowered, numbered, order_of, pack, steps, unpack
from .common import IS_SPACE, documents, flat, map_arrow, pieces, release, written

ORDER = 3
HELD_MODULUS, HELD_REST = 7, 2
#: Questions that one destination merges, on average.
GRAMS_PER_PART = 1_500_000
#: Tokens of a lane: long texts are read as lanes side by side, each after a
#: run-up that brings it to its state (the last ORDER - 1 tokens name it).
LANE = 256
UNKNOWN, BEGIN, END, FIRST_WORD = 0, 1, 2, 3


def _read(docs: DataFrame) -> DataFrame:
    """Blocks: doc_ids, held, sizes (words per document), codes, words, counts
    (in training documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for piece in pieces(b, "text", BLOCK_BYTES):
                data, off = flat(piece.column("text"))
                data = lowered(data)
                ink = ~IS_SPACE[data]
                start, end = bounds(ink, off)
                codes, words = dictionary(data, ink, start, end)
                sizes = np.diff(np.searchsorted(start, off))
                held = piece.column("held").to_numpy(zero_copy_only=False)
                counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
                yield pa.record_batch({
                    "block": pa.array([(part << 32) + seq], pa.int64()), "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())), "sizes": pa.array([pack(sizes)], pa.binary()), "codes": pa.array([pack(codes)], pa.binary()),
                    "words": pa.ListArray.from_arrays([0, len(words)], words), "counts": pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64()))})
                seq += 1

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % HELD_MODULUS == HELD_REST, F.lit(False))
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held")), run,
                     "block long, doc_ids array<long>, held array<boolean>, sizes binary, codes binary, words array<string>, counts array<long>")


def _name(blocks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Blocks with codes into ``ids``, the ascending numbers of their words."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes, = unpack(left.column("codes")[0].as_py())
        of_code = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        of_code[right.column("pos").to_numpy()] = right.column("id").to_numpy()
        ids, rank = np.unique(np.concatenate([np.arange(FIRST_WORD), of_code]), return_inverse=True)
        return pa.table({"block": left.column("block"), "doc_ids": left.column("doc_ids"), "held": left.column("held"), "sizes": left.column("sizes"),
                         "codes": pa.array([pack(rank[FIRST_WORD:][codes])], pa.binary()), "ids": pa.array([pack(steps(ids))], pa.binary()), "n": pa.array([len(codes)], pa.int64())})

    asked = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("pos", "word"))
    found = asked.join(vocab.select("word", "id"), "word").select("of", "pos", "id")
    return blocks.drop("words", "counts").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        run, "block long, doc_ids array<long>, held array<boolean>, sizes binary, codes binary, ids binary, n long")


class _Texts:
    """The texts of a block as one sequence, with the n-grams that end at each place."""

    def __init__(self, sizes: bytes, codes: bytes, ids: bytes, held: list[bool]):
        sizes, codes, self.ids = unpack(sizes)[0], unpack(codes)[0], np.cumsum(unpack(ids)[0])
        self.first = np.cumsum(sizes + 2) - sizes - 2
        self.seq = np.empty(len(codes) + 2 * len(sizes), np.int64)
        own = np.ones(len(self.seq), bool)
        last = self.first + sizes + 1
        self.seq[self.first], self.seq[last] = BEGIN, END
        own[self.first] = own[last] = False
        self.seq[own] = codes
        self.sizes, self.m = sizes, len(self.ids)
        self.train = np.repeat(~np.asarray(held, bool), sizes + 2)
        self.at = np.arange(len(self.seq)) - np.repeat(self.first, sizes + 2)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each length: its n-gram at every place (-1: none, or with an
        unknown word), their keys, their words, and a place where each ends.
        A key is (the n-gram without its last word) * m + the last word."""
        here = np.where(self.seq == UNKNOWN, -1, self.seq)
        keys = np.arange(self.m)
        cols, first = [keys], np.zeros(self.m, np.int64)
        yield here, keys, cols, first
        for k in range(2, order + 1):
            before = np.full(len(here), -1)
            before[1:] = here[:-1]
            ok = np.flatnonzero((before >= 0) & (self.seq != UNKNOWN) & (self.at >= k - 1))
            keys, inv, first = grouped(before[ok] * self.m + self.seq[ok])
            here = np.full(len(here), -1)
            here[ok] = inv
            cols = [c[keys // self.m] for c in cols] + [keys % self.m]
            yield here, keys, cols, ok[first]


def _ask(named: DataFrame, level: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = _Texts(r["sizes"], r["codes"], r["ids"], r["held"])
                for k, (here, keys, cols, _) in enumerate(t.grams(level), 1):
                    if k == level:
                        seen = here >= 0
                        counts = np.bincount(here[seen & t.train], minlength=len(keys))
                        out = list(dealt([t.ids[c] for c in cols], [counts], parts))
                        if out:
                            yield pa.record_batch({"part": pa.array([p for p, _ in out], pa.int64()), "block": pa.array([r["block"]] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return map_arrow(named.select("block", "sizes", "codes", "ids", "held"), run, "part long, block long, blob binary")


def _answer(asked: DataFrame, level: int, parts: int) -> DataFrame:
    """Rows (to, part, blob, n1, n2): answers to the block ``to`` (counts, and
    different words after), or, with ``to`` null, what the contexts'
    destination ``part`` adds up.  ``asked`` has such sums where block is null."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        parts_of = [unpack(x.as_py()) for x in table.column("blob")]
        cols = [np.concatenate([np.cumsum(x[0]) if j == 0 else x[j] for x in parts_of]) for j in range(level)]
        value = np.concatenate([x[level] for x in parts_of])
        size = [len(x[0]) for x in parts_of]
        del parts_of
        asks = np.repeat([b is not None for b in blocks], size)
        packed = joined_key(cols)
        _, inv, at = grouped(packed)
        del packed
        count = np.bincount(inv[asks], weights=value[asks], minlength=len(at)).astype(np.int64)
        after = np.bincount(inv[~asks], weights=value[~asks], minlength=len(at)).astype(np.int64)
        to, part, blob, where = [], [], [], 0
        for b, n in zip(blocks, size, strict=True):
            if b is not None:
                rows = inv[where:where + n]
                to.append(b)
                part.append(key[0].as_py())
                blob.append(pack(count[rows], after[rows]))
            where += n
        if level > 1:
            seen = at[count > 0]
            context = [c[seen] for c in cols[:-1]]
            new = np.ones(len(seen), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in context]) if len(seen) else new[1:]
            begin = np.flatnonzero(new)
            for p, x in dealt([c[begin] for c in context], [np.diff(np.append(begin, len(seen)))], parts):
                to.append(None)
                part.append(p)
                blob.append(x)
        n1, n2 = [0] * len(to), [0] * len(to)
        if to:
            n1[0], n2[0] = int((count == 1).sum()), int((count == 2).sum())
        return pa.table({"to": pa.array(to, pa.int64()), "part": pa.array(part, pa.int64()), "blob": pa.array(blob, pa.binary()), "n1": pa.array(n1, pa.int64()), "n2": pa.array(n2, pa.int64())})

    return asked.groupBy("part").applyInArrow(run, "to long, part long, blob binary, n1 long, n2 long")


class Automaton:
    """States and arcs from the n-grams of a block (by length: at every place,
    keys, a place where each ends), with their training counts and the number
    of different words after them.

    A state is a seen n-gram of up to order - 1 words, level 0 the root.
    ``arcs[k]`` names, for each place of the text, the arc that reads its word
    from the state of the k words before (-1: none); an arc is the n-gram of
    k + 1 words, with ``logp[k]``.  ``less[k]`` is the same n-gram without its
    first word: as a state's failure arc, weighted by ``bow``, and, for the
    longest n-grams, as the state an arc leads to.
    """

    def __init__(self, m: int, grams: list[tuple], counts: list[np.ndarray], after: list[np.ndarray], total: int, distinct: int, discounts: list[float]):
        self.order = len(grams)
        self.unknown = math.log10(1 / (total + distinct + 1))
        p = (counts[0] + 1) / (total + distinct + 1)
        self.arcs, self.logp, self.less, self.bow = [], [], [], []
        for k, (here, keys, ends) in enumerate(grams):
            seen = counts[k] > 0
            less = np.zeros(len(keys), np.int64)
            if k:
                prefix = keys // m
                less = shorter[ends]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = (counts[k] - discounts[k]) / counts[k - 1][prefix] + bow[prefix] * p[less]
            if k + 1 < self.order:
                with np.errstate(divide="ignore", invalid="ignore"):
                    bow = np.where(seen & (after[k] > 0), discounts[k + 1] * after[k] / counts[k], 1.0)
                self.bow.append(np.log10(bow))
            self.arcs.append(np.where((here >= 0) & seen[np.maximum(here, 0)], here, -1) if len(keys) else here)
            self.logp.append(np.log10(np.where(seen, p, 1.0)))
            self.less.append(less)
            shorter = here

    def read(self, seq: np.ndarray, lanes: np.ndarray, size: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """log10 probabilities of the words of lanes (start, tokens), without
        the first ``skip`` of each; the state is carried along."""
        back = np.argsort(-size, kind="stable")
        lanes, size, skip = lanes[back], size[back], skip[back]
        level, state, sums = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), np.zeros(len(lanes))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            place = lanes[:live] + t
            add, waits = np.zeros(live), np.ones(live, bool)
            for k in range(self.order - 1, 0, -1):
                on = np.flatnonzero(waits & (level[:live] == k))
                if not len(on):
                    continue
                arc = self.arcs[k][place[on]]
                got, arc, miss = on[arc >= 0], arc[arc >= 0], on[arc < 0]
                add[got] += self.logp[k][arc]
                waits[got] = False
                if k == self.order - 1:
                    state[got] = self.less[k][arc]
                else:
                    level[got], state[got] = k + 1, arc
                add[miss] += self.bow[k - 1][state[miss]]
                state[miss] = self.less[k - 1][state[miss]]
                level[miss] = k - 1
            on = np.flatnonzero(waits)
            arc = self.arcs[0][place[on]]
            add[on] += np.where(arc >= 0, self.logp[0][np.maximum(arc, 0)], self.unknown)
            known = (arc >= 0) & (self.order > 1)
            level[on], state[on] = known, np.where(known, arc, 0)
            sums[:live] += np.where(t >= skip[:live], add, 0.0)
        out = np.empty(len(lanes))
        out[back] = sums
        return out


def _score(named: DataFrame, answers: DataFrame, order: int, parts: int, total: int, distinct: int, discounts: list[float]) -> DataFrame:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        t = _Texts(row["sizes"], row["codes"], row["ids"], row["held"])
        blobs = {(k, p): x for k, p, x in zip(*(right.column(c).to_pylist() for c in ("level", "part", "blob")), strict=True)}
        grams, counts, after = [], [], []
        for k, (here, own, cols, ends) in enumerate(t.grams(order), 1):
            to = dealt_to([t.ids[c] for c in cols], parts)
            by = order_of(to)
            cut = np.searchsorted(to[by], np.arange(parts + 1))
            c, a = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for p in range(parts):
                rows = by[cut[p]:cut[p + 1]]
                if len(rows):
                    c[rows], a[rows] = unpack(blobs.pop((k, p)))
            grams.append((here, own, ends))
            counts.append(c)
            after.append(a)
        base = np.log10((counts[0] + 1) / (total + distinct + 1))
        known = counts[0] > 0
        base[UNKNOWN], known[UNKNOWN] = math.log10(1 / (total + distinct + 1)), False
        machine = Automaton(t.m, grams, counts, after, total, distinct, discounts)
        del grams, counts, after, blobs

        # lanes: every LANE tokens of a text after its begin mark, with a run-up
        n = t.sizes + 1
        lanes_of = -(-n // LANE)
        doc = np.repeat(np.arange(len(n)), lanes_of)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        begin = 1 + nth * LANE
        run_up = np.minimum(begin, max(order - 1, 1))
        tokens = np.minimum(LANE, n[doc] - nth * LANE)
        sums = machine.read(t.seq, t.first[doc] + begin - run_up, tokens + run_up, run_up)
        score = np.bincount(doc, weights=sums, minlength=len(n))
        counted = t.seq != BEGIN
        of = np.repeat(np.arange(len(n)), t.sizes + 2)[counted]
        word = t.seq[counted]
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.bincount(of, weights=known[word], minlength=len(n)).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), total), pa.int64()),
            "base_score": pa.array(np.bincount(of, weights=base[word], minlength=len(n))), "score": pa.array(score)})

    return named.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    of every row: the log10 probabilities of its text, end included, under
    the unigram model and under the automaton.

    Null and empty texts, and texts of white space, are the end alone.  A null
    id is not held out.  Rows equal in id and text are scored and learned
    from one by one.  Very long texts are read as lanes side by side; the
    longest text bounds a block.  An empty table gives no rows; without a
    training document every word is unknown.  Other columns are not read.
    """
    blocks = written(_read(docs), "lm-blocks", "zstd")
    entry = F.explode(F.arrays_zip("words", "counts")).alias("e")
    vocab = blocks.select(entry).where("e.counts > 0").groupBy(F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("c"))
    vocab = numbered(vocab, [F.col("c").desc(), F.col("word")], "lm-vocabulary", FIRST_WORD)
    trained = blocks.select(F.explode("held").alias("held")).agg(F.count_if(~F.col("held"))).first()[0]
    words = vocab.agg(F.count(F.lit(1)), F.sum("c")).first()
    total, distinct = (words[1] or 0) + trained, words[0] + (trained > 0)
    named = written(_name(blocks, vocab), "lm-texts")
    del vocab
    release(docs.sparkSession)
    asked = named.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(asked / GRAMS_PER_PART))

    answers, discounts, sums = [], [], None
    for level in range(order, 0, -1):
        rows = _ask(named, level, parts)
        if sums is not None:
            rows = rows.unionByName(sums)
        made = written(_answer(rows, level, parts), f"lm-level{level}")
        del rows
        release(docs.sparkSession)
        n1, n2 = made.agg(F.sum("n1"), F.sum("n2")).first()
        discounts.insert(0, ((n1 or 0) + 0.5) / ((n1 or 0) + 2 * (n2 or 0) + 1))
        answers.append(made.where(F.col("to").isNotNull()).select(F.col("to").alias("block"), F.lit(level).alias("level"), "part", "blob"))
        sums = made.where(F.col("to").isNull()).select("part", F.lit(None).cast("long").alias("block"), "blob")
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    return _score(named.drop("n"), every, order, parts, total, distinct, discounts)


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


#: CRC-32 in SQL: its table, and the checksum of a list of bytes.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS crc_table"


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


OP11_SQL = rf"""
WITH crc AS ({CRC_TABLE_SQL}),
d AS (
  SELECT doc_id, {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} % {HELD_MODULUS} = {HELD_REST} AS held,
         list_concat(['b'], list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), lambda w: 'w' || w), ['e']) AS seq
  FROM documents, crc),
t AS (SELECT doc_id, held, i, seq[i] AS w, CASE WHEN i > 1 THEN seq[i - 1] END AS v, CASE WHEN i > 2 THEN seq[i - 2] END AS u FROM d, unnest(range(1, len(seq) + 1)) r(i)),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held AND v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held AND u IS NOT NULL GROUP BY u, v, w),
t1 AS (SELECT v, count(*) AS n FROM c2 GROUP BY v),
t2 AS (SELECT u, v, count(*) AS n FROM c3 GROUP BY u, v),
k AS (SELECT (SELECT coalesce(sum(c), 0) FROM c1 WHERE w <> 'b') AS n, (SELECT count(*) FROM c1 WHERE w <> 'b') AS v,
             (SELECT (count(*) FILTER (c = 1) + 0.5::DOUBLE) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2) + 1) FROM c2) AS d2,
             (SELECT (count(*) FILTER (c = 1) + 0.5::DOUBLE) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2) + 1) FROM c3) AS d3),
p AS (
  SELECT t.doc_id, t.held, a.c IS NOT NULL AS known, k.n, (coalesce(a.c, 0) + 1::DOUBLE) / (k.n + k.v + 1) AS p1,
         x.c AS cv, coalesce(b.c - k.d2, 0) / x.c AS seen2, k.d2 * t1.n / x.c AS bow2,
         y.c AS cuv, coalesce(c.c - k.d3, 0) / y.c AS seen3, k.d3 * t2.n / y.c AS bow3
  FROM t CROSS JOIN k LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c2 b ON b.v = t.v AND b.w = t.w LEFT JOIN c3 c ON c.u = t.u AND c.v = t.v AND c.w = t.w
  LEFT JOIN c1 x ON x.w = t.v LEFT JOIN t1 ON t1.v = t.v LEFT JOIN c2 y ON y.v = t.u AND y.w = t.v LEFT JOIN t2 ON t2.u = t.u AND t2.v = t.v
  WHERE t.i > 1),
q AS (SELECT *, CASE WHEN cv IS NULL THEN p1 ELSE seen2 + bow2 * p1 END AS p2 FROM p)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       sum(log10(p1)) AS base_score, sum(log10(CASE WHEN cuv IS NULL THEN p2 ELSE seen3 + bow3 * p2 END)) AS score
FROM q GROUP BY doc_id
"""
