"""Spelling variants of words, by asymmetric q-chunks.

Two words are near if one edited code point (inserted, deleted, replaced)
parts them.  In the join for a length L one word is the chunked side: a word
of L code points gives its two disjoint chunks, the first L // 2 code points
and the rest.  The other side, words of L or L + 1 code points, gives all its
positional grams of the chunks' sizes.  One edit leaves one of the two chunks
whole and moves it by one place at most, so near words meet in a gram within
shift one; what meets is verified by the edit distance.  Pairs of unequal
lengths are found from the shorter word's chunks, pairs of equal lengths from
either.

A gram may be common (many long words with one beginning).  Rows that meet
in a gram are counted before they are joined; for a common gram the key gets
longer by what one edit leaves of the rest of the word (the rest itself, or
it with one code point less).  Near words share that key too, and a key
holds no more words than there are code points and places to edit, so no
group of all words with one beginning is paired.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import CRC_TABLE_SQL, crc_sql
from .blocks import BLOCK_BYTES, bounds, dictionary, lowered
from .common import documents, flat, map_arrow, pieces, written

MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
SLIP_MODULUS = 97
#: A gram that more words share on either side gets the longer key.
COMMON = 64

_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF."""
    low = data | 32
    ink = (low >= 97) & (low <= 122) & (data < 128)
    lead = data == _LATIN
    ink |= lead
    ink[1:] |= lead[:-1]
    return ink


def _shift_tables(length: int) -> np.ndarray:
    """What ``length`` zero bytes do to a CRC-32, which is linear over its
    bits: 4 x 256 values, one table for each byte of the checksum."""
    bits = np.array([zlib.crc32(bytes(length), 1 << k) ^ zlib.crc32(bytes(length), 0) for k in range(32)], np.uint64)
    out = np.zeros((4, 256), np.uint64)
    for byte in range(4):
        for k in range(8):
            out[byte] ^= np.where(np.arange(256) >> k & 1, bits[8 * byte + k], 0).astype(np.uint64)
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b, from those of a and b and the bytes of b."""
    out = np.empty(len(first), np.uint64)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1)) if len(order) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        rows = order[a:b]
        t, c = _shift_tables(int(length[rows[0]])), first[rows].astype(np.int64)
        out[rows] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24] ^ second[rows]
    return out


def slipped(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with ``min_chars`` code points and ``min_count``
    occurrences.  A run whose checksum with its document's id SLIP_MODULUS
    divides loses a code point first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text", BLOCK_BYTES):
                data, off = flat(piece.column("text"))
                data = lowered(data)
                ink = _letters(data)
                start, end = bounds(ink, off)
                codes, words = dictionary(data, ink, start, end)
                own = np.array([zlib.crc32(w.as_py().encode()) for w in words], np.uint64)
                prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in piece.column("key").to_pylist()], np.uint64)
                sizes = np.diff(np.searchsorted(start, off))
                h = joined_crc(np.repeat(prefix, sizes), own[codes] if len(codes) else np.zeros(0, np.uint64), end - start)
                hit = h % np.uint64(SLIP_MODULUS) == 0
                counts = np.bincount(codes[~hit], minlength=len(words))
                slips = Counter(slipped(words[int(c)].as_py(), int(x)) for c, x in zip(codes[hit], h[hit], strict=True))
                yield pa.record_batch({"word": pa.concat_arrays([words, pa.array(list(slips), pa.string())]), "n": pa.array(np.concatenate([counts, np.array(list(slips.values()), np.int64)]), pa.int64())})

    made = map_arrow(docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("key"), "text"), run, "word string, n long")
    made = made.where((F.col("n") > 0) & (F.char_length("word") >= min_chars))
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _rests(rest: Column) -> Column:
    """The rest of a word, and it without one of its code points."""
    size = F.char_length(rest)
    less = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.concat(F.substring(rest, F.lit(1), k - 1), F.substring(rest, k + 1, size)))
    return F.array_distinct(F.concat(F.array(rest), less))


def near_pairs(words: DataFrame, common: int = COMMON) -> DataFrame:
    """(word, n, other, other_n) of near words, each pair in both orders.
    ``words``: a written table of distinct (word, n)."""
    size, w = F.char_length("word"), F.col("word")
    half = F.floor(size / 2).cast("int")
    chunk = lambda k, at, to: F.struct(F.lit(k).alias("k"), at.cast("int").alias("at"), F.substring(w, at + 1, to - at).alias("gram"), F.concat(F.substring(w, F.lit(1), at), F.substring(w, to + 1, size)).alias("rest"))
    chunks = words.select(w.alias("x"), F.col("n").alias("x_n"), size.alias("length"), F.explode(F.array(chunk(0, F.lit(0), half), chunk(1, half, size))).alias("c"))
    chunks = chunks.select("x", "x_n", "length", "c.*")

    # all positional grams, for the two lengths of chunked words that may be near
    grams = words.select(w.alias("y"), F.col("n").alias("y_n"), size.alias("y_length"), F.explode(F.array(size, size - 1)).alias("length"))
    grams = grams.where("length > 0").withColumn("half", F.floor(F.col("length") / 2).cast("int"))
    grams = grams.withColumn("p", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("half").alias("q")), F.struct(F.lit(1).alias("k"), (F.col("length") - F.col("half")).alias("q")))))
    grams = grams.where("p.q > 0 AND p.q <= y_length").select("*", F.explode(F.sequence(F.lit(0), F.col("y_length") - F.col("p.q"))).alias("y_at"))
    y, q, at = F.col("y"), F.col("p.q"), F.col("y_at")
    grams = grams.select("y", "y_n", "length", "p.k", "y_at", F.substring(y, at + 1, q).alias("gram"), F.concat(F.substring(y, F.lit(1), at), F.substring(y, at + q + 1, F.col("y_length"))).alias("rest"))
    # within shift one of the only place that the chunk has in words of that length
    place = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.floor(F.col("length") / 2))
    grams = grams.where(F.abs(F.col("y_at") - place) <= 1)

    # Rows meet by a hash of the gram, its length class and the longer key:
    # what meets by a collision is told apart like any other candidate.
    def hashed(side: DataFrame, *keep: str) -> DataFrame:
        return side.select(*keep, "rest", F.xxhash64("length", "k", "gram").alias("key"))

    chunks, grams = hashed(chunks, "x", "x_n"), hashed(grams, "y", "y_n")
    often = grams.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > common).select("key", F.lit(True).alias("often"))
    often = written(often, "spelling-often")

    def keyed(side: DataFrame, *keep: str) -> DataFrame:
        side = side.join(often, "key", "left")
        deep = F.when(F.col("often"), _rests(F.col("rest"))).otherwise(F.array(F.lit("")))
        return side.select(*keep, "key", F.explode(deep).alias("deep")).select(*keep, F.xxhash64("key", "deep").alias("key"))

    met = keyed(chunks, "x", "x_n").join(keyed(grams, "y", "y_n"), "key")
    met = met.where((F.col("x") != F.col("y")) & (F.levenshtein("x", "y", 1) == 1)).select("x", "x_n", "y", "y_n")
    both = met.unionByName(met.select(F.col("y").alias("x"), F.col("y_n").alias("x_n"), F.col("x").alias("y"), F.col("x_n").alias("y_n")))
    return both.distinct().select(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("other"), F.col("y_n").alias("other_n"))


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, common: int = COMMON) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``form`` is the near word of largest n (ties: the smallest in code-point
    order) if that n is ``ratio`` times the word's n at least, else null;
    ``root`` is where the forms of forms end.  Null text has no words; a null
    id counts as the empty text in a run's checksum.  Very long runs are
    words like others.  Repeated rows count each time.  An empty table gives
    no rows.  Other columns are not read.
    """
    words = written(word_counts(docs, min_chars, min_count), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words, common).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    follows = -F.col("best.less") >= ratio * F.col("n")
    out = written(out.select("word", "n", "n_near", F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")), "spelling-forms")

    # Each form has twice its word's n at least, so chains are short, and
    # every round halves what is left of them.
    steps = written(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return out.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


_RUN = "[A-Za-zÀ-ÿ]+"
_BYTES = "flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"

OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
runs AS (SELECT doc, run, count(*) AS c FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RUN}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {crc_sql(_BYTES)} AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {SLIP_MODULUS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS v FROM words, unnest(range(1, length(word) + 1)) r(k)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.v = b.v AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.v = a.word),
near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS form FROM pairs p JOIN near m ON m.word = p.word AND m.top = p.other_n GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= {RATIO} * w.n THEN b.form END AS form, CASE WHEN m.top >= {RATIO} * w.n THEN m.top END AS form_n
  FROM words w LEFT JOIN near m ON m.word = w.word LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS last, 0 AS depth FROM formed
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
