"""Quality rules with risk-controlled cutoffs.

Every document gets a few counts.  Beside two fixed base rules, each of
several ratios has a cutoff per stratum, chosen on labelled documents: a
cutoff is admissible if an exact binomial test rejects, at a level corrected
for all rules and strata, that it would turn down more than RISK of the good
documents.  Cutoffs of a rule are tested from lenient to strict until one
fails (a fixed sequence, which needs no correction of its own); of those
that hold, the one with the best surplus of bad over good documents turned
down is taken, the most lenient first, and none if no surplus is positive.
Candidates are a fixed grid, so all labelled documents serve as holdout.

A stratum may have so few good labels that no test could reject even if its
cutoff turned down none of them.  Such strata are pooled and tested as one.
That keeps the guarantee, for the pool as a stratum: which strata are pooled
follows from their numbers of good labels alone, not from what a rule does to
them, so given these numbers every test is an exact binomial test of a fixed
population; and there are no more of them than rules x strata, for which the
level is corrected.  Within the pool a single stratum may lose more than RISK,
at the expense of none but the pool's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, U, Words, documents, flat, gram_hash, map_arrow, mix, pieces, prefix_sums, range_hash, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Ratios and the grids of their cutoffs, lenient to strict; a document fails
#: a rule above its cutoff.
GRID = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_word_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "chars_per_word": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}
#: Largest share of good documents of a stratum that a rule may turn down,
#: and the chance that any of the guarantees is wrong.
RISK = 0.01
ERROR = 0.05
POOL = "\0pool"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True


def _per_doc(mark: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


def _seen(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of h and the sizes of its groups, one for each place in order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, len(s)))
    return order, np.repeat(sizes, sizes)


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of a piece."""
    n = len(off) - 1
    w = Words(data, off)
    out = {"n_words": np.diff(w.first).astype(np.int64)}
    ink = ~IS_SPACE[data]
    out["word_chars"] = _per_doc(ink & ((data & 0xC0) != 0x80), off)
    out["n_symbols"] = _per_doc(_SYMBOL[data], off)
    out["n_upper"] = _per_doc(_UPPER[data], off)
    out["n_letters"] = _per_doc(_ASCII_LETTER[data], off)
    p = prefix_sums(data)
    # lines with a word, by document and content
    newline = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((off[:-1], newline + 1)), kind="stable")
    doc = np.searchsorted(off[1:], np.concatenate((off[:-1], newline)), side="right")
    doc = np.concatenate((np.arange(n), doc[n:]))
    order = np.lexsort((np.concatenate((off[:-1], newline + 1)), doc))
    start, doc = np.concatenate((off[:-1], newline + 1))[order], doc[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = off[1:][doc[last]]
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[has], end[has], doc[has]
    h = range_hash(p, start, end) ^ mix(doc.astype(U) + U(1))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    out["n_lines"] = np.bincount(doc, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n).astype(np.int64)
    # words in repeated windows of three
    h = range_hash(p, w.start, w.end)
    g = gram_hash(h, 3)
    wdoc = np.repeat(np.arange(n), np.diff(w.first))
    hit = np.zeros(len(h), bool)
    if len(g):
        inside = np.flatnonzero(wdoc[:-2] == wdoc[2:])
        order, size = _seen(g[inside] ^ mix(wdoc[inside].astype(U) + U(1)))
        at = inside[order[size > 1]]
        for j in range(3):
            hit[at + j] = True
    out["n_repeat_words"] = np.bincount(wdoc[hit], minlength=n).astype(np.int64)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the counts of every row; null text has no words."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                m = measure(*flat(part.column("text")))
                yield pa.record_batch({k: part.column(k) for k in keep} | {k: pa.array(m[k]) for k in COUNTS})

    return map_arrow(docs.select(*keep, "text"), fn, ", ".join([*fields, *(f"{c} long" for c in COUNTS)]))


def ratios() -> dict:
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words"),
            "chars_per_word": share("word_chars", "n_words"), "upper_share": share("n_upper", "n_letters")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), by summing exact terms downwards from k."""
    if k >= n:
        return 1.0
    lg = math.lgamma(n + 1)
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(lg - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if i < n * p and term < total * 1e-17:
            break
    return min(total, 1.0)


def pick_cutoff(cuts: list[float], good: list[int], bad: list[int], n_good: int, n_bad: int, risk: float, level: float) -> float:
    """The cutoff for one rule and stratum; infinity if there is none.
    good, bad: documents above each cutoff, of n_good and n_bad."""
    best, gain = math.inf, 0.0
    for c, g, b in zip(cuts, good, bad, strict=True):
        if binomial_tail(g, n_good, risk) > level:
            break
        if n_bad and b / n_bad - g / max(n_good, 1) > gain:
            best, gain = c, b / n_bad - g / max(n_good, 1)
    return best


def cutoffs(rows: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one cutoff per rule) from labelled rows (stratum, quality,
    ratios).  Spark reduces them to one row per stratum, or pool of strata,
    with a count for each cutoff and label; the tests run on that row."""
    sums = [F.count_if(F.col("quality") == q).alias(f"n{q}") for q in (0, 1)]
    sums += [F.count_if((F.col("quality") == q) & (F.col(r) > c)).alias(f"{r}_{i}_{q}") for r, cuts in GRID.items() for i, c in enumerate(cuts) for q in (0, 1)]
    table = rows.groupBy("stratum").agg(*sums)
    tests = table.agg(F.count(F.lit(1)) * len(GRID)).scalar()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = {"stratum": t["stratum"]}
            for r, cuts in GRID.items():
                out[f"cut_{r}"] = [pick_cutoff(cuts, [int(x[f"{r}_{i}_1"]) for i in range(len(cuts))], [int(x[f"{r}_{i}_0"]) for i in range(len(cuts))], int(x["n1"]), int(x["n0"]), risk, error / max(int(x["tests"]), 1)) for _, x in t.iterrows()]
            yield pd.DataFrame(out)

    # good labels of which none would have to be turned down for a test to reject
    least = F.ceil(F.log(F.lit(error) / F.col("tests")) / F.lit(math.log1p(-risk)))
    table = table.withColumn("tests", tests).withColumn("pool", F.when(F.col("n1") < least, F.lit(POOL)).otherwise(F.col("stratum")))
    counted = [c for c in table.columns if c not in ("stratum", "pool", "tests")]
    pooled = table.groupBy(F.col("pool").alias("stratum")).agg(*[F.sum(c).alias(c) for c in counted], F.first("tests").alias("tests"))
    cuts = pooled.mapInPandas(choose, "stratum string, " + ", ".join(f"cut_{r} double" for r in GRID)).withColumnRenamed("stratum", "pool")
    return table.select("stratum", "pool").join(cuts, "pool").drop("pool")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, counts, base_failed, kept, failed) for every row of ``docs``.

    The stratum is ``lang``, null one of its own; labels with a null id or
    quality, or of no document, are left out; a document with several labels
    counts once for each.  Without labels only the base rules decide.  Null
    and empty texts have no words and fail them.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("\0null")).alias("stratum"))
    rows = written(counts(docs, "doc_id", "stratum"), "quality-counts").withColumns(ratios())
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    # what the base rules turn down is not the cutoffs' to answer for
    cuts = cutoffs(rows.where(~F.col("base_failed")).join(known, "doc_id"), risk, error)
    rows = rows.join(cuts, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in GRID]))
    rows = rows.withColumn("failed", failed)
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
