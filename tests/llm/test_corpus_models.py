"""Operators 11 to 13 against brute force, on tables with nulls, empty and
very long texts, ties, repeated rows, clashing columns, and on empty tables."""
import math
import random
import zlib

import numpy as np
import pytest
from brute import lm_rows, phrase_rows, spelling_rows
from conftest import SF_SMALL
from pyspark.sql import functions as F
from taxilens.llm import backoff_lm, blocks, phrases, registry, spelling

CLASH = ("block", "held", "word", "words", "id", "n", "part", "blob", "shard", "key", "first", "reach", "score", "form", "of", "pos", "c")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet").collect()


# blocks ----------------------------------------------------------------------

def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        cols = [rng.integers(0, m, n) for m in (2, 300, 1 << 20, 1 << 40)]
        assert all((a == b).all() for a, b in zip(blocks.unpack(blocks.pack(*cols)), cols, strict=True))


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 62])
def test_grouping_and_order(most):
    key = np.random.default_rng(2).integers(0, most, 5000)
    assert (blocks.order_of(key) == np.argsort(key, kind="stable")).all()
    want = np.unique(key, return_index=True, return_inverse=True)
    got = blocks.grouped(key)
    assert (got[0] == want[0]).all() and (got[1] == want[2]).all() and (got[2] == want[1]).all()
    assert len(blocks.grouped(key[:0])[0]) == 0


def test_joined_keys_are_exact_beyond_64_bits():
    rng = np.random.default_rng(3)
    cols = [rng.choice([0, 1, (1 << 33) + 5, (1 << 40) - 1], 400) for _ in range(3)]
    key = blocks.joined_key(cols)
    rows = list(zip(*(c.tolist() for c in cols)))
    order = sorted(set(rows))
    assert [order[i] for i in blocks.grouped(key)[1]] == rows


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).selectExpr("id * 37 % 1000 AS v").repartition(7)
    rows = blocks.numbered(df, [F.col("v")], "test-numbered", 5).collect()
    assert sorted((r.id, r.v) for r in rows) == [(v + 5, v) for v in range(1000)]


# backoff language model --------------------------------------------------------

def check_scores(df, rows, order):
    got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(lm_rows(rows, order), key=str)
    for g, w in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6])), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6])), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order", [1, 3])
def test_lm_equals_the_definition(make, odd, prose, order):
    rows = [r for r in odd if r[0] not in (20, 21)] + [(100 + k, prose(120, 5, 40)) for k in range(20)] + [(None, "x y x"), (5, "x y"), (5, "x y")]
    check_scores(backoff_lm.lm_scores(clashing(make(rows)), order), rows, order)


def test_lm_reads_long_texts_as_lanes(make, prose, monkeypatch):
    rows = [(0, prose(3000, 1, 50)), (2, prose(2999, 2, 50)), (7, prose(257, 3, 50)), (9, prose(256, 4, 50)), (16, prose(255, 5, 50))]
    check_scores(backoff_lm.lm_scores(make(rows)), rows, 3)


def test_lm_over_many_blocks_and_destinations(make, prose, monkeypatch):
    """A block per text and many destinations give what one of each gives."""
    rows = [(k, prose(80, k % 7, 30)) for k in range(60)]
    monkeypatch.setattr(backoff_lm, "GRAMS_PER_PART", 300)
    docs = make(rows).repartition(9)
    check_scores(backoff_lm.lm_scores(docs), rows, 3)


def test_lm_without_training_and_empty(make):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "one two") for i in held]
    out = backoff_lm.lm_scores(make(rows)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in out} == {(0, 0, 0.0, 0.0)}
    assert backoff_lm.lm_scores(make([]).where("false")).count() == 0


def test_lm_probabilities_sum_to_one(make, prose):
    """Over all words and an unknown one, after one context."""
    rows = [(k, prose(50, k, 12)) for k in range(30)]
    vocab = sorted({w for i, t in rows for w in t.lower().split()})
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    ask = [(i, f"{rows[0][1].split()[0]} {rows[0][1].split()[1]} {w}") for i, w in zip(held, [*vocab, "neverseen"])]
    ask2 = [(i, f"{rows[0][1].split()[0]} {rows[0][1].split()[1]}") for i in held[len(ask):len(ask) + 1]]
    got = {r.doc_id: r.score for r in backoff_lm.lm_scores(make(rows + ask + ask2)).collect()}
    want = lm_rows(rows + ask + ask2)
    for w in want:
        assert got[w[0]] == pytest.approx(w[6], rel=1e-9)


def test_lm_beats_the_unigram_on_held_out_texts(spark):
    out = registry.QUERIES["op11_backoff_lm"](spark, SF_SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# spelling variants ------------------------------------------------------------

COLS12 = ("word", "form", "root", "n", "n_near", "form_n")


def spelled(df):
    return sorted((tuple(r) for r in df.select(*COLS12).collect()), key=str)


def test_spelling_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark)]
    assert spelled(registry.QUERIES["op12_spelling"](spark, SF_SMALL)) == sorted(spelling_rows(rows), key=str)


@pytest.mark.parametrize("common", [0, 64])
def test_spelling_with_common_grams(make, common):
    """Families of words with one beginning or one end, whatever counts as common."""
    rng = random.Random(4)
    words = ["prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(150)]
    words += ["".join(rng.choice("éb") for _ in range(rng.randint(1, 6))) + "suffix" for _ in range(150)]
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    rows = [(k, " ".join(words[k::5]) + " " + " ".join(words[:20 * (k % 4)])) for k in range(12)]
    assert spelled(spelling.spelling_variants(make(rows), common=common)) == sorted(spelling_rows(rows), key=str)


def test_spelling_odd_tables(make, odd):
    rows = odd + [(None, "Straße straße STRAße ÀÉÎ×÷ à"), (None, "Straße"), (5, "prose " * 5)] + [(70, "x" * 3_000_000)] * 3
    assert spelled(spelling.spelling_variants(clashing(make(rows)))) == sorted(spelling_rows(rows), key=str)
    assert spelling.spelling_variants(make([]).where("false")).count() == 0
    assert spelling.spelling_variants(make([(1, None), (2, "..")])).count() == 0


def test_chains_of_forms_end_at_the_root(make):
    ladder = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    text = " ".join(" ".join([w] * 3 * 2 ** k) for k, w in enumerate(ladder))
    rows = [(next(i for i in range(10_000) if not any(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for w in ladder)), text)]
    got = {r.word: r for r in spelling.spelling_variants(make(rows)).collect()}
    assert got["abcde"].form == "abcdef" and {r.root for r in got.values()} == {ladder[-1]}
    assert got[ladder[-1]].form is None and got[ladder[-1]].n_near == 1


def test_joined_crc():
    rng = random.Random(6)
    a = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    b = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    got = spelling.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint64), np.array([zlib.crc32(x) for x in b], np.uint64), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


# collocations -------------------------------------------------------------------

COLS13 = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(df):
    return sorted(tuple(r) for r in df.select(*COLS13).collect())


def test_collocations_equal_brute_force(spark):
    rows = [(r.lang, r.text) for r in table(spark)]
    assert mined(registry.QUERIES["op13_collocations"](spark, SF_SMALL)) == sorted(phrase_rows(rows))


@pytest.mark.parametrize("shards", [1, 4])
def test_collocations_whatever_the_shards(make, prose, shards, monkeypatch):
    """Counts are those of a full cycle, from whichever shard a phrase began."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 300)
    rows = [(k, f"{prose(60, k % 9, 14)}. {prose(25, k % 4, 9)}", ("en", "de", None)[k % 3]) for k in range(60)]
    got = mined(phrases.collocations(make(rows).repartition(6), shards=shards))
    assert got == sorted(phrase_rows([(r[2], r[1]) for r in rows]))


def test_collocations_through_a_full_filter(make, prose, monkeypatch):
    """A bit filter that lets everything through changes nothing."""
    monkeypatch.setattr(phrases._Filter, "may_hold", classmethod(lambda cls, table, columns: np.ones(len(columns[0]), bool)))
    rows = [(k, prose(60, k % 5, 10)) for k in range(30)]
    assert mined(phrases.collocations(make(rows))) == sorted(phrase_rows([("en", r[1]) for r in rows]))


def test_collocations_odd_tables(make, odd):
    rows = [(i, t, None if i % 2 else "xx") for i, t in odd] + [(200, "New York, new york! NEW\tYORK\n" * 40, "en"), (201, "a b c d e " * 100, "en"), (201, "a b c d e " * 100, "en"), (None, "é ß\x85 é ß\x85 " * 30, "und")]
    rows += [(300, "to be or not to be " * 60_000, "long")]
    assert mined(phrases.collocations(clashing(make(rows)).drop("n_chars"))) == sorted(phrase_rows([(r[2], r[1]) for r in rows]))
    assert phrases.collocations(make([]).where("false")).count() == 0
    assert phrases.collocations(make([(1, None), (2, "a b")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 10^13 passes 64 bits; the division stays exact."""
    a = 10_000_000_000_019
    got = spark.range(1).select(F.expr(f"CAST({phrases.SCALE} * CAST({a}L AS decimal(28,0)) AS decimal(38,0)) div CAST(CAST({a}L AS decimal(28,0)) + {a + 3}L AS decimal(38,0))")).first()[0]
    assert got == phrases.SCALE * a // (2 * a + 3) and math.log2(phrases.SCALE * a) > 63
