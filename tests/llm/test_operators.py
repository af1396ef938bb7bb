"""The ten operators against brute force, round trips and held-out accuracy,
on tables with nulls, empty and very long texts, ties, repeated rows and
columns with clashing names, and on empty tables."""
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import (edit_distance_in, jaccard_rows, line_rows, passage_rows, pii_spans, quality_counts, sha,
                   substring_rows, words)
from pyspark.sql import functions as F
from taxilens.llm import (decontaminate, fm_index, graph, jaccard, language, line_dedup, mixing, passage_dedup, pii,
                          quality, repeats, substring_dedup, suffix, token_store)

CLASH = ("version", "id", "key", "n", "seg", "bucket", "size", "taken", "lang_pred", "score", "hits", "spans", "pos", "kept")


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# token store -----------------------------------------------------------------

def library_ids(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_store.tokenizer_path())
    return tok.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]


def test_token_store_round_trip(spark, make, odd):
    rows = odd + [(90, "<|endoftext|> It's DON'T 12 ½ <|startoftext|>x")]
    out = token_store.token_store(clashing(make(rows))).orderBy("doc_id").collect()
    start = 0
    assert [r.doc_id for r in out] == sorted(i for i, _ in rows)
    for r in out:
        want = np.array(library_ids(dict(rows)[r.doc_id]), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        assert bytes(r.ids) == want.tobytes()
        start += len(want)


def test_parts_become_strings_at_once():
    """A Python object for each value of a column, made one by one, took a seventh of the encoder's time."""
    words = [f"wörd{k}" for k in range(200_000)] + ["", "𝄞", "a\u0000b"]
    arr = pa.array(words)
    began = time.process_time()
    slow = arr.to_pylist()
    between = time.process_time()
    fast = token_store.strings(arr)
    assert time.process_time() - between < between - began
    assert fast == slow == words and all(type(w) is str for w in fast)
    assert token_store.strings(arr[:0]) == [] and token_store.strings(arr[-3:]) == words[-3:]


def test_token_store_null_and_repeated_ids(make):
    out = token_store.token_store(make([(None, "b"), (3, "x"), (3, "y y"), (1, None)])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == [(False, 0, 2), (True, 1, 1), (True, 3, 2), (True, 3, 3)]
    assert sorted(r.start for r in out)[0] == 0
    assert next(r.start for r in out if r.doc_id is None) == 0


def test_token_store_empty(make):
    assert token_store.token_store(make([]).where("false")).count() == 0


def test_ids_are_gathered_a_word_at_a_time():
    """Body and closing meet once for each distinct word, so each word of the
    texts costs one place, not two (it took 142 bytes a word, now 102)."""
    import tracemalloc
    enc, words = token_store.Encoder(token_store.tokenizer_path()), 200_000
    text = "over, " * words
    want = enc.ids_of(["over,"])[0] * words
    tracemalloc.start()
    try:
        assert enc.ids_of([text])[0] == want
        assert tracemalloc.get_traced_memory()[1] < 120 * words
    finally:
        tracemalloc.stop()


def test_words_encode_like_texts():
    rng = random.Random(4)
    alphabet = list(" \t\n.,'sS<|>aéÉß́‍　İ1²中-")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    enc = token_store.Encoder(token_store.tokenizer_path())
    for t, ids in zip(texts, enc.ids_of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(t)[:-1]


def test_block_refuses_another_dictionary():
    block = token_store.pack(token_store.digest(b"one"), [1], [0], [b""])
    with pytest.raises(ValueError):
        token_store.Block(block, b"two")


# language --------------------------------------------------------------------

def lang_rows(n):
    rng = random.Random(8)
    parts = {"en": "the of and ing tion er wh th sh".split(), "fr": "le la eau ai en qué ç ou è".split(), "de": "der ü sch ung und ä tz ich".split()}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(60)), lang) for i in range(n) for lang in [sorted(parts)[i % 3]]]


def test_language_held_out_accuracy(make):
    rows = lang_rows(240)
    # labels of held-out rows are wrong: nothing may be learned from them
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    df = make([(i, t, "xx" if h else lang) for (i, t, lang), h in zip(rows, held)])
    net = language.train(df)
    assert net.langs == ["de", "en", "fr"]
    out = {r.doc_id: r for r in language.identify(df, net, "doc_id").collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_learns_from_null_and_repeated_ids(make):
    """Ids tell nothing: null, one for all, or a text copied thousands of times."""
    rows = lang_rows(240)
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    for ids in (lambda i: None, lambda i: one):
        net = language.train(make([(ids(i), t, lang) for i, t, lang in rows]))
        assert net.langs == ["de", "en", "fr"]
    copies = rows + [(5000 + k, rows[1][1], rows[1][2]) for k in range(3000)]
    assert language.train(make(copies + [(one, *rows[2][1:])] * 2000)).langs == ["de", "en", "fr"]


def test_language_unknown(make, odd):
    df = make(lang_rows(60) + [(i + 1000, t, None) for i, t in odd])
    net = language.train(df)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(clashing(df).drop("lang_pred", "score"), net, "doc_id").collect()}
    for i, t in odd:
        assert (out[i + 1000][0] == "und") == (not any(c.isalpha() for c in t or "")), i
    assert language.train(make([(1, "a", None)])) is None
    assert [(r.lang_pred, r.score) for r in language.identify(make([(1, "a")]), None, "doc_id").collect()] == [("und", 0.0)]
    assert language.identify(make([(1, "a")]).where("false"), net, "doc_id").count() == 0


# repeats ---------------------------------------------------------------------

COLS3 = ("doc_id", "n_bytes", "n_removed", "n_spans", "sha")
COLS10 = ("doc_id", "n_words", "n_removed", "sha")


def test_substring_dedup(make, odd):
    out = substring_dedup.remove_repeats(clashing(make(odd))).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(odd))


def test_passage_dedup(make, odd):
    out = passage_dedup.remove_passages(clashing(make(odd))).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS10) == sorted(passage_rows(odd))


def test_repeats_null_and_equal_ids(make, prose):
    a, b = prose(80, 5), prose(80, 6)
    rows = [(None, a), (7, a), (7, a), (7, b), (7, b + " x"), (9, b)]
    out = passage_dedup.remove_passages(make(rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in out) == [(False, 0, 0), (True, 7, 0), (True, 7, 0), (True, 7, 80), (True, 7, 80), (True, 9, 80)]
    assert passage_dedup.remove_passages(make(rows).where("false")).count() == 0
    assert substring_dedup.remove_repeats(make(rows).where("false")).count() == 0


def test_hot_anchors_are_no_group(spark, make, prose, monkeypatch):
    """Documents share a line shorter than a window, each with other
    neighbours: many segments under one anchor, which no search may get."""
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 4000)
    line = " ".join(f"common{k}" for k in range(40))
    rows = [(i, f"{prose(20, i % 60)} {line} {prose(20, 700 + i % 45)}") for i in range(120)] + [(500 + i, prose(90, 300 + i // 2)) for i in range(20)]

    def limited(search, units, k):
        def run(payloads, docs, window):
            size = {}
            for p in payloads:
                anchor = int(repeats.segments(units(np.frombuffer(p, np.uint8), np.array([0, len(p)])), window, k)[3][0])
                size[anchor] = size.get(anchor, 0) + len(p)
            if max(size.values()) > 4000:
                raise ValueError("a hot anchor in one group")
            return search(payloads, docs, window)
        return run

    bytes_of = repeats.byte_units(substring_dedup.GRAM)
    for module, name, units, remove, cols, brute in ((substring_dedup, "suffix_search", bytes_of, substring_dedup.remove_repeats, COLS3, substring_rows),
                                                     (passage_dedup, "fm_search", repeats.word_units(passage_dedup.GRAM), passage_dedup.remove_passages, COLS10, passage_rows)):
        monkeypatch.setattr(module, name, limited(getattr(module, name), units, module.GRAM))
        out = remove(make(rows)).withColumn("sha", F.sha2("kept", 256))
        assert got(out, *cols) == sorted(brute(rows))


def test_texts_are_cut_once_for_narrow_and_wide_anchors(make, prose, monkeypatch):
    """A pass over the texts for each kind would shuffle all of them again."""
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 2000)
    cuts, cut = [], repeats.Repeats._cut
    monkeypatch.setattr(repeats.Repeats, "_cut", lambda self, *a: cuts.append(1) or cut(self, *a))
    line = " ".join(f"common{k}" for k in range(8))
    rows = [(i, f"{prose(20, i)} {line} {prose(20, 700 + i)}") for i in range(60)] + [(500 + i, f"{prose(40, 300 + i // 2)} {i}") for i in range(20)]
    out = substring_dedup.remove_repeats(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(rows))
    assert len(cuts) == 1


def test_short_strings_that_texts_share_are_no_anchors(make, prose):
    """What frequent words make by chance, 20 bytes, would be looked up in all texts that have it."""
    short = [prose(5, 900 + k).encode()[:18].decode(errors="ignore") for k in range(40)]
    rows = [(i, "".join(f"{i}<{k}>{i}{s}" for k, s in enumerate(short))) for i in range(6)]
    docs = make(rows)
    found = repeats.Repeats(docs, repeats.byte_units(substring_dedup.GRAM), F.octet_length("text").cast("long"), substring_dedup.WINDOW, substring_dedup.GRAM, substring_dedup.suffix_search, repeats.byte_keys)
    assert found._shared_anchors(found._pairs()).count() == 0
    out = substring_dedup.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(rows))


def test_only_windows_that_come_again_are_sorted(monkeypatch):
    """Texts share strings shorter than a window by chance the more often the
    more of them there are; the sort gets none of their bytes."""
    rng, sizes, sort = random.Random(8), [], substring_dedup.sort_suffixes
    monkeypatch.setattr(substring_dedup, "sort_suffixes", lambda t: sizes.append(len(t)) or sort(t))
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    short, passage = noise(30), noise(52)
    by_chance = [noise(20) + short + noise(20) for _ in range(200)]
    copies = [noise(20) + bytes([i]) + passage + bytes([i]) + noise(20) for i in range(3)]
    docs = np.array([rng.randrange(1000) for _ in range(203)])
    payloads = by_chance + copies
    s, o, n, least = substring_dedup.suffix_search(payloads, docs, 50)
    assert sizes == [3 * 53]
    first = {}
    for p, d in zip(payloads, docs):
        for i in range(len(p) - 49):
            first[p[i:i + 50]] = min(d, first.get(p[i:i + 50], d))
    assert [(k, i + j, x) for k, i, m, x in zip(s, o, n, least) for j in range(m)] == [(k, i, first[p[i:i + 50]]) for k, p in enumerate(payloads) for i in range(len(p) - 49)]
    sizes.clear()
    assert [x.tolist() for x in substring_dedup.suffix_search(by_chance[:2], docs[:2], 50)] == [[0, 1], [0, 0], [21, 21], docs[:2].tolist()] and not sizes


@pytest.mark.parametrize("flush,texts", [(1 << 19, 1 << 16), (300, 1 << 16), (1 << 19, 8)])
def test_pairs_of_anchor_and_text(make, prose, monkeypatch, flush, texts):
    """Whatever a task sorts at once, every text's anchors are dealt, and
    each pair once."""
    monkeypatch.setattr(repeats, "FLUSH", flush)
    monkeypatch.setattr(repeats, "TEXTS", texts)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 2000)
    monkeypatch.setattr(repeats, "map_arrow", lambda df, fn, schema: fn)
    line = prose(30, 1)
    data = [t for i in range(60) for t in (prose(25, 10 + i // 2) + " " + line, "short", "")]
    docs = make(list(enumerate(data)))
    batch = pa.record_batch({"version": pa.array([hash(t) % (1 << 62) for t in data], pa.int64()), "text": pa.array(data)})
    units = repeats.byte_units(24)
    out = list(repeats.Repeats(docs, units, F.octet_length("text").cast("long"), 50, 24, None, None)._pairs()(iter([batch.slice(0, 100), batch.slice(100)])))
    doc, _, _, anchor = repeats.segments(units(*repeats.flat(batch.column("text"))), 50, 24)
    want = set(zip((anchor & np.uint64(repeats.LOW48)).tolist(), (batch.column("version").to_numpy()[doc] & repeats.LOW48).tolist()))
    seen = set()
    for b in out:
        have = {False: set(), True: set()}
        for known, raw in zip(b.column("known").to_pylist(), b.column("pairs").to_pylist()):
            a, v = repeats.unpacked([raw])
            pairs = list(zip(a.tolist(), v.tolist()))
            assert len(set(pairs)) == len(pairs) and not have[known] & set(pairs)
            have[known] |= set(pairs)
        seen |= have[False] | have[True]
        of = {}
        for a, v in have[False] | have[True]:
            of.setdefault(a, set()).add(v)
        assert have[True] == {(a, v) for a, vs in of.items() if len(vs) > 1 for v in vs}
        assert all(sum(a == x for x, _ in have[False]) == min(2, len(vs)) for a, vs in of.items())
    assert seen == want and len(out) == 1 or (flush, texts) != (1 << 19, 1 << 16) and seen == want and len(out) > 1


def test_segments_do_not_cross_texts(prose):
    data = ["", prose(3, 1)[:49], prose(9, 2)[:50], "", prose(90, 3), "ab" * 400, prose(90, 3), "x" * 20]
    units = repeats.byte_units(24)
    u = units(*repeats.flat(pa.array(data)))
    got_ = list(zip(*(x.tolist() for x in repeats.segments(u, 50, 24))))
    want = []
    for d in range(len(data)):
        low = [min(u.gram[i:i + 27].tolist()) for i in range(u.first[d], u.first[d + 1] - 49)]
        i = 0
        while i < len(low):
            j = next((j for j in range(i, len(low)) if low[j] != low[i]), len(low))
            want += [(d, int(u.first[d]) + x, min(repeats.CAP, j - x), low[i]) for x in range(i, j, repeats.CAP)]
            i = j
    assert got_ == want


def test_texts_whose_hashes_collide_are_no_copies(make, prose, monkeypatch):
    """Hashes of which 46 bits are always the same: many texts collide."""
    monkeypatch.setattr(repeats, "text_hash", lambda text: F.xxhash64(text).bitwiseAND(F.lit(3 | 7 << 48)))
    passage = prose(70, 3)
    rows = [(i, prose(90, 100 + i)) for i in range(30)] + [(100, prose(90, 101)), (101, prose(90, 101)), (102, prose(9, 9) + " " + passage), (103, passage)]
    out = passage_dedup.remove_passages(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS10) == sorted(passage_rows(rows))
    out = substring_dedup.remove_repeats(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(rows))


def test_shards_are_bounded_by_bytes(make, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SHARDS", 1)
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 2000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    base, rng = prose(1200, 1).split(), random.Random(4)
    rows = [(i, " ".join(f"{w}{i}" if rng.random() < 0.06 else w for w in base)) for i in range(40)]
    search = substring_dedup.suffix_search

    def limited(payloads, docs, window):
        if sum(map(len, payloads)) > 25_000:
            raise ValueError(f"a shard of {sum(map(len, payloads))} bytes")
        return search(payloads, docs, window)

    monkeypatch.setattr(substring_dedup, "suffix_search", limited)
    out = substring_dedup.remove_repeats(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(rows))


def test_small_alphabet_repeats(make):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(40, 200))) + "ab" * 40) for i in range(25)]
    out = substring_dedup.remove_repeats(make(rows)).withColumn("sha", F.sha2("kept", 256))
    assert got(out, *COLS3) == sorted(substring_rows(rows))


@pytest.mark.parametrize("memory,chunk,buckets", [(1, 1, 2), (5, 3, 1024), (1 << 20, 1 << 18, 1024)])
def test_suffix_sort(monkeypatch, memory, chunk, buckets):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    rng = random.Random(5)
    for _ in range(200):
        m = rng.choice([2, 3, 200])
        t = np.array([x for _ in range(rng.randint(1, 5)) for x in [*(rng.randint(1, m) for _ in range(rng.randint(1, 20))), 0]], np.uint16)

        def key(i):
            out = []
            while t[i]:
                out.append((1, int(t[i])))
                i += 1
            return [*out, (0, i)]
        sa, lcp = suffix.sort_suffixes(t, memory)
        want = sorted(range(len(t)), key=key)
        assert sa.tolist() == want
        for k in range(1, len(t)):
            a, b = key(want[k - 1]), key(want[k])
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def test_fm_index_matching():
    rng = np.random.default_rng(3)
    strings = [rng.integers(0, 5, rng.integers(1, 40)) for _ in range(20)]
    index = fm_index.FMIndex(strings, 5)
    streams = [rng.integers(0, 6, rng.integers(1, 60)) for _ in range(15)] + [strings[3]]
    for depth in (1, 3, 6):
        have = {tuple(s[i:i + depth]) for s in strings for i in range(len(s) - depth + 1)}
        s, p, run = index.matching(streams, depth)
        want = [(k, i) for k, x in enumerate(streams) for i in range(len(x) - depth + 1) if tuple(x[i:i + depth]) in have]
        assert list(zip(s.tolist(), p.tolist())) == want
        seen = {}
        for k, i, r in zip(s, p, run):
            assert seen.setdefault(r, tuple(streams[k][i:i + depth])) == tuple(streams[k][i:i + depth])


# jaccard ---------------------------------------------------------------------

def test_jaccard_components(make, odd):
    out = jaccard.jaccard_components(clashing(make(odd)))
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(jaccard_rows(odd))


def test_jaccard_edge_of_threshold(make):
    base = [f"w{k}" for k in range(24)]  # 20 shingles
    rows = [(k, " ".join(base[:24 - k] + [f"u{k}_{j}" for j in range(k)])) for k in range(8)]
    assert got(jaccard.jaccard_components(make(rows)), "doc_id", "n_shingles", "component_id") == sorted(jaccard_rows(rows))


def test_jaccard_tiles_are_split(make, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "HEAVY", 5)
    rng = random.Random(2)
    base = prose(120, 9).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert got(jaccard.jaccard_components(make(rows)), "doc_id", "n_shingles", "component_id") == sorted(jaccard_rows(rows))


def test_jaccard_null_ids_and_empty(make, prose):
    a = prose(50, 4)
    out = jaccard.jaccard_components(make([(None, a), (5, a), (5, a), (None, None)]))
    assert sorted((r.n_shingles, r.component_id or -1) for r in out.collect()) == [(0, -1), (46, 5), (46, 5), (46, 5)]
    assert jaccard.jaccard_components(make([(1, a)]).where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 103), (101, 103), (-4, 7)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: -4 for i in range(21)} | {-4: -4, 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# mixing ----------------------------------------------------------------------

def test_mix_targets_and_takes(make):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), "en", s) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [60, 5, 20, 14, 1], k=600))]
    df = clashing(make(rows)).drop("size")
    out = mixing.fair_mix(df).collect()
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # share, cap, reshare
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
            free.remove(s)
    taken = {}
    for r in out:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 60
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.fair_mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_odd_rows(make, odd):
    rows = odd + [(None, "a b c"), (None, "a b c"), (5, odd[5][1])]
    out = mixing.fair_mix(make(rows)).collect()
    assert len(out) == len(rows)
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.fair_mix(make(rows).where("false")).count() == 0
    assert [r.taken for r in mixing.fair_mix(make([(1, None), (2, "")])).collect()] == [0, 0]


# lines -----------------------------------------------------------------------

def test_line_dedup(make, odd):
    out = line_dedup.drop_lines(clashing(make(odd))).withColumn("sha", F.sha2("kept", 256))
    assert got(out, "doc_id", "n_lines", "n_dropped", "sha") == sorted(line_rows(odd))


def test_line_dedup_many_batches(make):
    rng = random.Random(1)
    lines = [f"line number {k} " + "x" * 40 for k in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(6))) for i in range(80)]
    for batches in (1, 7):
        out = line_dedup.drop_lines(make(rows), batches=batches).withColumn("sha", F.sha2("kept", 256))
        assert got(out, "doc_id", "n_lines", "n_dropped", "sha") == sorted(line_rows(rows))


def test_line_dedup_null_ids_and_empty(make):
    line = "y" * 45
    out = line_dedup.drop_lines(make([(None, line)] * 2 + [(k, line) for k in range(4)] + [(3, line)])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_dropped) for r in out) == [(False, 0, 1), (False, 0, 1), (True, 0, 1), (True, 1, 1), (True, 2, 1), (True, 3, 0), (True, 3, 0)]
    assert line_dedup.drop_lines(make([(1, line)]).where("false")).count() == 0


# decontamination -------------------------------------------------------------

def edited(w, edits, rng):
    w = list(w)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i:i + rng.randint(0, 1)] = [f"edit{rng.randrange(99)}"] if rng.random() < 0.7 else []
    return w


def test_decontamination_finds_edited_items(spark, make, prose):
    rng = random.Random(12)
    items = [(k, prose(20 + 3 * k, 100 + k, 3000)) for k in range(12)] + [(50, None), (51, "a b"), (52, "")]
    rows, want = [], {}
    for i in range(72):
        k, t = items[i % 12]
        w = t.split()
        for e in (0, int(0.1 * len(w)), int(0.2 * len(w)))[i % 3:i % 3 + 1]:
            body = prose(30, 500 + i).split() + edited(w, e, rng) + prose(30, 900 + i).split()
            rows.append((i, " ".join(body)))
    rows += [(200 + i, prose(200, 2000 + i)) for i in range(20)] + [(300, None), (301, ""), (None, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: {h.item_id: h for h in r.hits} for r in decontaminate.with_hits(make(rows), table).collect()}
    terms = [(k, re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t)) for k, t in items[:12]]
    missed = 0
    for i, t in rows:
        doc = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")
        for k, w in terms:
            d = edit_distance_in(w, doc)
            if d <= decontaminate.edit_limit(len(w)):
                missed += k not in out[i]
                if k in out[i]:
                    assert out[i][k].distance >= d
                    if not d:
                        assert out[i][k].distance == 0 and doc[out[i][k].start:out[i][k].end] == w
            else:
                assert k not in out[i]
    assert missed <= 2
    assert set(out[None]) == {0}


def test_decontamination_keeps_columns(spark, make, odd):
    df = clashing(make(odd))
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.with_hits(df, none, "__hits")
    assert out.columns == [*df.columns, "__hits"] and out.count() == len(odd)
    one = spark.createDataFrame([(1, odd[20][1][:200])], "item_id long, text string")
    assert decontaminate.with_hits(df.where("false"), one, "__hits").count() == 0
    assert decontaminate.with_hits(df, one, "__hits").columns == [*df.columns, "__hits"]


# personal data ---------------------------------------------------------------

PII_ROWS = [
    (1, "mail a.b@c.de, x@y, a@b.cc@d.ee, a@b.c-x+y@d.ee @@ q@.r"), (2, "ips 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4"),
    (3, "cards 4111 1111 1111 1111, 4111-1111-1111-1112 5500000000000004"), (4, "call +1 (743) 555-3824 or +49 30 1 +123456789012345678"),
    (5, "é@x.yz \U0001f600 me@example.com"), (6, "1" * 5000 + "." + "1" * 5000), (7, "@" * 2000 + "a" * 2000 + "@"),
]


def test_pii_base(make, odd):
    rows = PII_ROWS + odd[7:]
    rows += [(100, None), (101, "")]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    out = {r.doc_id: r for r in pii.find_pii(clashing(make(rows))).collect()}
    for i, t in rows:
        if t and len(t) == 10001:
            continue  # the plain pattern cannot turn 5000 digits into a number
        s = pii_spans(t)
        assert tuple(out[i][f"n_{k}"] for k in pii.KINDS) == tuple(len(v) for v in s.values()), t
        assert out[i].base == ",".join(f"{k}:{a}:{b}" for k, v in s.items() for a, b in v)
    assert pii.find_pii(make(rows).where("false")).count() == 0


def test_pii_random():
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("a@.-+ 0123456789()%") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == pii_spans(t)


def test_pii_terms_that_give_away(make, prose):
    entity = "jane.roe@example.com"
    rows = [(i, f"{prose(20, i)} Zyxgard writes {entity} about common things {prose(20, 50 + i)}") for i in range(4)]
    rows += [(10 + i, f"{prose(20, 10 + i)} writes about common things {prose(9, 90 + i)}") for i in range(200)]
    rows += [(900, rows[0][1]), (901, "nothing near bob@example.com here")]  # a copy, an entity seen once
    found = pii.find_pii(make(rows))
    out = {r.doc_id: r for r in found.collect()}
    for i in (0, 1, 2, 3, 900):
        t = dict(rows)[i]
        at = t.index("Zyxgard")
        assert f"term:{at}:{at + 7}" in out[i].spans.split(",")
        assert not any(t[int(a):int(b)] == "writes" for k, a, b in (s.split(":") for s in out[i].spans.split(",")) if k == "term")
    assert all(out[i].n_term == 0 for i, _ in rows if i >= 10 and i != 900)
    clean = {r.doc_id: r.text for r in pii.sanitise(make(rows), found).collect()}
    assert "Zyxgard" not in clean[0] and entity not in clean[0] and "[email]" in clean[0]
    assert clean[15] == dict(rows)[15]


@pytest.mark.parametrize("whole", [True, False])
def test_pii_terms_in_groups_of_copies(make, prose, whole):
    """Hundreds of copies of a text, or of a passage in other texts."""
    entity = "jane.roe@example.com"
    passage = [f"{prose(20, i)} Zyxgard writes {entity} about common things {prose(20, 50 + i)}" for i in range(6)]
    rows = list(enumerate(passage)) + [(10 + i, f"{prose(20, 10 + i)} writes about common things {prose(9, 90 + i)}") for i in range(300)]
    rows += [(1000 + i, passage[0] if whole else f"{prose(15, 2000 + i)} {passage[0]} {prose(15, 3000 + i)}") for i in range(400)]
    found = {r.doc_id: r.spans for r in pii.find_pii(make(rows)).collect()}
    for i, t in rows:
        terms = {t[int(a):int(b)] for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k == "term"}
        assert ("Zyxgard" in terms) == (entity in t), i
        assert not terms & {"writes", "about", "common", "things"}


def test_redact():
    assert pii.redact("ab cd ef", "email:3:5,term:0:2") == " [email] ef"
    assert pii.redact("ab cd", "") == "ab cd"


# quality ---------------------------------------------------------------------

def test_quality_counts(spark, make, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality_rules(clashing(make(odd)), labels).collect()}
    for i, t in odd:
        n, chars, symbols, dup, rep = quality_counts(t)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), i
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed)
    assert quality.quality_rules(make(odd).where("false"), labels).count() == 0


def test_quality_cutoffs_keep_good_documents(spark, make, prose):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(2400):  # 600 good labels with a null language; 528 would do
        bad = i % 4 == 0
        w = prose(60, i % 50).split()
        rows.append((i, " ".join(x + ("%%" if bad else "") for x in w) + (" %" * rng.randint(0, 2)), "en" if i % 2 else None))
        labels += [(i, 0 if bad else 1, 0)]
    labels += [(5, None, 0), (None, 1, 0), (999999, 1, 0)]
    out = quality.quality_rules(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = [r for r in out if r.doc_id % 4]
    assert sum(not r.kept for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in out if r.doc_id % 4 == 0) >= 525
    few = quality.quality_rules(make(rows[:100]), spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int"))
    assert few.where("kept = base_failed").count() == 0  # too few labels to guarantee anything


def test_quality_small_strata_are_pooled(spark, make, prose):
    """Eight languages of 100 good labels each have cutoffs together; one with enough stands alone."""
    rows, labels = [], []
    for i in range(2000):
        bad = i % 5 == 0
        text = " ".join(x + ("%%" if bad else "") for x in prose(60, i % 50).split())
        rows.append((i, text, f"l{i % 8}" if i < 1000 else "big"))
        labels.append((i, 0 if bad else 1, 0))
    rows.append((9999, rows[0][1], "unlabelled"))
    out = {r.doc_id: r for r in quality.quality_rules(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].kept == (i % 5 > 0) for i in range(2000))
    assert out[9999].kept  # nothing is known of its language


def test_quality_verdict_equals_brute_force(spark):
    """The verdict of the query, from its counts, by the definition."""
    from taxilens.llm.common import documents
    sf = "/root/testdata/sf0.1"  # fewer labels, as in sf0.01, guarantee nothing
    docs, labels = documents(spark, sf), documents(spark, sf, "labels").toPandas()
    out = quality.quality_rules(docs, documents(spark, sf, "labels")).toPandas()
    lang = {r.doc_id: r.lang or "" for r in docs.select("doc_id", "lang").collect()}
    share = lambda a, b: (out[a] / out[b].where(out[b] > 0)).fillna(0.0)
    value = {"symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words"),
             "chars_per_word": share("word_chars", "n_words"), "upper_share": share("n_upper", "n_letters")}
    out = out.assign(lang=out["doc_id"].map(lang), **value)
    known = out[~out["base_failed"]].merge(labels.dropna(subset=["doc_id", "quality"])[["doc_id", "quality"]], on="doc_id")
    good = known[known["quality"] == 1].groupby("lang").size().reindex(known["lang"].unique(), fill_value=0)
    level = quality.ERROR / (len(good) * len(quality.GRID))
    group = {x: x if n >= math.ceil(math.log(level) / math.log(1 - quality.RISK)) else "pool" for x, n in good.items()}
    cut = {}
    for g in set(group.values()):
        rows = known[known["lang"].map(group) == g]
        for rule, grid in quality.GRID.items():
            above = [[int((rows.loc[rows["quality"] == q, rule] > c).sum()) for c in grid] for q in (1, 0)]
            cut[g, rule] = quality.pick_cutoff(grid, *above, *(int((rows["quality"] == q).sum()) for q in (1, 0)), quality.RISK, level)
    want = [not r["base_failed"] and all(r[rule] <= cut.get((group.get(r["lang"]), rule), math.inf) for rule in quality.GRID) for _, r in out.iterrows()]
    assert out["kept"].tolist() == want
    assert (~out["kept"] & ~out["base_failed"]).any()  # the method turns something down


def test_binomial_tail():
    for n, p in ((10, 0.3), (50, 0.02), (200, 0.5)):
        for k in (0, 1, n // 3, n - 1, n):
            want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality.binomial_tail(k, n, p), want, rel_tol=1e-9)
    assert quality.pick_cutoff([3.0, 2.0, 1.0], [0, 1, 90], [10, 80, 95], 1000, 100, 0.01, 0.01) == 2.0
    assert quality.pick_cutoff([3.0], [0], [100], 50, 100, 0.01, 0.01) == math.inf
