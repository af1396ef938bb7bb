"""The pipeline's stages, each against its own input, and its registration."""
import __spark_entry__ as entry
import corpus_pipeline as cp
import pytest
from brute import jaccard_rows, words
from taxilens.llm import decontaminate, language, registry


def rows_of(prose, odd):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None) for i, t in odd]
    rows += [(100 + i, prose(60, 300 + i), "en" if i % 2 else "fr", "s1") for i in range(40)]
    return rows + [(None, prose(60, 700), None, None), (104, rows[4][1], "en", "s1"), (100, prose(60, 300), "en", "s1")]


def same(df, rows):
    key = lambda r: tuple((x is not None, x if x is not None else "") for x in r)
    return sorted(map(key, (tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()))) == sorted(map(key, rows))


def test_stages(spark, make, prose, odd, tmp_path):
    df = make(rows_of(prose, odd))
    cols = df.columns

    out = cp.language_id(spark, df, "")
    assert out.columns == cols
    pred = language.identify(df, language.train(df), "doc_id").where("lang_pred <> 'und' and score >= 0.5")
    assert out.count() == pred.count()
    assert out.where("text is null or text = ''").count() == 0

    out = cp.near_duplicates(spark, df, "")
    assert out.columns == cols
    kept = [r.doc_id for r in out.collect()]
    groups = {}
    for i, n, c in jaccard_rows([(i, t) for i, t, *_ in rows_of(prose, odd) if i is not None]):
        groups.setdefault(c if n else ("none", i), set()).add(i)
    for g in groups.values():
        assert len(g & set(kept)) >= 1
    assert sum(i == 100 for i in kept) == 1 and sum(i is None for i in kept) == 1

    spark.createDataFrame([(1, prose(60, 301))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.decontamination(spark, df, str(tmp_path))
    assert out.columns == cols
    assert same(out, [r for r in rows_of(prose, odd) if r[0] != 101])

    out = cp.mix_sources(spark, df, "")
    assert out.columns == cols
    total = sum(len(words(t)) for _, t, *_ in rows_of(prose, odd))
    assert sum(len(words(r.text)) for r in out.collect()) <= 1.5 * total

    out = cp.tokens(spark, df, "")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == df.count()


def test_stages_on_an_empty_table(spark, make, odd, tmp_path):
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = make(odd).where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_extra_columns_pass(spark, make, odd, tmp_path):
    from pyspark.sql import functions as F
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = make(odd).withColumns({c: F.lit(c) for c in ("version", "id", "score", "hits", "size", "first", "key", "taken", "target")})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(registry.SQL) <= set(names)
    assert [f.__name__ for _, f in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mix_sources", "tokens"]
    assert decontaminate.SEED == 3


def test_import_errors_are_not_swallowed(monkeypatch):
    import sys

    import taxilens.llm
    monkeypatch.setitem(sys.modules, "taxilens.llm.registry", None)
    monkeypatch.delattr(taxilens.llm, "registry")
    with pytest.raises(ImportError):
        entry.queries()


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from taxilens.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    cp.prepare(spark)
    rows = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("a"), 100_000).alias("text"))
    got = common.map_arrow(rows, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 60
    assert max(r["bytes"] for r in got) <= cp.BATCH_BYTES + 110_000


def test_workers_free_what_other_operators_keep(spark):
    import os

    import pyarrow as pa
    from taxilens.llm import common, token_store
    from taxilens.session import prepare
    prepare(spark)
    path = token_store.tokenizer_path()

    def fill(batches):
        for _ in batches:
            token_store.encoder(path)
            common.powers(3, 10)
            yield pa.record_batch({"pid": pa.array([os.getpid()], pa.int64()), "encoders": pa.array([0], pa.int64()), "powers": pa.array([0], pa.int64())})

    def look(batches):
        for _ in batches:
            yield pa.record_batch({"pid": pa.array([os.getpid()], pa.int64()), "encoders": pa.array([len(token_store._ENCODERS)], pa.int64()), "powers": pa.array([len(common._POW)], pa.int64())})

    def run(fn, keep=None):
        return common.map_arrow(spark.range(0, 64, 1, 16), fn, "pid long, encoders long, powers long", keep).collect()

    filled = {r.pid for r in run(fill, "encoders")}
    kept = [r for r in run(look, "encoders") if r.pid in filled]
    assert kept and all(r.encoders == 1 for r in kept)
    assert all(r.powers == 0 for r in kept)
    assert all(r.encoders == 0 and r.powers == 0 for r in run(look))


def test_embeddings_made_at_once_are_bounded(monkeypatch, prose):
    import pyarrow as pa
    words_of = prose(60, 900, 4000).split()
    texts = [" ".join(words_of), prose(30, 901, 4000)]
    docs = [" ".join([*words_of[:3], "x", *words_of[10:13], "y"] * 600), " ".join([*words_of[:30], "zz", *words_of[31:]]), "q " + texts[1], ""]
    h, first = decontaminate.terms(*decontaminate.flat(pa.array(docs, pa.string())))
    look = decontaminate.Items([1, 2], texts)
    made, keys = [], decontaminate.cgk_keys
    monkeypatch.setattr(decontaminate, "cgk_keys", lambda x, m, tables: made.append(x.size * 3 * tables * 8) or keys(x, m, tables))
    found = look.find(h, first)
    assert max(made) <= decontaminate.EMBED_BYTES and sum(made) > decontaminate.EMBED_BYTES
    assert [(d, i) for d, i, *_ in found] == [(1, 1), (2, 2)]
    monkeypatch.setattr(decontaminate, "EMBED_BYTES", 1)
    assert look.find(h, first) == found
