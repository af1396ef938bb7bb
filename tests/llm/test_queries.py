"""Registered queries on the smallest tables, against brute force or their statements."""
import duckdb
import pytest
from brute import line_rows, passage_rows, pii_spans, quality_counts, sha, substring_rows, words
from conftest import SF_SMALL
from taxilens.llm import pii, registry


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]


def run(spark, name):
    return registry.QUERIES[name](spark, SF_SMALL)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_statement(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.execute(registry.SQL[name])
    cols = [c[0] for c in want.description]
    df = run(spark, name)
    assert sorted(df.columns) == sorted(cols)
    assert rows(df, *cols) == sorted(want.fetchall())


def test_op3(spark, docs):
    assert rows(run(spark, "op3_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(substring_rows(docs))


def test_op6(spark, docs):
    assert rows(run(spark, "op6_line_dedup"), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(line_rows(docs))


def test_op10(spark, docs):
    assert rows(run(spark, "op10_passage_dedup"), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(passage_rows(docs))


def test_op8(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op8_pii").collect()}
    for i, t in docs:
        s = pii_spans(t)
        base = ",".join(f"{k}:{a}:{b}" for k, v in s.items() for a, b in v)
        assert tuple(out[i][f"n_{k}"] for k in pii.KINDS) == tuple(len(v) for v in s.values())
        assert out[i].base_sha256 == sha(base) and out[i].spans.startswith(base)


def test_op9(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op9_quality_rules").collect()}
    for i, t in docs:
        assert tuple(out[i])[1:6] == quality_counts(t)


def test_op2_op7_op1(spark, docs):
    out = {r.doc_id: r for r in run(spark, "op2_language_id").collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    held = [i for i in out if out[i].held_out]
    assert sum(out[i].lang_pred == true[i] for i in held) >= 0.95 * len(held)
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    hits = {r.doc_id: r.item_ids for r in run(spark, "op7_decontaminate").collect()}
    for i, t in docs:
        assert {x.item_id for x in items if x.text in t} <= set(hits[i])
    store = run(spark, "op1_token_store").orderBy("doc_id").collect()
    assert [r.doc_id for r in store] == sorted(i for i, _ in docs)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(store, store[1:])) and all(r.n_tokens > 0 for r in store)
    assert sum(len(words(t)) for _, t in docs) > 0
