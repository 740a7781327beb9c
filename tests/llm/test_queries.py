"""The registered queries: those with oracle SQL against it, the others' shape."""

from __future__ import annotations

import oracle
import pytest

from docengine.llm import queries

COLUMNS = {
    "op1_token_store": "doc_id start n_tokens ids_crc32",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_pii": "doc_id text",
    "op5_langid": "doc_id held_out lang_pred score",
    "op6_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_ann": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert oracle.compare(spark, oracle.connection(oracle.SF), queries.QUERIES[name], queries.ORACLES[name], oracle.SF) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns(spark, name):
    df = queries.QUERIES[name](spark, oracle.SF)
    assert set(COLUMNS[name].split()) <= set(df.columns) and df.count() > 0


def test_held_out_languages(spark):
    rows = queries.op5_langid(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = rows.join(docs, "doc_id")
    assert both.where("lang = lang_pred").count() / both.count() > 0.97


def test_recall_of_the_search(spark):
    import brute

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute.nearest({r.vec_id: [float(x) for x in r.embedding] for r in rows[:2000]})
    frame = spark.createDataFrame([(r.vec_id, [float(x) for x in r.embedding]) for r in rows[:2000]], "vec_id long, embedding array<double>")
    from docengine.llm import ann

    got: dict = {}
    for r in ann.search(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9
