"""Duplicates of an ingest: whole results for null texts, and texts that are hashed in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import text
from docengine.operators import listing

TEXTS = ["", " \n\n\n", "a\r\nb \r\rc\n\n\n\nd\t\n", "ﬁ 　\n\x1c x  ", "a \nb\x0b\nc\f", "x\n \n \ny", " é́ ½", "\r", "é"]


def test_null_texts_are_kept(spark):
    docs = spark.createDataFrame([(6, None), (7, None), (8, "a"), (9, "")], "doc_id long, text string")
    got = {r.doc_id: (r.duplicate_of, r.reason) for r in listing.ingest(docs).collect()}
    assert got == {6: (None, None), 7: (6, "CHECKSUM"), 8: (None, None), 9: (None, None)}


def test_clean_text_equals_columns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.clean_lines(text.nfkc(F.col("t"))).alias("clean")).collect()
    assert [text.clean_text(r.t) for r in rows] == [r.clean for r in rows]


def test_hashes_are_taken_once(spark):
    """No expression over whole texts is left for the optimizer to copy into filters and joins."""
    docs = spark.createDataFrame([(1, "é"), (2, "é ")], "doc_id long, text string")
    plan = listing.ingest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "regexp_replace" not in plan
