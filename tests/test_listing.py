"""Lists, ingest duplicates, PDF facts, page measures and the retrieval rules that tests of queries don't reach."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from docengine.functions import text
from docengine.operators import chunks, geometry, listing, retrieval
from docengine.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a%b", "x", "O"), (2, "ab", "Y_1", "P"), (3, None, "Y11", "F"), (4, "", None, "O")], "id int, name string, code string, status string")


@pytest.mark.parametrize("term,ids", [(None, [1, 2, 3, 4]), ("  ", [1, 2, 3, 4]), ("%", [1]), (" _ ", [2]), ("Y", [2, 3]), ("zz", [])])
def test_search(rows, term, ids):
    assert [r.id for r in listing.matching(rows, term, "name", "code").orderBy("id").collect()] == ids


def test_filters_and_pages(rows):
    assert {r.id for r in listing.filtered(rows, status=["O", "P"], code=None).collect()} == {1, 2, 4}
    part, total = listing.page(rows, [F.desc("id")], 2, 1)
    assert [r.id for r in part.collect()] == [3, 2] and total.first().n == 4
    with pytest.raises(ValueError):
        listing.page(rows, [F.col("id")], -1)


def test_ingest(spark):
    docs = spark.createDataFrame([(1, "a\r\nb "), (2, "a\nb"), (3, "a\nb"), (4, "ｆull"), (5, "full"), (6, None), (7, None)], "doc_id long, text string")
    got = {r.doc_id: (r.duplicate_of, r.reason) for r in listing.ingest(docs).collect()}
    assert got[1] == (None, None) and got[2] == (1, "CONTENT") and got[3] == (2, "CHECKSUM") and got[4] == (None, None) and got[5] == (4, "CONTENT")


def test_pdf_facts(spark):
    plain = b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 2>> endobj 2 0 obj <</Type /Page>> endobj 3 0 obj <</Type/Page /Parent 1 0 R>> endobj"
    packed = b"%PDF-1.5\n9 0 obj <</Type /ObjStm /Filter /FlateDecode>> stream\n" + zlib.compress(b"<</Type /Page>> <</Type /Page>> <</Type /Page>>") + b"\nendstream endobj"
    locked = plain + b" trailer <</Encrypt 5 0 R>>"
    empty = b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 0>> endobj"
    assert [files.pdf_facts(x) for x in (plain, packed, locked, empty, b"GIF89a", None)] == [(True, False, 2), (True, False, 3), (True, True, 2), (True, False, 0), (False, False, 0), (False, False, 0)]
    frame = spark.createDataFrame([("a", plain), ("b", locked), ("c", empty), ("d", b"x")], "path string, content binary")
    codes = {r.path: r.error_code for r in geometry.preflight(files.pdf_files(frame)).collect()}
    assert codes == {"a": None, "b": "ENCRYPTED", "c": "NO_PAGES", "d": "NOT_A_PDF"}


def test_page_measures(spark):
    box = "page_id int, x0 double, y0 double, x1 double, y1 double, width double, height double"
    pages = spark.createDataFrame([(1, "word " * 20)], "page_id int, text string")
    images = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0, 100.0, 100.0), (1, 90.0, 90.0, 95.0, 95.0, 100.0, 100.0)], box)
    texts = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 100.0, 100.0, 100.0), (1, 5.0, 0.0, 20.0, 100.0, 100.0, 100.0)], box)
    r = geometry.page_quality(pages, images, texts=texts).first()
    assert (r.coverage, r.significant_coverage, r.text_coverage, r.significant) == (0.2525, 0.25, 0.2, 1)


def test_grouping_keeps_parents_of_documents_apart(spark):
    ranked = spark.createDataFrame([(0, i, i) for i in (1, 2, 3, 4, 5)], "query_id int, doc_id int, rank int")
    parents = spark.createDataFrame([(1, "d1", "p1"), (2, "d1", "p1"), (3, "d2", "p1"), (4, "d1", None), (5, "d1", None)], "doc_id int, document_id string, parent_id string")
    assert [r.doc_id for r in retrieval.group_by_parent(ranked, parents).orderBy("rank").collect()] == [1, 3, 4, 5]


def test_expansion_of_ready_documents(spark):
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)], "query_id int, doc_id int, rank int")
    points = spark.createDataFrame([(1, "gone", "p1"), (2, "d", "p1"), (3, "d", "p9"), (4, "d", None)], "doc_id int, document_id string, parent_id string")
    ready = spark.createDataFrame([("d",)], "document_id string")
    parents = spark.createDataFrame([("p1", "whole")], "parent_id string, text string")
    children = spark.createDataFrame([(i, f"child{i}") for i in (1, 2, 3, 4)], "doc_id int, text string")
    got = retrieval.expand(ranked, points, ready, parents, children, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.text, r.matched_child_text) for r in got] == [(2, "whole", "child2"), (3, "child3", None)]


def test_dense_in_blocks(spark, monkeypatch):
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None), (10, [0.0, 0.0])], "query_id long, vector array<double>")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)] + [(50, None), (51, [1.0]), (52, [0.0, 0.0])], "doc_id long, vector array<double>")
    whole = sorted(map(tuple, retrieval.dense(queries, vectors, 3, None).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 40)
    assert sorted(map(tuple, retrieval.dense(queries, vectors, 3, None).collect())) == whole and len(whole) == 15


def test_archived_points_are_left_out(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    payload = spark.createDataFrame([(1, "ACTIVE"), (2, "ARCHIVED")], "doc_id int, status string")
    assert [r.doc_id for r in retrieval.active(rows, payload).collect()] == [1] and retrieval.active(rows, None).count() == 3


def test_identities_and_full_width_tokens(spark):
    frame = spark.createDataFrame([(["Straße ﬁ", "İΣ"], 3, "Ｖ１．２ 検索"), ([], 3, "a"), ([], None, None)], "path array<string>, page int, t string")
    import hashlib

    got = frame.select(text.section_id(F.col("path"), F.col("page")), text.lexical_tokens(F.col("t"))).collect()
    names = [" > ".join(["Straße ﬁ", "İΣ"]).casefold(), "page:3", "document"]
    assert [r[0] for r in got] == ["section:" + hashlib.sha256(n.encode()).hexdigest()[:16] for n in names]
    assert got[0][1] == ["v1.2", "検", "索", "検索"]


def test_tables_of_one_column_keep_their_head():
    table = "| a |\n| --- |\n" + "\n".join(f"| row {i} |" for i in range(20))
    parts = chunks.split_table(table, 60)
    assert len(parts) > 1 and all(p.startswith("| a |\n| --- |\n") for p in parts)


def test_byte_pair_counter(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    count = chunks.bpe_counter(path, pattern)
    assert count("hello world") == 2 and count("") == 0
    pieces = chunks.split_tokens("One sentence here. Another one there.\n\nA last one. " * 30, 40, 5, count)
    assert all(count(p) <= 40 for p in pieces) and len(pieces) > 5
    frame = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in chunks.token_counts(frame, path, pattern).collect()} == {1: 2, 2: 0}


@pytest.mark.parametrize("html,markdown", [
    ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1 &amp; 2\n3</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 & 2 3 |  |"),
    ("<table><tr><td>x<!-- <td>no</td> --></td></tr></table>", "| x |\n| --- |"),
    ("<table><tr><td rowspan='1'>x</td><td colspan=\"2\">y</td></tr></table>", None),
    ("<table></table>", None),
    ("<TABLE><TR><TD><b>x</b> y<TD>z</TABLE>", "| x y | z |\n| --- | --- |"),
])
def test_tables_of_html(html, markdown):
    assert files.table_markdown(html) == (html if markdown is None else markdown)
