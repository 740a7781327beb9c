from __future__ import annotations

import json

from docengine.operators import layout
from docengine.sources import files


def source(spark):
    def block(kind, text, y, html=None):
        return {"type": kind, "bbox": [0, y, 50, y + 10], "lines": [{"spans": [{"content": text, "html": html}]}]}

    pages = [
        {"page_idx": 0, "page_size": [100, 200], "preproc_blocks": [block("title", "Head", 0), block("text", "one", 10), block("list", "two", 20), block("table_caption", "Caption", 30)], "discarded_blocks": [block("header", "top", 1)]},
        {"page_idx": 1, "page_size": [100, 200], "preproc_blocks": [block("table", "", 0, "<table><tr><td>a</td><td>b</td></tr></table>"), block("image_caption", "Alone", 10), block("interline_equation", "x=1", 20), block("odd", "", 30), block("odd", "kept", 40)]},
    ]
    return spark.createDataFrame([(7, json.dumps({"pdf_info": pages}), 500.0, 1000.0)], "doc_id long, layout string, width double, height double")


def test_blocks_warnings_and_scale(spark):
    rows = {r.block_id: r for r in files.layout_blocks(source(spark)).collect()}
    assert rows["p1-b1"].bbox.y0 == 50.0 and rows["p1-b1"].bbox.x1 == 250.0
    assert not rows["p2-b3"].kept and rows["p2-b3"].warning == "UNMAPPED_BLOCK" and rows["p2-b4"].kept and rows["p2-b4"].type == "text"
    assert files.bundle_summary(files.layout_blocks(source(spark))).first().status == "PARTIAL_SUCCESS"


def test_nodes_join_captions_over_pages(spark):
    got = [(r.node_type, r.text, r.section_path, r.block_ids) for r in layout.to_nodes(files.layout_blocks(source(spark))).orderBy("position").collect()]
    assert got[2] == ("table", "Caption\n\n| a | b |\n| --- | --- |", ["Head"], ["p1-b3", "p2-b0"])
    assert [g[0] for g in got] == ["text", "list", "table", "caption", "formula", "text"]


def test_chunks_join_within_a_page_and_section(spark):
    got = layout.to_chunks(files.layout_blocks(source(spark)), "T").orderBy("position").collect()
    assert got[0].text == "Document: T\nSection: Head\n\none\n\ntwo" and got[0].block_types == ["text", "list"]
    assert got[3].block_types == ["caption", "formula"] and [r.position for r in got] == list(range(len(got)))


def test_marked_pages(spark):
    docs = spark.createDataFrame([(1, "x--- Page 2 ---\nA--- Page 3 ---\n"), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in layout.marked_pages(docs).orderBy("doc_id").collect()] == [(1, 0, 2, "A", None), (2, None, None, None, "NO_TEXT")]
