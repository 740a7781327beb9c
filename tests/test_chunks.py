from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.config import Settings
from docengine.operators import blocks, chunks


def test_windows_of_text_without_blank_lines():
    text = "".join(chr(97 + i % 26) for i in range(3200))
    got = chunks.windows(text, 1500, 200)
    assert [len(w) for w in got] == [1500, 1500, 600] and got[1] == text[1300:2800]


def test_window_ends_at_a_blank_line_of_its_second_half():
    base = "x" * 4000
    early, late = base[:700] + "\n\n" + base[702:], base[:900] + "\n\n" + base[902:]
    assert len(chunks.windows(early)[0]) == 1500 and len(chunks.windows(late)[0]) == 900


def test_page_marks_drop_what_comes_first_and_empty_pages():
    assert chunks.pages("x--- Page 2 ---\nA--- Page 3 ---\n") == [(2, "A")]
    assert chunks.pages("plain") == [(None, "plain")]


def test_setext_rule_and_heading_stack():
    (u,) = blocks.parse("Title\n---\nbody")
    assert (u.path, u.text) == (["Title"], "body")
    assert [x.text for x in blocks.parse("a\n\n---\n\nb")] == ["a", "b"]
    assert blocks.parse("# A\n### B\n## C\ntext")[0].path == ["A", "C"]


def test_tables_fences_and_lists():
    assert [u.block_type for u in blocks.parse("|a|\n|---|\n|b|")] == ["text"]
    (code,) = blocks.parse("```py\nx")
    assert code.block_type == "code" and code.atomic and code.line_end == 2
    assert [u.block_type for u in blocks.parse("- a\nb")] == ["list", "text"]
    (table,) = blocks.parse("| a | b |\n|---|---|\n| 1 | 2 |")
    assert table.block_type == "table"


def test_heading_closer_and_empty_heading():
    assert blocks.parse("## T ##\nx")[0].path == ["T"]
    assert blocks.parse("# A\n#\nx")[0].path == ["A"]


def test_grouping_joins_while_it_fits():
    units = blocks.parse("a\n\n- b\n\nc")
    (g,) = blocks.group(units, 100)
    assert g.block_type == "text+list" or g.block_type == "text+list+text"
    assert len(blocks.group(units, 3)) == 3


def test_table_split_repeats_its_head():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(20))
    parts = chunks.split_table(table, 60)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 60 for p in parts)
    assert [r for p in parts for r in p.splitlines()[2:]] == table.splitlines()[2:]
    assert chunks.split_table("| a | b |\n|---|---|", 10) is None


def test_code_split_fences_each_part():
    parts = chunks.split_code("```py\n" + "\n".join("line" for _ in range(10)), 30)
    assert len(parts) > 1 and all(p.startswith("```py\n") and p.endswith("\n```") for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n。", min_size=0, max_size=400), st.integers(2, 20), st.integers(0, 1))
def test_token_pieces_fit_and_cover(text, budget, overlap):
    parts = chunks.split_tokens(text, budget, overlap)
    assert all(chunks.estimate(p) <= budget for p in parts)
    bare = lambda s: "".join(s.split())
    if overlap == 0:
        assert bare("".join(parts)) == bare(text)


def test_separators_are_tried_in_order():
    text = "a" * 10 + ". " + "b" * 10 + "\n\n" + "c" * 30
    assert chunks.split_tokens(text, 8)[0] == "a" * 10 + ". " + "b" * 10


def test_hierarchy_budgets_and_identity():
    cfg = Settings(parent_tokens=40, child_tokens=24, child_overlap=3)
    text = "# H\n\n" + "\n\n".join("word " * n for n in (3, 30, 5, 60, 2)) + "\n\n| a | b |\n|---|---|\n" + "\n".join("| x | y |" for _ in range(40))
    work = chunks.Hierarchy(cfg)
    parents, children = work.bundle("d", "markdown", "T", None, chunks.markdown_nodes(text))
    assert all(p[7] <= 40 for p in parents) and all(c[8] <= 24 for c in children)
    assert len({p[0] for p in parents}) == len(parents) and len({c[0] for c in children}) == len(children)
    assert {c[1] for c in children} == {p[0] for p in parents}
    assert work.bundle("d", "markdown", "T", None, chunks.markdown_nodes(text)) == (parents, children)


def test_binary_split():
    assert chunks.binary_split(list(range(5)), lambda b: len(b) < 3) == [[0, 1], [2], [3, 4]]
    assert chunks.binary_split([1, 2], lambda b: False) == [[1], [2]] and chunks.binary_split([], lambda b: True) == []


def test_closed_windows_equal_the_splitter(spark):
    docs = spark.createDataFrame([(1, "z" * 3200), (2, "y" * 10), (3, ""), (4, None)], "doc_id long, text string")
    a = sorted(map(tuple, chunks.closed_windows(docs).collect()))
    b = sorted(map(tuple, chunks.pieces(docs, chunks.windows).collect()))
    assert a == b


def test_too_many_requirement_chunks(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, ""), (3, "fine")], "doc_id long, text string")
    assert {r.doc_id: r.error_code for r in chunks.requirement_chunks(docs).collect()} == {1: "TOO_MANY_CHUNKS", 2: "NO_TEXT", 3: None}
