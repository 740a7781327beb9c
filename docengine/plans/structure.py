"""Structure queries: chunking, Markdown, geometry, incremental updates, layout, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text
from ..operators import blocks, chunks, geometry, incremental, layout, listing, models
from ..sources import files
from .base import read


def markdown_of_conversations(spark, sf_dir):
    """One Markdown text per conversation: turns as sections, texts as paragraphs, every third one as a table, every fifth as code."""
    n = F.col("turn")
    body = F.when(n % 5 == 4, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(n % 3 == 2, F.concat(F.lit("| a | b |\n|---|---|\n| "), F.replace("text", F.lit("|"), F.lit("/")), F.lit(" | x |"))).otherwise(F.col("text"))
    part = F.concat(F.repeat(F.lit("#"), (n % 3 + 1).cast("int")), F.lit(" "), F.col("role"), F.lit(" "), n.cast("string"), F.lit("\n\n"), body)
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"))


def char_window_chunks(spark, sf_dir):
    rows = chunks.closed_windows(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("position").cast("int").alias("position"), F.sha2("piece", 256).alias("piece_hash"))


register("char_window_chunks", char_window_chunks, """
SELECT doc_id, k::INT AS position, sha256(substr(text, (k * 1300 + 1)::BIGINT, 1500)) AS piece_hash
FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1500) / 1300.0))::BIGINT)) AS k FROM documents WHERE length(text) > 0)""")


def char_window_splitter(spark, sf_dir):
    """The general splitter on the same texts: they hold no blank lines, but edges are stripped."""
    return chunks.pieces(read(spark, sf_dir, "documents"), chunks.windows)


register("char_window_splitter", char_window_splitter)
register("markdown_units", lambda s, d: blocks.units(markdown_of_conversations(s, d)))
register("token_split", lambda s, d: chunks.pieces(read(s, d, "documents"), lambda t: chunks.split_tokens(t, 350, 40)))
register("requirement_chunks", lambda s, d: chunks.requirement_chunks(read(s, d, "documents").select("doc_id", "text")))
register("table_split", lambda s, d: chunks.pieces(markdown_of_conversations(s, d), lambda t: [p for u in blocks.parse(t) if u.block_type == "table" for p in chunks.split_table(u.text, 200) or []]))
register("code_split", lambda s, d: chunks.pieces(markdown_of_conversations(s, d), lambda t: [p for u in blocks.parse(t) if u.block_type == "code" for p in chunks.split_code(u.text, 200) or []]))
register("markdown_chunks", lambda s, d: chunks.pieces(markdown_of_conversations(s, d), lambda t: [p for u in blocks.group(blocks.parse(t), 1500) for p in chunks.split_unit(u, 1500, 200)]))


def bundle(level: str):
    def run(spark, sf_dir):
        docs = markdown_of_conversations(spark, sf_dir).withColumns({"title": F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), "version": F.lit("1"), "source_type": F.lit("markdown")})
        return chunks.hierarchical(docs, level)

    return run


register("hierarchical_bundle", bundle("children"))
register("hierarchical_parents", bundle("parents"))


def page_marker_sections(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.concat(F.lit("cover"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("--- Page "), x["turn"].cast("string"), F.lit(" ---\n"), x["text"])), ""))
    parts = rows.select("conv_id", F.regexp_extract_all(body, F.lit(r"--- Page (\d+) ---\n"), 1).alias("pages"), F.slice(F.split(body, r"--- Page \d+ ---\n"), 2, 1_000_000).alias("texts"))
    flat = parts.select("conv_id", F.posexplode(F.arrays_zip("pages", "texts")).alias("k", "z"))
    return flat.select("conv_id", F.col("z.pages").cast("long").alias("page"), text.strip(F.col("z.texts")).alias("text")).where("text <> ''")


register("page_marker_sections", page_marker_sections, "SELECT conv_id, turn::BIGINT AS page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")


def greedy_pack_nodes(spark, sf_dir):
    """Consecutive turns packed while they fit 600 characters with two between each: a fold over each conversation's ordered turns."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("n")))).alias("t"))

    def step(acc, x):
        fits = acc["size"] + 2 + x["n"] <= 600
        number = F.when(acc["size"] < 0, F.lit(0)).when(fits, acc["number"]).otherwise(acc["number"] + 1)
        size = F.when((acc["size"] >= 0) & fits, acc["size"] + 2 + x["n"]).otherwise(x["n"])
        return F.struct(number.cast("int").alias("number"), size.alias("size"), F.concat(acc["out"], F.array(F.struct(x["turn"].alias("turn"), number.cast("int").alias("pack")))).alias("out"))

    start = F.struct(F.lit(0).alias("number"), F.lit(-1).cast("long").alias("size"), F.array().cast("array<struct<turn:bigint,pack:int>>").alias("out"))
    return rows.select("conv_id", F.explode(F.aggregate("t", start, step)["out"]).alias("o")).select("conv_id", "o.turn", "o.pack")


register("greedy_pack_nodes", greedy_pack_nodes, """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, n AS size, 0 AS pack FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN p.size + 2 + t.n <= 600 THEN p.size + 2 + t.n ELSE t.n END, CASE WHEN p.size + 2 + t.n <= 600 THEN p.pack ELSE p.pack + 1 END FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)
SELECT conv_id, turn, pack::INT AS pack FROM p""")


def heading_path(spark, sf_dir):
    """Levels carried forward: a heading of level L ends those of L and deeper."""
    rows = read(spark, sf_dir, "conversations").withColumn("level", F.col("turn") % 3 + 1)
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("turn"))).over(upto))
    last = lambda k: F.greatest(F.lit(-1), *[F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(1, k)])
    names = [F.when(F.col(f"at{k}") > (last(k) if k > 1 else F.lit(-1)), F.concat(F.lit(f"h{k}-"), F.col(f"at{k}").cast("string"))) for k in (1, 2, 3)]
    return rows.select("conv_id", "turn", F.concat_ws(" > ", *names).alias("path"))


register("heading_path", heading_path, """
WITH h AS (SELECT conv_id, turn, max(CASE WHEN turn % 3 = 0 THEN turn END) OVER w AS a, max(CASE WHEN turn % 3 = 1 THEN turn END) OVER w AS b, max(CASE WHEN turn % 3 = 2 THEN turn END) OVER w AS c
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, concat_ws(' > ', CASE WHEN a IS NOT NULL THEN 'h1-' || a END, CASE WHEN b > coalesce(a, -1) THEN 'h2-' || b END, CASE WHEN c > greatest(coalesce(a, -1), coalesce(b, -1)) THEN 'h3-' || c END) AS path FROM h""")


def caption_carry(spark, sf_dir):
    """A caption (user turn) joins the block right after it if that is a figure (assistant turn)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"before": F.lag("role").over(order), "caption": F.lag("text").over(order), "after": F.lead("role").over(order)})
    rows = rows.where(~((F.col("role") == "user") & (F.coalesce("after", F.lit("")) == "assistant")))
    joined = F.when((F.col("role") == "assistant") & (F.coalesce("before", F.lit("")) == "user"), F.concat_ws("\n\n", "caption", "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.sha2(joined, 256).alias("text_hash"))


register("caption_carry", caption_carry, """
WITH r AS (SELECT *, lag(role) OVER w AS b, lag(text) OVER w AS c, lead(role) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256(CASE WHEN role = 'assistant' AND coalesce(b, '') = 'user' THEN c || chr(10) || chr(10) || text ELSE text END) AS text_hash FROM r WHERE NOT (role = 'user' AND coalesce(a, '') = 'assistant')""")


def docx_paragraphs(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("line", text.strip(F.col("line"))).where("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("k")
    return lines.select("doc_id", F.format_string("docx_b%04d", F.row_number().over(order)).alias("block_id"), F.sha2("line", 256).alias("line_hash"))


register("docx_paragraphs", docx_paragraphs, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), s AS (SELECT doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l)
SELECT doc_id, 'docx_b' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY k))::VARCHAR, 4, '0') AS block_id, sha256(line) AS line_hash FROM s WHERE line <> ''""")


def rectangles(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 70).cast("double"), (F.col("l_suppkey") % 60).cast("double")
    return rows.select(F.col("l_orderkey").alias("page_id"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_quantity") / 2).alias("y1"), F.lit(97.0).alias("width"), F.lit(83.0).alias("height"))


RECTANGLES = """
r AS (SELECT l_orderkey AS page_id, least((l_partkey % 70)::DOUBLE, 97) AS x0, least((l_suppkey % 60)::DOUBLE, 83) AS y0, least(l_partkey % 70 + l_quantity, 97)::DOUBLE AS x1, least(l_suppkey % 60 + l_quantity / 2, 83)::DOUBLE AS y1 FROM lineitem),
e AS (SELECT DISTINCT page_id, unnest([x0, x1]) AS x FROM r), s AS (SELECT page_id, x, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS rt FROM e),
i AS (SELECT s.page_id, s.x, s.rt, r.y0, r.y1, max(r.y1) OVER (PARTITION BY s.page_id, s.x ORDER BY r.y0, r.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s JOIN r ON s.page_id = r.page_id AND r.x0 < s.rt AND r.x1 > s.x WHERE rt IS NOT NULL),
u AS (SELECT page_id, round(least(1.0, sum(greatest(0.0, y1 - greatest(y0, coalesce(m, 0))) * (rt - x)) / 8051.0)::DOUBLE, 6) AS coverage FROM i GROUP BY page_id)"""
register("rect_union_area", lambda s, d: geometry.union_area(rectangles(s, d)), f"WITH {RECTANGLES} SELECT * FROM u")


def page_quality(spark, sf_dir):
    """Turns as pages, numbered by conversation and turn; the rectangles of the order of that number as images. Some turns are shorter than a page's least text."""
    number = F.col("conv_id") * 8 + F.col("turn")
    pages = read(spark, sf_dir, "conversations").groupBy(number.alias("page_id")).agg(F.max("text").alias("text"))
    return geometry.page_quality(pages, rectangles(spark, sf_dir)).select("page_id", "page_type", "confidence", "requires_ocr", "chars", "coverage", "significant")


register("page_quality", page_quality, f"""
WITH {RECTANGLES},
p AS (SELECT conv_id * 8 + turn AS page_id, length(regexp_replace(max(text), '\\s', '', 'g'))::BIGINT AS chars FROM conversations GROUP BY 1),
g AS (SELECT page_id, count_if((x1 - x0) * (y1 - y0) / 8051 >= 0.02 AND (xr - x0) / 97 >= 0.2 AND (yr - y0) / 83 >= 0.08)::BIGINT AS significant
  FROM (SELECT *, x0 + l_q AS xr, y0 + l_q / 2 AS yr FROM (SELECT l_orderkey AS page_id, (l_partkey % 70)::DOUBLE AS x0, (l_suppkey % 60)::DOUBLE AS y0, l_quantity AS l_q, least(l_partkey % 70 + l_quantity, 97)::DOUBLE AS x1, least(l_suppkey % 60 + l_quantity / 2, 83)::DOUBLE AS y1 FROM lineitem)) GROUP BY page_id),
f AS (SELECT p.page_id, chars, coalesce(coverage, 0.0) AS coverage, coalesce(significant, 0) AS significant FROM p LEFT JOIN g USING (page_id) LEFT JOIN u USING (page_id)),
k AS (SELECT *, CASE WHEN chars = 0 AND NOT (coverage >= 0.6 OR significant > 0) THEN 'empty' WHEN chars < 20 AND (coverage >= 0.6 OR significant > 0) THEN 'scanned' WHEN coverage >= 0.35 THEN 'mixed' ELSE 'text' END AS page_type FROM f)
SELECT page_id, page_type, round(CASE page_type WHEN 'empty' THEN 1.0 WHEN 'scanned' THEN greatest(0.5, coverage) WHEN 'mixed' THEN greatest(0.5, least(1.0, (least(1.0, chars / 20.0) + coverage) / 2)) ELSE greatest(0.5, 0.8 + 0.2 * least(1.0, chars / 20.0)) END, 6)::DOUBLE AS confidence,
  page_type IN ('scanned', 'mixed') AS requires_ocr, chars, coverage, significant FROM k""")


def versions(spark, sf_dir):
    """Two versions of an index: each source is a document, its rows the chunks; the new one drops, edits, moves and adds some."""
    docs = read(spark, sf_dir, "documents").withColumn("d", F.substring("source", 4, 9).cast("long"))
    order = Window.partitionBy("d").orderBy("doc_id")
    rows = docs.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    structure, content = F.md5(F.concat_ws("-", "lang", F.col("doc_id").cast("string"))), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256)
    old = rows.where("doc_id % 11 <> 3").select(F.col("d").alias("doc_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "position", structure.alias("structural_hash"), content.alias("embedding_hash"))
    k = F.col("doc_id")
    moved = F.when(k % 7 == 2, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string")))
    edited = F.when(k % 5 == 1, F.sha2(F.concat_ws("|", k.cast("string"), F.lit("edited")), 256)).otherwise(content)
    new = rows.where("doc_id % 13 <> 4").select(F.col("d").alias("doc_id"), moved.alias("chunk_id"), (F.col("position") + 1).cast("int").alias("position"), structure.alias("structural_hash"), edited.alias("embedding_hash"))
    return old, new


DIFF = """
WITH d AS (SELECT *, substr(source, 4)::BIGINT AS d, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS p FROM documents),
x AS (SELECT d, CASE WHEN doc_id % 13 <> 4 THEN CASE WHEN doc_id % 7 = 2 THEN 'n' || doc_id ELSE 'c' || doc_id END END AS chunk_id, CASE WHEN doc_id % 13 <> 4 THEN p + 1 END AS position,
  CASE WHEN doc_id % 13 = 4 THEN 'DELETED' WHEN doc_id % 11 = 3 THEN 'ADDED' WHEN doc_id % 7 <> 2 AND doc_id % 5 <> 1 THEN 'UNCHANGED' WHEN doc_id % 5 <> 1 THEN 'MOVED' ELSE 'MODIFIED' END AS kind,
  CASE WHEN doc_id % 11 <> 3 THEN 'c' || doc_id END AS old_chunk_id, CASE WHEN doc_id % 11 <> 3 THEN p END AS old_position FROM d WHERE NOT (doc_id % 13 = 4 AND doc_id % 11 = 3))
"""
register("incremental_diff", lambda s, d: incremental.diff_unique(*versions(s, d)), DIFF + "SELECT d AS doc_id, chunk_id, position::INT AS position, kind, old_chunk_id, old_position::INT AS old_position FROM x")
register("incremental_diff_greedy", lambda s, d: incremental.diff(*versions(s, d)), DIFF + "SELECT d AS doc_id, chunk_id, position::INT AS position, kind, old_chunk_id, old_position::INT AS old_position FROM x")
register("incremental_stats", lambda s, d: incremental.statistics(incremental.diff_unique(*versions(s, d))), DIFF + """SELECT d AS doc_id, count_if(kind = 'UNCHANGED')::BIGINT AS unchanged, count_if(kind = 'MOVED')::BIGINT AS moved, count_if(kind = 'MODIFIED')::BIGINT AS modified, count_if(kind = 'ADDED')::BIGINT AS added, count_if(kind = 'DELETED')::BIGINT AS deleted, count_if(kind IN ('MODIFIED', 'ADDED'))::BIGINT AS embedded FROM x GROUP BY d""")


def vector_upsert(spark, sf_dir):
    """Vectors of even ids are replaced by those of the id before, and new ones added."""
    index = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    changes = index.where("point_id % 2 = 0").select(F.when(F.col("point_id") % 4 == 0, F.col("point_id")).otherwise(F.col("point_id") + 1_000_000).alias("point_id"), (F.col("label") + 100).alias("label"))
    return incremental.upsert(index, changes, "point_id")


register("vector_upsert", vector_upsert, """
SELECT vec_id AS point_id, (CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END)::INT AS label FROM embeddings
UNION ALL SELECT vec_id + 1000000, (label + 100)::INT FROM embeddings WHERE vec_id % 4 = 2""")


def html_table_markdown(spark, sf_dir):
    """Tables made of conversations: a row per turn, one cell short every third turn."""
    cell = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("+")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    row = F.concat(F.lit("<tr><td>"), F.col("role"), F.lit("</td>"), F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.concat(F.lit("<td>"), cell, F.lit("</td>"))), F.lit("</tr>"))
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))).alias("t"))
    html = F.concat(F.lit("<p>x</p><table>"), F.array_join(F.transform("t", lambda x: x["r"]), ""), F.lit("</table>"))
    return files.html_tables(rows.select("page_id", html.alias("html"))).select("page_id", "position", F.sha2("markdown", 256).alias("markdown_hash"))


register("html_table_markdown", html_table_markdown, r"""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, max(CASE WHEN turn % 3 = 2 THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id) AS width, role,
  CASE WHEN turn % 3 = 2 THEN '' ELSE replace(replace(regexp_replace(replace(replace(replace(text, '&', '+'), '<', '('), '>', ')'), '^\s+|\s+$', '', 'g'), '|', '\|'), chr(10), ' ') END AS cell FROM conversations),
l AS (SELECT conv_id, n, '| ' || role || CASE WHEN width = 2 THEN ' | ' || cell ELSE '' END || ' |' || CASE WHEN n = 1 THEN chr(10) || CASE WHEN width = 2 THEN '| --- | --- |' ELSE '| --- |' END ELSE '' END AS line FROM r)
SELECT conv_id AS page_id, 0::INT AS position, sha256(string_agg(line, chr(10) ORDER BY n)) AS markdown_hash FROM l GROUP BY conv_id""")


def layout_source(spark, sf_dir):
    """Layout JSON made of conversations: one page per conversation, a block per turn."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    block = lambda x: F.struct(F.when(x["turn"] % 4 == 0, "title").when(x["turn"] % 4 == 1, "text").when(x["turn"] % 4 == 2, "chart").otherwise("page_number").alias("type"), F.array(F.lit(0.0), x["turn"] * 10.0, F.lit(50.0), x["turn"] * 10.0 + 8).alias("bbox"), F.array(F.struct(F.array(F.struct(x["text"].alias("content"))).alias("spans"))).alias("lines"))
    page = F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(100.0), F.lit(200.0)).alias("page_size"), F.transform("t", block).alias("preproc_blocks"))
    docs = rows.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("layout"), F.lit(500.0).alias("width"), F.lit(1000.0).alias("height"))
    return files.layout_blocks(docs)


def layout_blocks(spark, sf_dir):
    out = layout_source(spark, sf_dir)
    return out.select("doc_id", "reading_order", "type", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.col("bbox.y0").alias("y0"), F.coalesce("warning", F.lit("")).alias("warning"))


register("layout_blocks", layout_blocks, """
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS reading_order, CASE turn % 4 WHEN 0 THEN 'title' WHEN 3 THEN 'footer' ELSE 'text' END AS type,
  sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_hash, (turn * 10.0 / 200.0 * 1000.0)::DOUBLE AS y0, CASE WHEN turn % 4 = 2 THEN 'UNMAPPED_BLOCK' ELSE '' END AS warning FROM conversations""")


register("layout_nodes", lambda s, d: layout.to_nodes(layout_source(s, d)))
register("layout_chunks", lambda s, d: layout.to_chunks(layout_source(s, d), "Doc", "1"))
register("layout_summary", lambda s, d: files.bundle_summary(layout_source(s, d)), """
SELECT conv_id AS doc_id, 1::BIGINT AS pages, count(*) AS blocks, count_if(turn % 4 = 2)::BIGINT AS warnings, CASE WHEN count_if(turn % 4 = 2) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCEEDED' END AS status FROM conversations GROUP BY conv_id""")


def page_marked_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.concat(F.lit("cover"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("--- Page "), x["turn"].cast("string"), F.lit(" ---\n"), x["text"])), ""))
    return layout.marked_pages(rows.select(F.col("conv_id").alias("doc_id"), body.alias("text")))


register("page_marked_windows", page_marked_windows)


def pdf_preflight(spark, sf_dir):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    files_ = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (k % 11 != 0).alias("is_pdf"), (k % 13 == 0).alias("encrypted"), (k * 37 % 700).cast("int").alias("pages"))
    return geometry.preflight(files_).select("l_orderkey", "l_linenumber", "error_code")


register("pdf_preflight", pdf_preflight, """
SELECT l_orderkey, l_linenumber, CASE WHEN k % 11 = 0 THEN 'NOT_A_PDF' WHEN k % 13 = 0 THEN 'ENCRYPTED' WHEN k * 37 % 700 = 0 THEN 'NO_PAGES' WHEN k * 37 % 700 > 500 THEN 'TOO_MANY_PAGES' END AS error_code
FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)""")


def ir_round_trip(spark, sf_dir):
    """Nodes to JSON and back: nothing is lost."""
    schema = "struct<role:string,text:string,turn:bigint>"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text", "turn").alias("node"))
    return rows.select("conv_id", "turn", (F.from_json(F.to_json("node"), schema) == F.col("node").cast(schema)).alias("equal"))


register("ir_round_trip", ir_round_trip, "SELECT conv_id, turn, TRUE AS equal FROM conversations")


def sliding_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("w", F.window("ts", "2 hours", "1 hour"))
    return rows.groupBy(F.col("w.start").alias("window_start")).agg(F.count("*").alias("n"))


register("sliding_counts", sliding_counts, "SELECT window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM events) GROUP BY 1")


def binary_split_sizes(spark, sf_dir):
    """Batches of a conversation's turns that are halved until none has over three."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(c, i, len(b)) for c, n in zip(f["conv_id"], f["n"]) for i, b in enumerate(chunks.binary_split(list(range(n)), lambda b: len(b) <= 3))]
            yield pd.DataFrame(rows, columns=["conv_id", "batch", "size"])

    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).mapInPandas(run, "conv_id long, batch int, size int")


register("binary_split_sizes", binary_split_sizes)


def listed(spark, sf_dir):
    rows = listing.filtered(read(spark, sf_dir, "orders"), o_orderstatus=["O", "P"])
    return listing.matching(rows, " URG ", "o_orderpriority", "o_orderstatus")


def rfp_list_page(spark, sf_dir):
    rows, _ = listing.page(listed(spark, sf_dir), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


LISTED = "FROM orders WHERE o_orderstatus IN ('O', 'P') AND contains(o_orderpriority, 'URG')"
register("rfp_list_page", rfp_list_page, f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate {LISTED} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
register("rfp_list_total", lambda s, d: listing.page(listed(s, d), [F.col("o_orderkey")], 20)[1], f"SELECT count(*) AS n {LISTED}")


def ingest_duplicates(spark, sf_dir):
    """Documents, and once more with spaces at the end: copies by content, not by checksum."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.select((F.col("doc_id") + 10_000_000_000).alias("doc_id"), F.concat("text", F.lit("  \n")).alias("text"))
    return listing.ingest(docs.unionByName(again))


register("ingest_duplicates", ingest_duplicates, """
WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 10000000000, text || '  ' || chr(10) FROM documents),
h AS (SELECT doc_id, sha256(text) AS c, trim(regexp_replace(regexp_replace(text, '[\\t ]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS n FROM d),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS a, min(doc_id) OVER (PARTITION BY n) AS b FROM h)
SELECT doc_id, CASE WHEN a < doc_id THEN a WHEN b < doc_id THEN b END AS duplicate_of, CASE WHEN a < doc_id THEN 'CHECKSUM' WHEN b < doc_id THEN 'CONTENT' END AS reason FROM f""")


def citation_validation(spark, sf_dir):
    """Orders as judgments: suppliers of open lines are available, those of accepted lines selected; even orders need a review."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("available"), F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("selected"))
    rows = rows.withColumn("status", F.when(F.col("l_orderkey") % 2 == 0, "NEED_REVIEW").otherwise("SUPPORTED"))
    return models.citations(rows).select("l_orderkey", "error_code")


register("citation_validation", citation_validation, """
SELECT l_orderkey, CASE WHEN len(list_distinct(a)) < len(a) THEN 'DUPLICATE_AVAILABLE' WHEN len(list_distinct(s)) < len(s) THEN 'DUPLICATE_SELECTED' WHEN len(list_filter(s, lambda x: NOT list_contains(a, x))) > 0 THEN 'UNKNOWN_SELECTED'
  WHEN l_orderkey % 2 = 1 AND len(s) = 0 THEN 'NOTHING_SELECTED' END AS error_code
FROM (SELECT l_orderkey, coalesce(list(l_suppkey) FILTER (l_linestatus = 'O'), []) AS a, coalesce(list(l_suppkey) FILTER (l_returnflag = 'A'), []) AS s FROM lineitem GROUP BY l_orderkey)""")


def token_counts(spark, sf_dir):
    """Tokens of whole documents by a public file of byte-pair ranks."""
    import public_tokenizers

    return chunks.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


register("token_counts", token_counts)
