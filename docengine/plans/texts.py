"""Text, hash and identity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar, text
from .base import read

ASCII = "a-z0-9._+/#-"
FOLD = "replace(lower({x}), 'ß', 'ss')"
SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def on(table: str, columns):
    """A query that selects ``columns(x)`` from a table; x is its column ``text``."""
    return lambda spark, sf_dir: read(spark, sf_dir, table).select(*columns(F.col("text")))


register("content_hash", on("documents", lambda x: ["doc_id", text.document_hash(x).alias("content_hash")]), "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '[\\t ]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS content_hash FROM documents")
register("checksum_sha256", on("pages", lambda x: ["page_id", F.sha2("html", 256).alias("checksum"), (F.octet_length("html") > 50 << 20).alias("too_large")]), "SELECT page_id, sha256(html) AS checksum, strlen(html) > 52428800 AS too_large FROM pages")
register("fingerprint", on("benchmark", lambda x: ["item_id", text.fingerprint(x).alias("fingerprint")]), f"SELECT item_id, sha256({FOLD.format(x=SQUEEZE.format(x='text'))}) AS fingerprint FROM benchmark")
register("embedding_hash", on("documents", lambda x: ["doc_id", text.embedding_hash(F.lit("model-a"), F.lit(1024), x).alias("embedding_hash")]), "SELECT doc_id, sha256('model-a' || chr(31) || '1024' || chr(31) || text) AS embedding_hash FROM documents")
register("structural_hash", on("conversations", lambda x: ["conv_id", "turn", text.structural_hash(F.array("role"), F.array(F.lit("A"), F.col("role")), F.lit("markdown")).alias("structural_hash")]), """SELECT conv_id, turn, sha256('{"block_types":["' || role || '"],"section_path":["A","' || role || '"],"source_type":"markdown"}') AS structural_hash FROM conversations""")
register("parent_anchor", on("conversations", lambda x: ["conv_id", "turn", text.parent_anchor(F.lit("docx"), F.array(F.lit("A"), F.col("role")), F.array("role"), F.sha2("text", 256)).alias("anchor")]), "SELECT conv_id, turn, sha256('docx' || chr(31) || 'A' || chr(30) || role || chr(31) || role || chr(31) || sha256(text)) AS anchor FROM conversations")
register("section_ids", on("conversations", lambda x: ["conv_id", "turn", text.section_id(F.when(F.col("turn") % 2 == 0, F.array(F.lit("Straße"), F.col("role"))).otherwise(F.array().cast("array<string>")), F.when(F.col("turn") % 3 == 0, F.col("turn"))).alias("section_id")]), "SELECT conv_id, turn, 'section:' || substr(sha256(CASE WHEN turn % 2 = 0 THEN 'strasse > ' || role WHEN turn % 3 = 0 THEN 'page:' || turn::VARCHAR ELSE 'document' END), 1, 16) AS section_id FROM conversations")
UUID = """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h"""
register("uuid5_ids", on("documents", lambda x: ["doc_id", text.uuid5(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))).alias("uuid")]), UUID)
register("token_estimate", on("documents", lambda x: ["doc_id", text.token_estimate(x).alias("tokens")]), "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents")
register("word_count_unicode", on("documents", lambda x: ["doc_id", text.word_count(x).alias("words")]), "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+'))::BIGINT AS words FROM documents")
register("text_quality", on("documents", lambda x: ["doc_id", text.visible_count(x).alias("visible"), text.garbled_count(x).alias("garbled"), F.round(text.garbled_count(x) / F.greatest(F.lit(1), text.visible_count(x)), 6).alias("garbled_ratio")]), "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS visible, len(regexp_extract_all(regexp_replace(text, '\\s', '', 'g'), '[\\x{FFFD}\\p{Cc}]'))::BIGINT AS garbled, round(len(regexp_extract_all(regexp_replace(text, '\\s', '', 'g'), '[\\x{FFFD}\\p{Cc}]')) / greatest(1, length(regexp_replace(text, '\\s', '', 'g')))::DOUBLE, 6) AS garbled_ratio FROM documents")
register("casefold", on("documents", lambda x: ["doc_id", F.sha2(text.casefold(x), 256).alias("folded")]), f"SELECT doc_id, sha256({FOLD.format(x='text')}) AS folded FROM documents")
register("whitespace_squeeze", on("documents", lambda x: ["doc_id", F.sha2(text.squeeze(x), 256).alias("squeezed")]), f"SELECT doc_id, sha256({SQUEEZE.format(x='text')}) AS squeezed FROM documents")
register("context_prefix", on("documents", lambda x: ["doc_id", F.sha2(text.context_prefix(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.col("lang"), F.array("source"), x), 256).alias("embedding_text")]), "SELECT doc_id, sha256('Document: Doc ' || doc_id::VARCHAR || chr(10) || 'Version: ' || lang || chr(10) || 'Section: ' || source || chr(10) || chr(10) || text) AS embedding_text FROM documents")
register("query_text", on("benchmark", lambda x: ["item_id", F.format_string("Category: %s\nRequirement: %s", F.lit("general"), x).alias("query_text")]), "SELECT item_id, 'Category: general' || chr(10) || 'Requirement: ' || text AS query_text FROM benchmark")
register("rerank_text", on("documents", lambda x: ["doc_id", F.sha2(F.concat(F.lit("Title: "), F.col("source"), F.lit("\nCategory: "), F.col("lang"), F.lit("\nSection: Unsectioned\nEvidence: "), F.substring("text", 1, 1200)), 256).alias("rerank_text")]), "SELECT doc_id, sha256('Title: ' || source || chr(10) || 'Category: ' || lang || chr(10) || 'Section: Unsectioned' || chr(10) || 'Evidence: ' || substr(text, 1, 1200)) AS rerank_text FROM documents")
register("snippets", on("documents", lambda x: ["doc_id", F.substring("text", 1, 200).alias("snippet")]), "SELECT doc_id, substr(text, 1, 200) AS snippet FROM documents")
register("item_ids", on("benchmark", lambda x: ["item_id", text.item_id(F.concat(F.lit("B-0"), F.col("item_id").cast("string"), F.lit(" "), x)).alias("key")]), "SELECT item_id, CASE WHEN length(item_id::VARCHAR) >= 1 THEN 'B-0' || item_id::VARCHAR END AS key FROM benchmark")
register("markdown_cells", on("pages", lambda x: ["page_id", F.sha2(text.markdown_cell(F.col("html")), 256).alias("cell")]), "SELECT page_id, sha256(replace(regexp_replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', ' ', 'g'), '|', '\\|')) AS cell FROM pages")
register("file_names", on("pages", lambda x: ["page_id", text.ascii_name(F.col("url")).alias("ascii_name")]), "SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 200) AS ascii_name FROM pages")
register("unicode_file_names", on("pages", lambda x: ["page_id", text.unicode_name(F.col("url")).alias("name")]), "SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS name FROM pages")
register("markdown_source", on("pages", lambda x: ["page_id", F.sha2(text.strip(F.regexp_replace(F.regexp_replace("html", "^\\x{FEFF}", ""), "\r\n|\r", "\n")), 256).alias("text_hash"), F.col("html").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]").alias("has_control")]), "SELECT page_id, sha256(regexp_replace(regexp_replace(html, '\\r\\n|\\r', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_hash, regexp_matches(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS has_control FROM pages")
register("backoff_delays", on("events", lambda x: ["event_id", scalar.backoff((F.col("event_id") % 40 - 5).cast("int")).alias("relay"), scalar.transport_delay((F.col("event_id") % 6).cast("int")).alias("transport"), scalar.restart_delay((F.col("event_id") % 9 + 1).cast("int")).alias("restart")]), "SELECT event_id, least(300.0, pow(2.0, least(30, greatest(0, event_id % 40 - 5))))::DOUBLE AS relay, least(pow(2.0, event_id % 6), 8.0)::DOUBLE AS transport, least(pow(2.0, least(event_id % 9, 5)), 30.0)::DOUBLE AS restart FROM events")
register("duration_labels", on("orders", lambda x: ["o_orderkey", scalar.duration_label((F.col("o_orderkey") * 37 % 9000).cast("long")).alias("label")]), "SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h ' || (s % 3600 // 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm ' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS label FROM (SELECT o_orderkey, o_orderkey * 37 % 9000 AS s FROM orders)")
register("rounded_scores", on("lineitem", lambda x: ["l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 4).cast("decimal(18,4)").cast("double").alias("confidence"), F.ceil(F.col("l_extendedprice") / 1024).cast("long").alias("kb")]), "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4)::DECIMAL(18,4)::DOUBLE AS confidence, ceil(l_extendedprice / 1024)::BIGINT AS kb FROM lineitem")


def exact_dedup(spark, sf_dir):
    """The first document of each content; ARCHIVED ones (source src0) stay out."""
    docs = read(spark, sf_dir, "documents").where("source <> 'src0'")
    first = docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return first.select("content_hash", "doc_id", "copies")


register("exact_dedup_first_wins", exact_dedup, "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE source <> 'src0' GROUP BY 1")


def requirement_dedup(spark, sf_dir):
    """The most confident row of each key, at the place where the key came first."""
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("B-"), F.col("l_partkey").cast("string")).alias("key"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    best = rows.groupBy("key").agg(F.min("pos").alias("first_pos"), F.max(F.struct("confidence", (-F.col("pos")).alias("neg"))).alias("best"))
    return best.select("key", "first_pos", F.col("best.confidence").alias("confidence"), (-F.col("best.neg")).alias("kept_pos"))


register("requirement_dedup", requirement_dedup, """WITH r AS (SELECT 'B-' || l_partkey::VARCHAR AS key, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
SELECT key, min(pos) AS first_pos, max(confidence) AS confidence, arg_min(pos, (-confidence, pos)) AS kept_pos FROM r GROUP BY key""".replace("arg_min(pos, (-confidence, pos))", "first(pos ORDER BY confidence DESC, pos)"))


def requirement_keys(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("REQ-%04d", F.row_number().over(order)).alias("requirement_key"), text.fingerprint(F.col("text")).alias("fingerprint"))


register("requirement_keys", requirement_keys, f"SELECT conv_id, turn, 'REQ-' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 4, '0') AS requirement_key, sha256({FOLD.format(x=SQUEEZE.format(x='text'))}) AS fingerprint FROM conversations")
register("code_and_category", lambda s, d: read(s, d, "customer").select("c_custkey", text.code(F.lower("c_name")).alias("code"), text.category(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).alias("category")), "SELECT c_custkey, upper(lower(c_name)) AS code, lower(c_mktsegment) AS category FROM customer")
register(
    "content_types",
    lambda s, d: read(s, d, "documents").select("doc_id", text.content_type(F.concat("source", F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".docx", ".md", ".markdown", ".exe")]), (F.col("doc_id") % 5 + 1).cast("int"))), F.when(F.col("doc_id") % 3 == 0, "application/octet-stream").when(F.col("doc_id") % 3 == 1, "text/plain")).alias("content_type")),
    """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'text/plain' ELSE ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/markdown', 'text/markdown', NULL][doc_id % 5 + 1] END AS content_type FROM documents""",
)
