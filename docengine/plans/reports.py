"""Reports of requests over the test tables: orders stand for requests and results, customers for requirements, line items for evidence and runs, events for the outbox."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from ..catalog import register
from ..config import DEFAULTS
from ..operators import reports
from .base import read

NOW = dt.datetime(2024, 2, 1)


def capability_reports(spark, sf_dir):
    """A result for each order; its evidence as one text."""
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("requirement_id"), F.col("o_orderstatus").alias("status"))
    requirements = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requirement_id"), F.col("c_name").alias("requirement_key"), F.col("c_mktsegment").alias("requirement_text"))
    evidence = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("page"))
    rows = reports.capabilities(results, requirements, evidence)
    line = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["rank"].cast("string"), e["point_id"].cast("string"), e["page"].cast("string"))), ",")
    return rows.select("result_id", "requirement_key", "requirement_text", "status", line.alias("evidence"))


register("capability_reports", capability_reports, """
SELECT o_orderkey AS result_id, c_name AS requirement_key, c_mktsegment AS requirement_text, o_orderstatus AS status, coalesce(e, '') AS evidence
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS e FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")


def proposal_evidence(spark, sf_dir):
    """Accepted lines are selected, every other one with an order of its own; every fifth part has no title; snippets of 12 characters."""
    results = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(F.lit("")).alias("title"), F.col("p_brand").alias("filename"), F.col("p_type").alias("snippet"))
    n, picked = F.col("l_linenumber"), F.col("l_returnflag") == "A"
    lines = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    evidence = lines.select(F.col("l_orderkey").alias("result_id"), F.format_string("%d-%d", "l_partkey", "l_suppkey").alias("point_id"), n.alias("rank"), picked.alias("is_selected"), F.when(picked & (n % 2 == 0), 9 - n).alias("selection_order"), "title", "filename", "snippet", F.col("l_discount").alias("score"))
    rows = reports.context(results, evidence, cfg=replace(DEFAULTS, evidence_chars=12))
    line = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["point_id"], e["title"], e["snippet"])), ",")
    return rows.select("result_id", line.alias("evidence"))


register("proposal_evidence", proposal_evidence, """
WITH e AS (SELECT l_orderkey, l_partkey || '-' || l_suppkey AS point, l_linenumber AS n, l_returnflag = 'A' AS s, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 9 - l_linenumber ELSE l_linenumber END AS place,
  CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE p_brand END AS title, substr(p_type, 1, 12) AS snippet FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT *, bool_or(s) OVER (PARTITION BY l_orderkey) AS any_picked FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, n, point) AS k FROM a WHERE s OR NOT any_picked),
g AS (SELECT l_orderkey, string_agg(point || ':' || title || ':' || snippet, ',' ORDER BY k) AS e FROM t WHERE k <= 3 GROUP BY l_orderkey)
SELECT o_orderkey AS result_id, coalesce(e, '') AS evidence FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")


def proposal_documents(spark, sf_dir):
    """A proposal for each conversation with its turns as responses; as a digest."""
    rows = read(spark, sf_dir, "conversations")
    drafts = rows.groupBy(F.col("conv_id").alias("rfp_id")).agg(F.count("*").cast("string").alias("n"))
    drafts = drafts.select("rfp_id", F.concat(F.lit("Proposal "), "n").alias("title"), F.concat(F.lit(" summary of "), "n", F.lit("\n")).alias("executive_summary"), *[F.lit(c).alias(c) for _, c in reports.SECTIONS])
    t = F.col("turn")
    status = F.element_at(F.array(*[F.lit(x) for x in reports.LABELS]), (t % 6 + 1).cast("int"))
    responses = rows.select(F.col("conv_id").alias("rfp_id"), t.alias("position"), F.format_string("REQ-%04d", t).alias("requirement_key"), F.col("role").alias("requirement"), status.alias("capability_status"), F.lit("a|b\r\nc").alias("response"), F.col("role").alias("evidence_summary"), F.when(t % 2 == 0, F.lit("risk")).alias("risk_or_gap"))
    return reports.proposals(drafts, responses).select("rfp_id", F.char_length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_hash"))


register("proposal_documents", proposal_documents, f"""
WITH l AS (SELECT conv_id, count(*) AS n, string_agg('| REQ-' || lpad(turn::VARCHAR, 4, '0') || ': ' || role || ' | ' || {list(reports.LABELS.values())}[turn % 6 + 1] || ' | a\\|b c | ' || role || ' | ' || CASE WHEN turn % 2 = 0 THEN 'risk' ELSE '{reports.NO_RISK}' END || ' |', chr(10) ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id),
d AS (SELECT conv_id, replace('# Proposal ' || n || '@@## {reports.SUMMARY[0]}@@summary of ' || n || '@@## {reports.MATRIX}@@{reports.HEAD.replace(chr(10), "@")}@', '@', chr(10)) || t || replace('{"".join(f"@@## {a}@@{b}" for a, b in reports.SECTIONS)}@', '@', chr(10)) AS m FROM l)
SELECT conv_id AS rfp_id, length(m)::BIGINT AS n_chars, sha256(m) AS markdown_hash FROM d""")


def deleted(spark, sf_dir):
    """Requests of status P are deleted; low ones were before. A line is a run, an event of a user is one of the request of that number."""
    orders = read(spark, sf_dir, "orders")
    rfps = orders.select(F.col("o_orderkey").alias("rfp_id"), F.col("o_orderstatus").alias("status"), F.lit("queued").alias("current_stage"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit(dt.datetime(2024, 1, 1))).alias("deleted_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    runs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rfp_id"), "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "O", "RUNNING").otherwise("COMPLETED").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    outbox = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("event_key"), F.when(F.col("event_type") == "view", "PUBLISHED").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("last_error"))
    return reports.deletion(rfps, runs, outbox, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("rfp_id")), NOW)


register("deleted_requests", lambda s, d: deleted(s, d)[0].select("rfp_id", "status", "current_stage", F.col("completed_at").isNotNull().alias("ended")), """
SELECT o_orderkey AS rfp_id, CASE WHEN gone THEN 'ARCHIVED' ELSE o_orderstatus END AS status, CASE WHEN gone THEN 'deleted' ELSE 'queued' END AS current_stage, gone AS ended
FROM (SELECT *, o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AS gone FROM orders)""")
GONE = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')"
register("cancelled_runs", lambda s, d: deleted(s, d)[1].select("rfp_id", "l_linenumber", "l_partkey", "status", F.col("completed_at").isNotNull().alias("ended")), f"""
SELECT l_orderkey AS rfp_id, l_linenumber, l_partkey, CASE WHEN l_linestatus <> 'O' THEN 'COMPLETED' WHEN l_orderkey IN {GONE} THEN 'CANCELLED' ELSE 'RUNNING' END AS status, l_linestatus = 'O' AND l_orderkey IN {GONE} AS ended FROM lineitem""")
register("failed_events", lambda s, d: deleted(s, d)[2].select("event_id", "status", F.coalesce("last_error", F.lit("")).alias("last_error")), f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'PUBLISHED' WHEN user_id IN {GONE} THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN event_type <> 'view' AND user_id IN {GONE} THEN 'RFP_DELETED' ELSE '' END AS last_error FROM events""")


def merged_locations(spark, sf_dir):
    """Turns as nodes of their conversation: two blocks each, of which neighbours share one, and a box."""
    t = F.col("turn")
    block = lambda k: F.concat(F.lit("b"), k.cast("string"))
    nodes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), t.alias("position"), (t + 1).alias("start"), (t + 2).alias("end"), F.array(block(t), block(t + 1)).alias("block_ids"), F.array(F.array(t * 1.0, t + 0.5)).alias("bboxes"))
    boxes = F.array_join(F.transform("bboxes", lambda b: b[1].cast("string")), ",")
    return reports.locations(nodes).select("group_id", "start", "end", F.array_join("block_ids", ",").alias("block_ids"), boxes.alias("boxes"))


register("merged_locations", merged_locations, """
WITH b AS (SELECT conv_id, turn + unnest([0, 1]) AS k FROM conversations), u AS (SELECT conv_id, string_agg('b' || k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT conv_id, k FROM b) GROUP BY conv_id)
SELECT conv_id AS group_id, min(turn) + 1 AS start, max(turn) + 2 AS "end", any_value(ids) AS block_ids, string_agg(turn || '.5', ',' ORDER BY turn) AS boxes FROM conversations JOIN u USING (conv_id) GROUP BY conv_id""")
