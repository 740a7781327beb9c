"""Listings, joins, aggregates and workflow views.

Orders stand for requests (status, priority, creation date), customers for customers, line items for evidence rows
(order: result, line number: rank, discount: score, return flag A: selected), events for the event log.
"""

from __future__ import annotations

from .base import sql_query as q

# Scans, filters, listings
q("table_scan_by_key", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey = 1000")
q("rfp_count", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'F' AND o_orderpriority LIKE '%URG%' GROUP BY o_orderstatus")
q("customer_search", """
  SELECT c_custkey, c_name, c_mktsegment FROM {customer}
  WHERE (contains(c_name, '11') OR contains(c_mktsegment, 'BUILD')) AND c_acctbal IS NOT NULL ORDER BY c_name, c_custkey LIMIT 50""")
q("client_search", """
  SELECT o_orderkey FROM {orders} WHERE contains(lower(concat_ws(' ', o_orderpriority, CAST(o_orderkey AS STRING))), 'high 1')""")
q("blank_search_keeps_all", """
  WITH s AS (SELECT n_nationkey, nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN '  ' WHEN n_nationkey % 3 = 1 THEN ' 11 ' ELSE '00' END), '') AS term FROM {nation})
  SELECT c_custkey, term FROM {customer} JOIN s ON c_nationkey = n_nationkey WHERE term IS NULL OR contains(c_name, term)""")
q("active_reference", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN concat('RFP-', CAST(o_orderkey AS STRING)) END AS active_reference FROM {orders}")
q("ready_documents", """
  SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'READY' WHEN l.quality = 0 THEN 'FAILED' ELSE 'PENDING' END AS status
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1""")
q("event_exists", "SELECT c.c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey AND e.event_type = 'error')")
q("null_safe_defaults", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), 'Untitled knowledge document') AS title FROM {pages}")
q("type_guarded_payload", """
  SELECT event_id, coalesce(CAST(get_json_object(props, '$.k') AS BIGINT), 0) AS k, coalesce(nullif(get_json_object(props, '$.category'), ''), 'general') AS category FROM {events}""", """
  SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(nullif(json_extract_string(props, '$.category'), ''), 'general') AS category FROM {events}""")
q("file_type_dispatch", """
  SELECT page_id, CASE regexp_extract(lower(url), '[.]([a-z]+)(?:[?#].*)?$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' ELSE 'unsupported' END AS kind FROM {pages}""")
q("object_keys", """
  SELECT doc_id, concat_ws('/', 'knowledge', source, CAST(doc_id AS STRING), 'content.md') AS object_key, CASE WHEN lang = 'en' THEN 'text/markdown' ELSE 'application/octet-stream' END AS mime FROM {documents}""")
q("dto_projection", "SELECT o_orderkey AS id, o_custkey AS customer_id, lower(o_orderstatus) AS status, round(o_totalprice, 2) AS total FROM {orders}")

# Joins
q("results_with_requirements", """
  SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""")
q("proposals_of_active_rfps", """
  SELECT l.l_orderkey, count(*) AS versions FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus <> 'F' GROUP BY l.l_orderkey""")
q("evidence_eager_load", """
  SELECT o.o_orderkey, array_join(array_sort(collect_list(CAST(l.l_linenumber AS INT))), ',') AS line_numbers FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""", """
  SELECT o.o_orderkey, coalesce(string_agg(CAST(l.l_linenumber AS VARCHAR), ',' ORDER BY l.l_linenumber), '') AS line_numbers FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
q("children_to_parents", """
  SELECT c.conv_id, c.turn, coalesce(p.text, c.text) AS text, p.text IS NOT NULL AS expanded FROM {conversations} c
  LEFT JOIN (SELECT conv_id, text FROM {conversations} WHERE turn = 0 AND role = 'user') p ON c.conv_id = p.conv_id""")
q("evidence_of_ready_documents", "SELECT e.vec_id, e.label FROM {embeddings} e LEFT SEMI JOIN (SELECT doc_id FROM {labels} WHERE quality = 1) r ON e.vec_id = r.doc_id", """
  SELECT e.vec_id, e.label FROM {embeddings} e WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.quality = 1 AND l.doc_id = e.vec_id)""")
q("missing_results_only", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
q("delete_guard", """
  SELECT c.c_custkey, CASE WHEN EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus <> 'F') THEN 'CUSTOMER_HAS_RFPS' END AS error_code FROM {customer} c""")
q("duplicate_lookup", """
  WITH h AS (SELECT doc_id, sha2(text, 256) AS h FROM {documents}),
  g AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING count(*) > 1),
  n AS (SELECT h.h, min(g.first) AS first, min(h.doc_id) AS second FROM h JOIN g ON h.h = g.h WHERE h.doc_id > g.first GROUP BY h.h)
  SELECT h.doc_id, CASE WHEN h.doc_id = n.first THEN n.second ELSE n.first END AS duplicate_of FROM h JOIN n ON h.h = n.h""", """
  SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM {documents} a JOIN {documents} b ON sha256(a.text) = sha256(b.text) AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
q("first_review_time", """
  SELECT c.c_custkey, coalesce(m.first_at, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS workflow_started_at FROM {customer} c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_at FROM {orders} GROUP BY o_custkey) m ON c.c_custkey = m.o_custkey""", """
  SELECT c.c_custkey, coalesce(m.first_at, TIMESTAMP '2000-01-01 00:00:00') AS workflow_started_at FROM {customer} c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_at FROM {orders} GROUP BY o_custkey) m ON c.c_custkey = m.o_custkey""")
q("delete_with_subquery", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F')")
q("coverage_check", """
  SELECT coalesce(e.k, a.k) AS requirement, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unknown' WHEN a.n > 1 THEN 'duplicate' ELSE 'ok' END AS finding
  FROM (SELECT DISTINCT p_partkey AS k FROM {part} WHERE contains(p_type, 'A')) e
  FULL OUTER JOIN (SELECT l_partkey AS k, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey) a ON e.k = a.k""")
q("client_dictionary_join", "SELECT o.o_orderkey, coalesce(c.c_name, '—') AS customer FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0")

# Aggregates, windows, top-k, sets
q("next_version", "SELECT c.c_custkey, coalesce(max(o.o_orderkey), 0) + 1 AS next_version FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
q("duplicate_keys", "SELECT l_partkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey HAVING count(*) > 1 ORDER BY l_partkey")
q("change_statistics", """
  SELECT user_id, count_if(event_type = 'view') AS unchanged, count_if(event_type = 'click') AS moved, count_if(event_type = 'signup') AS modified, count_if(event_type = 'purchase') AS added, count_if(event_type = 'error') AS deleted FROM {events} GROUP BY user_id""", """
  SELECT user_id, CAST(count_if(event_type = 'view') AS BIGINT) AS unchanged, CAST(count_if(event_type = 'click') AS BIGINT) AS moved, CAST(count_if(event_type = 'signup') AS BIGINT) AS modified, CAST(count_if(event_type = 'purchase') AS BIGINT) AS added, CAST(count_if(event_type = 'error') AS BIGINT) AS deleted FROM {events} GROUP BY user_id""")
q("document_type_rollup", """
  WITH pages AS (SELECT user_id AS document, CASE event_type WHEN 'view' THEN 'empty' WHEN 'error' THEN 'scanned' ELSE 'text' END AS kind FROM {events})
  SELECT document, CASE WHEN count_if(kind <> 'empty') = count_if(kind = 'text') THEN 'text_based' WHEN count_if(kind <> 'empty') = count_if(kind = 'scanned') THEN 'scanned' ELSE 'mixed' END AS document_type FROM pages GROUP BY document""")
q("health_rollup", "SELECT user_id, bool_and(event_type <> 'error') AS healthy FROM {events} GROUP BY user_id")
q("dashboard_counts", "SELECT count_if(o_orderstatus = 'O') AS active, count_if(o_orderstatus = 'P') AS review, count(*) AS total FROM {orders}", "SELECT CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS active, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS review, count(*) AS total FROM {orders}")
q("text_sizes", "SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS text_size_bytes, CAST(char_length(text) AS BIGINT) AS char_count FROM {documents}", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS text_size_bytes, CAST(length(text) AS BIGINT) AS char_count FROM {documents}")
q("latest_workflow", """
  SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) t WHERE rn = 1""")
q("dense_numbering", """
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_order, concat('REQ-', lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS STRING), 4, '0')) AS requirement_key FROM {conversations}""")
q("parent_anchor_occurrence", """
  SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INT) AS occurrence FROM {conversations}""")
q("parent_grouping", """
  WITH ranked AS (SELECT label AS query_id, vec_id % 2 AS document, nullif(vec_id % 25, 0) AS parent, vec_id AS point, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM {embeddings})
  SELECT query_id, document, parent, point, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS new_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document, parent, CASE WHEN parent IS NULL THEN point END ORDER BY rank) AS k FROM ranked) t WHERE k = 1""")
q("rank_columns", """
  SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank,
    CASE WHEN l_returnflag = 'A' THEN CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) END AS selection_order FROM {lineitem}""")
q("consecutive_pairs", "SELECT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date FROM {orders}")
q("interval_merge", """
  WITH spans AS (SELECT l_orderkey AS k, CAST(l_quantity AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) + l_linenumber AS b, l_linenumber AS n FROM {lineitem}),
  starts AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM spans),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b, n) AS island FROM starts)
  SELECT k, CAST(island AS INT) AS island, min(a) AS low, max(b) AS high FROM islands GROUP BY k, island""")
q("fixed_batches", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 8) AS INT) AS batch FROM {documents}")
q("multi_key_sort_topk", "SELECT event_id, user_id, value FROM {events} ORDER BY value DESC, user_id, event_id LIMIT 50")
q("rerank_order", """
  SELECT l_orderkey, l_linenumber, CAST(rank AS INT) AS rank FROM (
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM {lineitem} WHERE l_linenumber <= 5) t WHERE rank <= 3""")
q("evidence_top3", """
  SELECT l_orderkey, l_linenumber, CAST(rn AS INT) AS rank FROM (
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM (
      SELECT *, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_selected FROM {lineitem}) s
    WHERE any_selected = 0 OR l_returnflag = 'A') t WHERE rn <= 3""")
q("branch_union", "SELECT 'dense' AS branch, vec_id AS point FROM {embeddings} WHERE label < 5 UNION ALL SELECT 'sparse' AS branch, doc_id AS point FROM {documents} WHERE lang = 'fr'")
q("set_differences", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}")
q("set_membership", "SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}")
q("obsolete_points", "SELECT e.vec_id FROM {embeddings} e WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = e.vec_id)")
q("llm_latency_percentiles", """
  SELECT event_type, count(*) AS calls, round(avg(value), 4) AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS slowest FROM {events} GROUP BY event_type""")
q("location_merge", """
  SELECT conv_id, CAST(min(turn) AS BIGINT) AS line_start, CAST(max(turn) AS BIGINT) AS line_end, array_join(array_distinct(transform(array_sort(collect_list(struct(turn, role))), x -> x.role)), '+') AS block_types FROM {conversations} GROUP BY conv_id""", """
  SELECT conv_id, CAST(min(turn) AS BIGINT) AS line_start, CAST(max(turn) AS BIGINT) AS line_end, (SELECT string_agg(role, '+' ORDER BY first_turn) FROM (SELECT role, min(turn) AS first_turn FROM {conversations} i WHERE i.conv_id = o.conv_id GROUP BY role)) AS block_types FROM {conversations} o GROUP BY conv_id""")
q("ordered_text_join", """
  SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '\\n\\n') AS text FROM {conversations} GROUP BY conv_id""", """
  SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM {conversations} GROUP BY conv_id""")

# Workflow views
q("status_progress", """
  WITH s AS (SELECT o_orderkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'parse_document' WHEN '2-HIGH' THEN 'extract_requirements' WHEN '3-MEDIUM' THEN 'evaluate_capabilities' WHEN '4-NOT SPECIFIED' THEN 'generate_proposal' ELSE 'unknown_stage' END AS stage FROM {orders})
  SELECT o_orderkey, stage, CASE WHEN o_orderstatus = 'F' THEN 100 ELSE CASE stage WHEN 'parse_document' THEN 15 WHEN 'extract_requirements' THEN 35 WHEN 'evaluate_capabilities' THEN 60 WHEN 'generate_proposal' THEN 85 ELSE 0 END END AS progress,
    replace(stage, '_', ' ') AS label, o_orderstatus = 'F' AS is_terminal FROM s""")
q("workflow_timing", """
  SELECT user_id, CAST(greatest(0, timestampdiff(MICROSECOND, min(ts), max(ts)) DIV 1000000) AS BIGINT) AS elapsed_seconds FROM {events} GROUP BY user_id""", """
  SELECT user_id, CAST(greatest(0, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) AS BIGINT) AS elapsed_seconds FROM {events} GROUP BY user_id""")
q("capability_report", """
  SELECT o.o_orderkey, o.o_orderpriority, l.l_linenumber AS rank, p.p_name AS title, round(l.l_discount, 6) AS score, l.l_returnflag = 'A' AS is_selected
  FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey WHERE o.o_orderstatus = 'P'""")
q("proposal_context", """
  SELECT l.l_orderkey, l.l_linenumber, coalesce(nullif(p.p_name, ''), 'Untitled') AS title, substring(p.p_type, 1, 12) AS snippet FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE rn <= 3""")
CELL = """CASE l_returnflag WHEN 'A' THEN 'Supported' WHEN 'R' THEN 'Not supported' ELSE 'Needs review' END"""
q("proposal_matrix", f"""
  SELECT l_orderkey, array_join(transform(array_sort(collect_list(struct(l_linenumber, l_returnflag))), x -> concat('| REQ-', lpad(CAST(x.l_linenumber AS STRING), 4, '0'), ' | ', {CELL.replace("l_returnflag", "x.l_returnflag")}, ' |')), '\\n') AS matrix
  FROM {{lineitem}} GROUP BY l_orderkey""", f"""
  SELECT l_orderkey, string_agg('| REQ-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || ' | ' || {CELL} || ' |', chr(10) ORDER BY l_linenumber, l_returnflag) AS matrix
  FROM {{lineitem}} GROUP BY l_orderkey""")
q("retry_routing", """
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'RFP_NOT_FAILED' WHEN o_orderpriority = '5-LOW' THEN 'STAGE_NOT_RETRYABLE' END AS error_code,
    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'rfp.uploaded' WHEN '2-HIGH' THEN 'rfp.completed' WHEN '3-MEDIUM' THEN 'rfp.requirements.extracted' WHEN '4-NOT SPECIFIED' THEN 'rfp.capabilities.evaluated' END END AS topic FROM {orders}""")
q("delete_cascade", """
  SELECT o.o_orderkey, 'ARCHIVED' AS rfp_status, l.l_linenumber, CASE WHEN l.l_linestatus = 'O' THEN 'CANCELLED' ELSE 'KEPT' END AS run_status FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'P'""")
q("json_merge", """
  SELECT event_id, to_json(map_from_entries(array_sort(map_entries(map_concat(map_filter(from_json(props, 'map<string,int>'), (k, v) -> k <> 'done'), map('done', 1)))))) AS summary FROM {events}""", """
  SELECT event_id, '{"done":1,"k":' || json_extract_string(props, '$.k') || '}' AS summary FROM {events}""")
q("backfill_coalesce", """
  SELECT d.doc_id, coalesce(CAST(l.quality AS STRING), sha2(d.text, 256)) AS content_hash, l.doc_id IS NULL AS filled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""", """
  SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), sha256(d.text)) AS content_hash, l.doc_id IS NULL AS filled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""")
q("review_rules", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' AND l_comment_missing THEN 'COMMENT_REQUIRED' END AS error_code FROM (SELECT *, l_linestatus = 'F' AS l_comment_missing FROM {lineitem}) t""")

# Event log, batch twins of the streams
q("outbox_pending", """
  SELECT event_id, user_id, ts FROM {events} WHERE event_type <> 'view' AND ts <= TIMESTAMP_NTZ '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 50""", """
  SELECT event_id, user_id, ts FROM {events} WHERE event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 50""")
q("outbox_backoff", """
  SELECT event_id, CAST(least(300.0D, pow(2.0D, least(30, greatest(0, CAST(event_id % 40 AS INT) - 5)))) AS DOUBLE) AS delay_seconds FROM {events}""", """
  SELECT event_id, CAST(least(300.0, pow(2.0, least(30, greatest(0, CAST(event_id % 40 AS INT) - 5)))) AS DOUBLE) AS delay_seconds FROM {events}""")
q("event_dedup", """
  SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM {events}) t WHERE rn = 1""")
q("bad_records", """
  SELECT event_id, CASE WHEN get_json_object(props, '$.k') IS NULL THEN 'MALFORMED' WHEN CAST(get_json_object(props, '$.k') AS INT) < 10 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict FROM {events}""", """
  SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'MALFORMED' WHEN CAST(json_extract_string(props, '$.k') AS INT) < 10 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict FROM {events}""")
q("stage_state", """
  SELECT user_id, event_type AS stage, CAST(n AS BIGINT) AS events FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) t WHERE rn = 1""")
q("late_event_filter", """
  SELECT e.event_id, e.user_id FROM {events} e JOIN (SELECT user_id, min(ts) AS deleted_at FROM {events} WHERE event_type = 'error' GROUP BY user_id) t ON e.user_id = t.user_id WHERE e.ts < t.deleted_at""")
q("tumbling_counts", "SELECT date_trunc('HOUR', ts) AS window_start, event_type, count(*) AS n FROM {events} GROUP BY date_trunc('HOUR', ts), event_type", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
q("session_counts", """
  WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
  SELECT user_id, CAST(session AS INT) AS session, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, session""")
q("document_point_ids", "SELECT label AS document_id, vec_id % 50 AS chunk_id, max(vec_id) AS point_id FROM {embeddings} GROUP BY label, vec_id % 50")
q("evidence_position_label", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN concat('p. ', CAST(l_partkey AS STRING)) WHEN l_linenumber % 3 = 1 AND l_suppkey > 5 THEN concat('lines ', CAST(l_suppkey AS STRING), '-', CAST(l_suppkey + l_linenumber AS STRING)) WHEN l_linenumber % 3 = 1 THEN concat('line ', CAST(l_suppkey AS STRING)) ELSE concat('paragraph ', CAST(l_linenumber AS STRING)) END AS position FROM {lineitem}""")
q("bounded_diagnostics", """
  SELECT user_id, array_join(slice(array_sort(collect_list(concat(CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE '<unknown_field>' END, ':', lpad(CAST(event_id AS STRING), 8, '0')))), 1, 20), ',') AS diagnostics FROM {events} GROUP BY user_id""", """
  SELECT user_id, string_agg(d, ',' ORDER BY d) AS diagnostics FROM (SELECT user_id, (CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE '<unknown_field>' END) || ':' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS d, row_number() OVER (PARTITION BY user_id ORDER BY (CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type ELSE '<unknown_field>' END) || ':' || lpad(CAST(event_id AS VARCHAR), 8, '0')) AS n FROM {events}) WHERE n <= 20 GROUP BY user_id""")
