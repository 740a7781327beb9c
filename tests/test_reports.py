"""Reports of requests: small literal cases."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest

from docengine.config import DEFAULTS
from docengine.operators import reports

EVIDENCE = "result_id int, point_id string, rank int, is_selected boolean, selection_order int, title string, filename string, snippet string, score double"


def test_capabilities(spark):
    results = spark.createDataFrame([(1, 10, "SUPPORTED"), (2, 11, "NEED_REVIEW"), (3, 99, "SUPPORTED")], "result_id int, requirement_id int, status string")
    requirements = spark.createDataFrame([(10, "REQ-0001", "x"), (11, "REQ-0002", None)], "requirement_id int, requirement_key string, requirement_text string")
    evidence = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, None)], "result_id int, rank int, point_id string")
    got = {r.result_id: r for r in reports.capabilities(results, requirements, evidence).collect()}
    assert set(got) == {1, 2} and got[2].evidence == [] and got[1].requirement_key == "REQ-0001"
    assert [(e["rank"], e["point_id"]) for e in got[1].evidence] == [(1, None), (1, "a"), (2, "b")]
    assert {len(r.evidence) for r in reports.capabilities(results, requirements, evidence.limit(0)).collect()} == {0}


def test_context_takes_selected_items_or_all(spark):
    rows = [(1, f"p{i}", i, i in (2, 5), {2: 2, 5: 1}.get(i), "" if i == 5 else "T", "f.md", "long snippet", None) for i in range(1, 6)]
    rows += [(2, f"q{i}", i, None if i == 1 else False, 0, None, "g.md", None, 0.5) for i in (4, 3, 2, 1)]
    results = spark.createDataFrame([(1,), (2,), (3,)], "result_id int")
    got = {r.result_id: r.evidence for r in reports.context(results, spark.createDataFrame(rows, EVIDENCE), cfg=replace(DEFAULTS, evidence_chars=4)).collect()}
    assert [(e["point_id"], e["title"], e["snippet"], e["score"]) for e in got[1]] == [("p5", "f.md", "long", None), ("p2", "T", "long", None)]
    assert [(e["point_id"], e["title"], e["snippet"]) for e in got[2]] == [("q1", "g.md", None), ("q2", "g.md", None), ("q3", "g.md", None)] and got[3] == []


def test_proposals(spark):
    names = [c for _, c in reports.SECTIONS]
    drafts = spark.createDataFrame([(1, "T", " sum\n", *[f" {c} " for c in names]), (2, None, None, *[None] * 6)], "rfp_id int, title string, executive_summary string, " + ", ".join(f"{c} string" for c in names))
    responses = spark.createDataFrame([(1, 2, "REQ-0002", "b", "odd", "r", None, "gap"), (1, 1, "REQ-0001", "a|x\n\ny", "SUPPORTED", "yes", "e", "")], "rfp_id int, position int, requirement_key string, requirement string, capability_status string, response string, evidence_summary string, risk_or_gap string")
    got = {r.rfp_id: r.markdown for r in reports.proposals(drafts, responses).collect()}
    lines = ["# T", "", "## 方案摘要", "", "sum", "", "## 需求响应矩阵", "", *reports.HEAD.split("\n"), "| REQ-0001: a\\|x  y | 支持 | yes | e | 未识别出风险或差距 |", "| REQ-0002: b | odd | r |  | gap |", ""]
    for name, c in reports.SECTIONS:
        lines += [f"## {name}", "", c, ""]
    assert got[1] == "\n".join(lines)
    assert got[2].startswith("# \n\n## 方案摘要\n\n\n\n## 需求响应矩阵\n\n| 需求") and got[2].count("\n## ") == 8


@pytest.mark.parametrize("ids", [[1, 2, 9, 1], []])
def test_deletion(spark, ids):
    t, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rfps = spark.createDataFrame([(1, "PROCESSING", "queued", None, None), (2, "ARCHIVED", "deleted", t, t), (3, "PROCESSING", "queued", None, None)], "rfp_id int, status string, current_stage string, deleted_at timestamp, completed_at timestamp")
    runs = spark.createDataFrame([(1, "RUNNING", None), (1, "FAILED", t), (2, "PENDING", None), (3, "PENDING", None), (None, "PENDING", None)], "rfp_id int, status string, completed_at timestamp")
    outbox = spark.createDataFrame([(1, "PENDING", None), (1, "PUBLISHED", None), (3, "PENDING", None), (1, None, "x")], "event_key int, status string, last_error string")
    a, b, c = (sorted(map(tuple, f.collect()), key=repr) for f in reports.deletion(rfps, runs, outbox, spark.createDataFrame([(i,) for i in ids], "rfp_id int"), now))
    hit = bool(ids)
    assert (1, "ARCHIVED", "deleted", now, now) in a if hit else a == sorted(map(tuple, rfps.collect()), key=repr)
    assert (2, "ARCHIVED", "deleted", t, t) in a and (3, "PROCESSING", "queued", None, None) in a
    assert b == sorted([(1, "CANCELLED" if hit else "RUNNING", now if hit else None), (1, "FAILED", t), (2, "PENDING", None), (3, "PENDING", None), (None, "PENDING", None)], key=repr)
    assert c == sorted([(1, "FAILED" if hit else "PENDING", "RFP_DELETED" if hit else None), (1, "PUBLISHED", None), (3, "PENDING", None), (1, None, "x")], key=repr)


def test_locations(spark):
    rows = [(1, 2, 3, 4, ["b", "c"], [[1.0]]), (1, 1, 5, 6, ["b", "a"], [[2.0], [3.0]])]
    got = reports.locations(spark.createDataFrame(rows, "group_id int, position int, start int, end int, block_ids array<string>, bboxes array<array<double>>")).first()
    assert (got.start, got.end, got.block_ids, got.bboxes) == (3, 6, ["b", "a", "c"], [[2.0], [3.0], [1.0]])
