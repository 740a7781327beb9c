from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.operators import incremental as inc


def chunk(i, position, s="s", e="e"):
    return {"chunk_id": i, "position": position, "structural_hash": s, "embedding_hash": e}


def kinds(old, new):
    return [(d[0], d[2], d[3]) for d in inc.match(old, new)]


def test_rules_in_order():
    assert kinds([chunk("a", 0)], [chunk("a", 0)]) == [("a", "UNCHANGED", "a")]
    assert kinds([chunk("a", 0)], [chunk("b", 3)]) == [("b", "MOVED", "a")]
    assert kinds([chunk("a", 0, e="x")], [chunk("a", 0, s="t")]) == [("a", "MODIFIED", "a")]
    assert kinds([chunk("a", 0, e="x")], [chunk("b", 0)]) == [("b", "MODIFIED", "a")]
    assert kinds([chunk("a", 0, "s1", "x")], [chunk("b", 0)]) == [("b", "ADDED", None), (None, "DELETED", "a")]


def test_nearest_position_wins_and_each_matches_once():
    old = [chunk("a", 2, "s1"), chunk("b", 9, "s2")]
    assert kinds(old, [chunk("n", 8, "s3")]) == [("n", "MOVED", "b"), (None, "DELETED", "a")]


rows = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("st"), st.sampled_from("efgh")), max_size=8)


@settings(max_examples=80, deadline=None)
@given(rows, rows)
def test_every_chunk_is_decided_once(a, b):
    old = [chunk(f"{i}{k}", k, s, e) for k, (i, s, e) in enumerate(a)]
    new = [chunk(f"{i}{k}", k, s, e) for k, (i, s, e) in enumerate(b)]
    got = inc.match(old, new)
    assert sorted(d[0] for d in got if d[0]) == sorted(r["chunk_id"] for r in new)
    assert sorted(d[3] for d in got if d[3]) == sorted(r["chunk_id"] for r in old)
    assert all(d[2] == "UNCHANGED" for d in inc.match(old, old))


def test_apply_reuses_vectors_and_drops_obsolete(spark):
    index = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "chunk_id string, vector array<double>")
    decisions = spark.createDataFrame([(1, "a", 0, "UNCHANGED", "a", 0), (1, "n", 1, "MOVED", "b", 1), (1, "m", 2, "ADDED", None, None), (1, None, None, "DELETED", "c", 2)], inc.DECISIONS)
    fresh = spark.createDataFrame([("m", [9.0])], "chunk_id string, vector array<double>")
    assert {r.chunk_id: r.vector for r in inc.apply(index, decisions, fresh).collect()} == {"a": [1.0], "n": [2.0], "m": [9.0]}
    assert inc.statistics(decisions).first().asDict() == {"doc_id": 1, "unchanged": 1, "moved": 1, "modified": 0, "added": 1, "deleted": 1, "embedded": 1}
