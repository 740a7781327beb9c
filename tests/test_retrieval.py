"""The lexical branch: tokens of odd texts against SQL, scores in parts, and what leaves a task."""

from __future__ import annotations

import math
import os
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from docengine import catalog
from docengine.functions import text
from docengine.operators import retrieval

catalog.load()
TEXTS = ["", " ", "a b a", "ﬁne ２x ½ m²", "İstanbul 5K 300Å", "-a --b /c c/d- # + x.y_z", "検索 query V１．２", "…", "É", "ABC abc\x00abc\tß", "...", "ΑΣ Σ"]


@pytest.fixture
def odd(tmp_path, spark):
    """The smallest tables with a few odd texts besides."""
    for t in oracle.TABLES:
        if t != "documents":
            os.symlink(f"{oracle.SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text")
    some = docs.where("doc_id < 40").withColumn("text", F.concat(F.lit("ﬁ検索 "), "text", F.lit(" İ")))
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    docs.where("doc_id >= 40").unionByName(some).unionByName(more).coalesce(1).write.parquet(str(tmp_path / "documents"))
    part = next(p for p in os.listdir(tmp_path / "documents") if p.endswith(".parquet"))
    os.rename(tmp_path / "documents" / part, tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["lexical_tokens", "bm25_topk", "rerank_lexical"])
def test_odd_texts_have_the_tokens_of_sql(spark, odd, name):
    assert oracle.compare(spark, oracle.connection(odd), catalog.QUERIES[name], catalog.ORACLES[name], odd) is None


def test_tallies_equal_columns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.latin_terms("t").alias("latin"), text.lexical_tokens(F.col("t")).alias("every")).collect()
    for r in rows:
        assert {w.decode(): n for w, n in text.latin_tally(r.t.encode()).items()} == Counter(r.latin), r.t
        assert {w.decode(): n for w, n in text.lexical_tally(r.t.encode()).items()} == Counter(r.every), r.t


def test_scores_in_parts(spark, monkeypatch):
    words = [[f"w{(i * j) % 17}" for j in range(1 + i % 7)] for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(98, None), (99, " ")], "doc_id long, text string").repartition(3)
    asked = {5: "w1 w2 w1", 3: "w0", 8: "w16 w4 w3 w5", 9: "nowhere"}
    queries = spark.createDataFrame([*asked.items(), (10, None)], "query_id long, text string")
    payload = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, "ACTIVE").alias("status"))
    mean, want = sum(map(len, words)) / 60, []
    for q, t in asked.items():
        scores = []
        for i, w in enumerate(words):
            df = {x: sum(x in v for v in words) for x in set(t.split())}
            s = sum(math.log(1 + (60 - df[x] + 0.5) / (df[x] + 0.5)) * (w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))) for x in df if x in w)
            if s and i % 5:
                scores.append((-round(s, 6), i))
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scores)[:4])]
    for limits in ({}, {"QUERY_BYTES": 30, "MOST_ADDENDS": 3}):
        for name, n in limits.items():
            monkeypatch.setattr(retrieval, name, n)
        got = retrieval.bm25(queries, docs, 4, payload=payload).select("query_id", "doc_id", "score", "rank").collect()
        assert sorted((q, d, round(s, 6), k) for q, d, s, k in got) == sorted(want)


def test_no_row_for_each_token_and_query(spark):
    """A task gives its best rows of each query; texts aren't exploded into rows that are joined with the queries."""
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    found = retrieval.bm25(spark.createDataFrame([(1, "a b")], "query_id long, text string"), docs, 4)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString() and [r.doc_id for r in found.orderBy("rank").collect()] == [0, 1, 2, 3]
