from __future__ import annotations

import hashlib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docengine.functions import scalar, text
from docengine.operators import geometry

TEXTS = ["", "a", "  Straße  X\t\n", "ſ ﬁ ΑΣ", "a\r\n\r\n\r\nb  \nc", "検索 query v1.2", "ＡＢＣ", "x�\x07y"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def values(frame, column):
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def clean(t: str) -> str:
    lines = [x.rstrip() for x in unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    kept = [x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1]]
    return "\n".join(kept).strip()


def test_python_rules(frame):
    assert values(frame, text.squeeze(F.col("t"))) == [" ".join(t.split()) for t in TEXTS]
    assert values(frame, text.casefold(F.col("t"))) == [t.casefold() for t in TEXTS]
    assert values(frame, text.strip(F.col("t"))) == [t.strip() for t in TEXTS]
    assert values(frame, text.document_hash(F.col("t"))) == [hashlib.sha256(clean(t).encode()).hexdigest() for t in TEXTS]
    assert values(frame, text.uuid5(F.col("t"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in TEXTS]
    assert values(frame, text.token_id(F.col("t"))) == [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") for t in TEXTS]


def test_tokens_of_latin_and_cjk(frame):
    got = values(frame, text.lexical_tokens(F.col("t")))
    assert got[0] == [] and got[5] == ["query", "v1.2", "検", "索", "検索"]


def test_estimates_and_garbled(frame, spark):
    four = spark.createDataFrame([("",), ("a",), ("abcd",), ("abcde",)], "t string").select(text.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in four] == [1, 1, 1, 2]
    assert values(frame, text.garbled_count(F.col("t")))[7] == 2


def test_backoff(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (9,)], "n int").select(scalar.backoff(F.col("n"))).collect()
    assert [r[0] for r in rows] == [1.0, 2.0, 4.0, 300.0]


def test_item_ids_and_cells(spark):
    rows = spark.createDataFrame([("B-001 x",), ("B-1 x",), ("x B-001",)], "t string").select(text.item_id(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["B-001", None, None]
    assert spark.createDataFrame([(" a|b\nc ",)], "t string").select(text.markdown_cell(F.col("t"))).first()[0] == "a\\|b c"
    case = " a|b\r\nc\n\nd\u2028e\x1cf\x0bg "
    want = " ".join(case.strip().replace("|", "\\|").splitlines())
    assert spark.createDataFrame([(case,)], "t string").select(text.markdown_cell(F.col("t"))).first()[0] == want


def test_page_classes(spark):
    cases = [(0, 0.0, 0.6, False, "scanned"), (0, 0.0, 0.0, False, "empty"), (30, 0.11, 0.0, False, "scanned"), (10, 0.0, 0.0, True, "scanned"), (10, 0.0, 0.0, False, "text"), (30, 0.0, 0.35, False, "mixed"), (30, 0.0, 0.0, False, "text"), (0, 0.0, 0.0, True, "scanned")]
    rows = spark.createDataFrame(cases, "c int, g double, i double, s boolean, want string")
    assert [r[0] for r in rows.select(scalar.page_class(F.col("c"), F.col("g"), F.col("i"), F.col("s")) == F.col("want")).collect()] == [True] * len(cases)


def test_union_area(spark):
    r = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, 10.0, 10.0), (1, 1.0, 1.0, 3.0, 3.0, 10.0, 10.0)], "page_id long, x0 double, y0 double, x1 double, y1 double, width double, height double")
    assert geometry.union_area(r).first().coverage == 0.07


def test_document_types(spark):
    rows = [(1, "empty"), (2, "text"), (2, "empty"), (3, "scanned"), (4, "text"), (4, "scanned")]
    got = geometry.document_type(spark.createDataFrame(rows, "doc_id long, page_type string")).collect()
    assert {r.doc_id: r.document_type for r in got} == {1: "text_based", 2: "text_based", 3: "scanned", 4: "mixed"}


def test_progress(spark):
    rows = spark.createDataFrame([("unknown_stage", "PROCESSING"), ("queued", "APPROVED"), ("human_review", "REVIEW_PENDING")], "stage string, status string")
    assert [r[0] for r in rows.select(scalar.progress(F.col("stage"), F.col("status"))).collect()] == [0, 100, 95]
