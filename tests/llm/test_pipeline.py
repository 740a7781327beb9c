"""The pipeline's stages, one after another, against plain versions of what each must do."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "src0", 0), (10_003, "12 34 !!", "en", "src0", 8), (10_004, "mail a.b@mail1.example.com and the of by", None, None, 40)], docs.schema)
    return docs.unionByName(odd)


@pytest.fixture(scope="module")
def stages(spark, source, tmp_path_factory):
    out, docs = [], source
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(source, stages):
    assert all(sorted(s.columns) == sorted(source.columns) for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII surrogates", "mixing", "packing"]


def test_language_stage_rejects_texts_without_letters(source, stages):
    want = {r.doc_id for r in source.collect() if r.text is not None and any(map(str.isalpha, r.text))}
    got = rows(stages[0])
    assert set(got) == want
    before = rows(source)
    right = [got[i].lang == before[i].lang for i in want if before[i].lang]
    assert sum(right) / len(right) > 0.95


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, kept = rows(stages[0]), set(rows(stages[1]))
    shingles = {i: set(zip(*[r.text.lower().split()[k:] for k in range(5)])) or {r.text} for i, r in before.items()}
    texts: dict = {}
    for i in sorted(before):
        texts.setdefault(before[i].text, []).append(i)
    assert all(len(kept & set(ids)) <= 1 for ids in texts.values())
    alike = {i: 0.0 for i in before}
    pairs = missed = 0
    ids = sorted(before)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(shingles[a] & shingles[b])
            if both:
                j = both / len(shingles[a] | shingles[b])
                alike[a], alike[b] = max(alike[a], j), max(alike[b], j)
                if j >= 0.85:
                    pairs += 1
                    missed += a in kept and b in kept
    assert pairs and missed <= 0.05 * pairs
    assert all(i in kept for i in ids if alike[i] < 0.5)


def test_surrogate_stage_changes_private_data_alone(stages):
    import re

    before, after = rows(stages[1]), rows(stages[2])
    assert set(before) == set(after)
    private = re.compile(r"@|\+1 \(\d{3}\)|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|token", re.I)
    for i, r in after.items():
        if private.search(before[i].text):
            for found in re.findall(r"[\w.]+@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)|555-\d{4}", before[i].text):
                assert found not in r.text
        else:
            assert r.text == before[i].text
        assert r.n_chars == len(r.text)


def test_mixture_repeats_whole_documents(stages):
    before, after = rows(stages[2]), [r.doc_id for r in stages[3].collect()]
    assert set(after) <= set(before) and max(map(after.count, set(after))) <= 2
    size = {i: len(r.text.encode().split()) for i, r in before.items()}
    total = sum(size.values())
    assert abs(sum(size[i] for i in after) - 1.5 * total) < 0.05 * total


def test_packing_stage_holds_every_copy(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    copies = {d: n for d, n in stages[3].groupBy("doc_id").count().collect()}
    encode = brute.ids_of("word_bpe_49k.json")
    pieces = stages[4].collect()
    total = {d: 0 for d in texts}
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
        total[p.doc_id] += p.length
    for d, t in texts.items():
        assert total[d] == copies[d] * (len(encode(t)) + 1)
    assert all(n <= 4096 for n in fill.values()) and sorted(fill) == list(range(len(fill)))


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("length") > 0).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
