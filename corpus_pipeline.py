"""The corpus pipeline: language ID, near-duplicate removal, surrogates for personal data, mixing and packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; ``run`` writes each
stage's result as Parquet in the shared folder and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import langid, mixing, packing, pii, simhash
from docengine.llm._common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the predicted one. Null texts and texts without a letter (``und``) are rejected, and no others.

    Where no row has a label there is nothing to learn: documents with letters stay, with a null ``lang``. Texts of any length are read whole; repeated rows are
    judged alike; an empty table stays empty; columns beyond those of documents go.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    told = langid.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: 5-word shingles, Jaccard similarity of 0.8 or more, candidates by SimHash tables.

    Null and empty texts are copies of each other; of rows that repeat a doc_id in a group one stays; rows with a null doc_id stay where
    their group has no other; an empty table stays empty; columns beyond those of documents go.
    """
    return simhash.keep_one(docs.select(*COLUMNS), **simhash.SIMILAR)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data under the session's key; ``n_chars`` follows.

    Null texts stay null, texts without entities as they are, whatever their length; repeated rows get the same text; an empty table stays empty; columns
    beyond those of documents go.
    """
    changed = pii.replace(docs.select(*COLUMNS), pii.session_key(spark))
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix: each once for each of two rounds that takes half of it or more.

    Documents without words, so null and empty texts, go; null is a source of its own; repeated rows are documents of their own, in an order fixed by doc_id
    and size; an empty table stays empty; columns beyond those of documents go.
    """
    return mixing.repeat(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; copies of a document are packed each by itself.

    Null and empty texts hold the end id alone; long documents are cut at window ends; an empty table gives no pieces; further columns are ignored.
    """
    # Workers have more to hold after four other stages: caches of fewer pieces, shorter slices.
    rows = packing.pack(docs, TOKENIZER, end_id=2, cache_entries=150_000, slice_bytes=4 << 20)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("PII surrogates", surrogates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Training, hashing with 64-bit votes and tokenizers have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
