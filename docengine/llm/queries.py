"""The queries of the ten operators and of the pipeline, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, merkle, mixing, packing, pii, simhash, substring, token_store, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = token_store.token_store(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, read(spark, sf_dir, "pages"))
    other = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", other.cast("long")).alias("refers_to"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_entities")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, ~F.coalesce(held_out(), F.lit(True)))
    rows = langid.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(read(spark, sf_dir, "documents")).withColumn("edited_paragraphs", F.size("edited_paragraphs"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_langid": op5_langid,
    "op6_merkle": op6_merkle,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_ann": op9_ann,
    "op10_substring": op10_substring,
    "pipeline": pipeline,
}

#: Words without Unicode rules: space and U+0009 to U+000D part them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM l""",
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1]::DOUBLE AS weight, row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) AS n FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM w),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT level FROM v WHERE level * weight <= cap ORDER BY cap / weight, n LIMIT 1),
t AS (SELECT source, n, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM v),
h AS (SELECT n, target, CASE WHEN n = max(n) OVER () THEN 4294967296.0 ELSE sum(target) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 2147483648.0 END::DOUBLE AS high FROM t WHERE target > 0),
u AS (SELECT n, coalesce(lag(high) OVER (ORDER BY n), 0) AS low, high FROM h),
p AS (SELECT i, (i % 2147483648 * 1327217885 % 2147483648)::DOUBLE AS point FROM range(0, (SELECT floor(coalesce(sum(target), 0) / 32 + 0.5)::BIGINT FROM t)) r(i)),
q AS (SELECT i, n, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS rank FROM p JOIN u ON point >= low AND point < high),
k AS (SELECT n, count(*) * 32 AS words FROM q GROUP BY n),
o AS (SELECT doc_id, size, source, sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS b FROM d),
e AS (SELECT o.*, t.n, t.source_size, t.target, coalesce(k.words, 0) AS words FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.n = t.n)
SELECT e.doc_id, e.size, e.source_size, e.target, (greatest(0, least(b + size, words) - b) + greatest(0, least(b + size + source_size, words) - b - source_size))::BIGINT AS taken, q.i AS first_slot
FROM e LEFT JOIN q ON q.n = e.n AND q.rank = b // 32 AND e.size > 0""",
    "op10_substring": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM g),
m AS (SELECT r, i, count(*) OVER (PARTITION BY h) > 1 AS again FROM k),
y AS (SELECT x.r, x.i, x.word, max(CASE WHEN m.again THEN 1 ELSE 0 END) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM x LEFT JOIN m ON x.r = m.r AND x.i = m.i),
z AS (SELECT r, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM y GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON d.r = z.r""",
}
