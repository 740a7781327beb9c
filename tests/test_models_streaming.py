from __future__ import annotations

import datetime as dt

from oracle import SF
from pyspark.sql import functions as F

from docengine.operators import models
from docengine.streaming import events as ev


def test_judge_recovers_from_refused_batches(spark):
    def model(items):  # answers batches of up to two, else leaves one out
        return models.rule_judge(items if len(items) <= 2 else items[1:])

    items = [{"requirement_key": f"R{i}", "score": i / 4} for i in range(5)]
    got = models.judge_batch(items, model)
    assert [g["requirement_key"] for g in got] == [f"R{i}" for i in range(5)] and got[4]["status"] == "SUPPORTED"
    assert models.judge_batch(items[:1], lambda x: [])[0]["status"] == "ERROR"
    rows = models.judge(spark.createDataFrame([("A", 0.9), ("B", None)], "requirement_key string, score double")).collect()
    assert {r.requirement_key: r.status for r in rows} == {"A": "SUPPORTED", "B": "NEED_REVIEW"}


def test_embeddings_and_citations(spark):
    rows = models.embed(spark.createDataFrame([("a", "x y"), ("b", "x y")], "chunk_id string, embedding_text string")).collect()
    assert rows[0].vector == rows[1].vector
    cases = [("a", "SUPPORTED", ["p"], [], "NOTHING_SELECTED"), ("b", "NEED_REVIEW", ["p"], [], None), ("c", "SUPPORTED", ["p"], ["q"], "UNKNOWN_SELECTED"), ("d", "SUPPORTED", ["p"], ["p", "p"], "DUPLICATE_SELECTED"), ("e", "SUPPORTED", ["p", "p"], ["p"], "DUPLICATE_AVAILABLE")]
    rows = spark.createDataFrame(cases, "requirement_key string, status string, available array<string>, selected array<string>, want string")
    assert all(r.error_code == r.want for r in models.citations(rows).collect())


def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("props").alias("payload"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, ev.read_events(spark, str(tmp_path / "in"))


def run(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_stream_equals_batch(spark, tmp_path):
    rows, source = stream(spark, tmp_path)
    got = run(ev.window_counts(source), tmp_path, "complete", "tumbling").collect()
    want = rows.groupBy(F.date_trunc("hour", "occurred_at").alias("window_start"), "event_type").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stage_state_equals_batch(spark, tmp_path):
    rows, source = stream(spark, tmp_path)
    got = {r.entity_id: (r.stage, r.events) for r in run(ev.stage_state(source), tmp_path, "update", "stages").collect()}
    want = {r.entity_id: (r.stage, r.n) for r in rows.groupBy("entity_id").agg(F.max_by("event_type", F.struct("occurred_at", "event_id")).alias("stage"), F.count("*").alias("n")).collect()}
    assert got == want


def test_stages_follow_their_order(spark, tmp_path):
    names = ["parse_document", "queued", "document_parsed", "nonsense", "failed", "failed", "extract_requirements"]
    rows = [(i, x, 1, dt.datetime(2024, 1, 1, 0, i), "") for i, x in enumerate(names)]
    rows += [(10, "approved", 2, dt.datetime(2024, 1, 1), ""), (11, "failed", 2, dt.datetime(2024, 1, 2), ""), (12, "parse_document", 2, dt.datetime(2024, 1, 3), "")]
    rows += [(20, "failed", 3, dt.datetime(2024, 1, 2), ""), (21, "queued", 3, dt.datetime(2024, 1, 1), "")]
    spark.createDataFrame(rows, ev.EVENT).write.parquet(str(tmp_path / "in"))
    got = run(ev.stage_state(ev.read_events(spark, str(tmp_path / "in")), ev.STAGES), tmp_path, "update", "guarded")
    assert {r.entity_id: (r.stage, r.events) for r in got.collect()} == {1: ("extract_requirements", 7), 2: ("approved", 3), 3: ("failed", 2)}


def test_deduplication_by_consumer_group(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "x", 1, t, "", g) for g in ("a", "a", "b")]
    spark.createDataFrame(rows, f"{ev.EVENT}, consumer_group string").write.parquet(str(tmp_path / "in"))
    source = ev.read_events(spark, str(tmp_path / "in"), f"{ev.EVENT}, consumer_group string")
    assert run(ev.once(source), tmp_path, "append", "groups").count() == 2


def test_deduplication_and_bad_records(spark, tmp_path):
    rows, source = stream(spark, tmp_path)
    assert run(ev.once(source.union(ev.read_events(spark, str(tmp_path / "in"))), "60 days"), tmp_path, "append", "once").count() == rows.count()
    raw = spark.createDataFrame([('{"event_id": 1, "event_type": "x"}',), ("nonsense",), ('{"event_type": "x"}',)], "value string")
    good, bad = ev.parse(raw)
    assert good.count() == 1 and bad.count() == 2


def test_upsert_sink_is_idempotent(spark, tmp_path):
    sink = ev.upsert_sink(str(tmp_path / "out"), "k")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert {r.k: r.v for r in ev.latest(spark, str(tmp_path / "out"), "k").collect()} == {1: "a", 2: "c"}


def test_outbox_tick(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "PENDING", 0, t, t), (2, "PENDING", 2, t, t), (3, "PENDING", 0, t + dt.timedelta(days=1), t)]
    outbox = spark.createDataFrame(rows, "id long, status string, attempts int, available_at timestamp, created_at timestamp")
    got = {r.id: r for r in ev.outbox_tick(outbox, t, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got[1].status == "PUBLISHED" and got[2].attempts == 3 and got[2].available_at == t + dt.timedelta(seconds=4) and got[3].attempts == 0
