"""Streams of workflow events: parsing with a side output, deduplication, stage state, outbox ticks and windows.

Each has a batch twin among the queries; tests run both over the same rows with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

EVENT = "event_id bigint, event_type string, entity_id bigint, occurred_at timestamp, payload string"
STATE = "entity_id bigint, stage string, events bigint"
#: The stages of a request in order, and the one that may come between.
STAGES = tuple(scalar.PROGRESS)
FAILED = "failed"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, **options: str) -> DataFrame:
    """Events as Parquet files arrive in a folder. ``read_kafka`` has the same rows as JSON from topics."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Raw values of topics from their start; needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest")
    return source.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def write_kafka(events: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    rows = events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def parse(raw: DataFrame, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON in column ``value``: bad ones lack an id or aren't JSON."""
    rows = raw.withColumn("event", F.from_json("value", schema))
    good = F.col("event.event_id").isNotNull() & F.col("event.event_type").isNotNull()
    return rows.where(F.coalesce(good, F.lit(False))).select("event.*"), rows.where(~F.coalesce(good, F.lit(False))).select("value")


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event id once, or once for each ``consumer_group`` where there is such a column; ids are remembered for ``delay`` of event time."""
    key = [c for c in ("consumer_group",) if c in events.columns] + ["event_id"]
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(key)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    return events.withWatermark("occurred_at", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = F.session_window("occurred_at", gap)
    return events.withWatermark("occurred_at", delay).groupBy(w.alias("w"), "entity_id").agg(F.count("*").alias("n")).select("entity_id", F.col("w.start").alias("began"), "n")


def _advance(order: Sequence[str] | None):
    place = {x: i for i, x in enumerate(order or ())}

    def allowed(now: str, then: str) -> bool:
        if order is None or then == now == FAILED:
            return order is None
        if then == FAILED:
            return now != order[-1]
        return then in place and (now in ("", FAILED) or place[then] > place[now])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, last_id, stage, n = state.get if state.exists else (-1, -1, "", 0)
        # Guards need a key's events of the micro-batch in order of time; the latest event alone is told frame by frame.
        for frame in frames if order is None else [pd.concat(list(frames))]:
            for row in frame.sort_values(["occurred_at", "event_id"]).itertuples():
                n += 1
                moment = (int(row.occurred_at.value), int(row.event_id))
                if moment > (at, last_id) and allowed(stage, row.event_type):  # late events never bring an older stage back
                    (at, last_id), stage = moment, row.event_type
        state.update((at, last_id, stage, n))
        yield pd.DataFrame([(key[0], stage, n)], columns=["entity_id", "stage", "events"])

    return run


def stage_state(events: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The latest stage of each entity and its events so far, updated as events come.

    With an ``order`` of stages (``STAGES``) an event counts only where it may follow: a later stage than the present one, ``FAILED`` before the last stage,
    or any stage after a failure. Repeated, older, unknown and late ones change nothing, so a failed entity isn't revived by what came before.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("entity_id").applyInPandasWithState(_advance(order), STATE, "at bigint, last_id bigint, stage string, n bigint", "update", GroupStateTimeout.NoTimeout)


def live(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """Events of entities that aren't deleted: ``deleted`` (entity_id) is a static table."""
    return events.join(deleted.select("entity_id"), "entity_id", "left_anti")


def upsert_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is a table version of its own number, so a batch that is run again overwrites itself. ``latest`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key of an ``upsert_sink``."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


def outbox_tick(outbox: DataFrame, now, published: DataFrame, limit: int = 50) -> DataFrame:
    """``outbox`` (id, status, attempts, available_at, created_at) after one tick: due rows that ``published`` (id) lists are done, other due rows wait longer."""
    due = outbox.where((F.col("status") == "PENDING") & (F.col("available_at") <= F.lit(now))).orderBy("available_at", "created_at", "id").limit(limit).select("id", F.lit(True).alias("due"))
    rows = outbox.join(due, "id", "left").join(published.select("id", F.lit(True).alias("sent")), "id", "left")
    failed, sent = F.col("due") & F.col("sent").isNull(), F.col("due") & F.col("sent")
    wait = F.make_dt_interval(secs=scalar.backoff(F.col("attempts")).cast("decimal(18,6)"))
    return rows.select(
        "id",
        F.when(sent, "PUBLISHED").otherwise(F.col("status")).alias("status"),
        F.when(F.coalesce(failed, F.lit(False)), F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(F.coalesce(failed, F.lit(False)), F.lit(now) + wait).otherwise(F.col("available_at")).alias("available_at"),
        "created_at",
    )
