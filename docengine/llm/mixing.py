"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources' documents lie in a keyed shuffled order, which is repeated and cut into blocks of equally many words. Slot i of the
schedule takes the point frac(i * golden ratio); the cumulative targets tell its source; slots are ranked within each source, and
the r-th slot takes the source's r-th block. So what a source gives, and when, follows from the points alone, and each prefix of the mix is
near its target weights. Points are integers modulo 2^31, so that they are exact and spread evenly over any number of slots.
Counts, ranks and running sums are made within ranges of bounded size, so that a source of any size is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast, need, release, small_enough

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 32
RANGE_ROWS = 1 << 14
SLOT_RANGE = 1 << 16
CELLS = 4096
#: Bytes of slots that are told to all tasks at most; one more row each makes the rows move instead, so the driver holds no table that grows with the rows.
TOLD_BYTES = 1 << 18
#: The same for tables of sources.
SOURCE_BYTES = 8 << 20
#: Points are multiples of 1 / CIRCLE; GOLDEN is the odd integer next to CIRCLE times the golden ratio.
CIRCLE, GOLDEN = 1 << 31, 1327217885


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``SHARE`` of all words dealt by weight, none above ``MOST_REPEATS`` times its size.

    Sources have one row each and take the weights in code-point order, null last. The water level is found in closed form:
    in order of cap over weight, sources below the level take their cap, the others the level times their weight.
    This is a dimension table: one row per source, so its windows run in one task.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((n - 1) % len(WEIGHTS) + 1).cast("int"))
    base = sizes.withColumn("n", n).withColumn("weight", weight).withColumn("cap", (MOST_REPEATS * F.col("source_size")).cast("double"))
    ratio = (F.col("cap") / F.col("weight")).asc()
    before = Window.orderBy(ratio, "n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(ratio, "n").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level is right at the first source whose cap it doesn't exceed.
    found = base.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("n"), F.col("level")))).over(every)
    capped = found.withColumn("first", first)
    return capped.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("cap"))).alias("target"))


def hash_ranges(rows: int) -> int:
    """A power of two of ranges, about ``RANGE_ROWS`` rows each."""
    return 1 << max(0, (rows // RANGE_ROWS).bit_length())


def ordered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, source, size, and others) with ``begin``: words before the document in its source's shuffled order, by MD5 of key, id and size."""
    digest = F.md5(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))
    ranges = hash_ranges(docs.count())
    base = docs.withColumn("digest", digest).withColumn("range", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long"))
    sums = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("g"), (F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = base.withColumn("inside", inside)
    joined = placed.join(sums, placed["source"].eqNullSafe(sums["s"]) & (placed["range"] == sums["g"]))
    return joined.select(*docs.columns, (F.col("base") + F.col("inside")).alias("begin"))


def schedule(spark: SparkSession, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: slot, n (the source's number), rank (from 0 in the source), for ``plan`` (n, target).

    There are as many slots as blocks of the summed targets, rounded; without any, the schedule is empty.
    """
    total = plan.agg(F.sum("target").alias("x")).first()["x"] or 0.0
    every = Window.partitionBy()
    upto = F.try_divide(F.sum("target").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), F.sum("target").over(every)) * CIRCLE
    spans = plan.where("target > 0").withColumn("high", upto).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("n")), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.desc("n"))) == 1
    spans = spans.withColumn("high", F.when(last, F.lit(2.0 * CIRCLE)).otherwise(F.col("high")))
    cell = CIRCLE // CELLS
    cells = spans.select("n", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.least(F.col("high"), F.lit(CIRCLE - 1.0)) / cell))).alias("cell"))
    points = spark.range(int(total / block_words + 0.5)).withColumn("point", F.col("id") % CIRCLE * GOLDEN % CIRCLE)
    points = points.withColumn("cell", F.floor(F.col("point") / cell))
    slots = points.join(checked_broadcast(cells, 64, SOURCE_BYTES), "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    slots = slots.select(F.col("id").alias("slot"), "n", F.floor(F.col("id") / SLOT_RANGE).alias("range"))
    counts = slots.groupBy("n", "range").agg(F.count("*").alias("k"))
    bases = counts.select(F.col("n").alias("m"), F.col("range").alias("g"), (F.sum("k").over(Window.partitionBy("n").orderBy("range")) - F.col("k")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("n", "range").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(bases, (F.col("n") == F.col("m")) & (F.col("range") == F.col("g")))
    return ranked.select("slot", "n", (F.col("base") + F.col("inside")).alias("rank"))


def rounds(docs: DataFrame, scratch: Scratch, key: str, block_words: int, *carried: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``docs`` (doc_id, text, source): their places (doc_id, size, n, begin, and the columns ``carried``), what each round takes of them (n, begin, round, taken, slot), and the sources (source, source_size, n, target).

    ``slot`` is the first that takes words of the document in the round. (n, begin) tells documents with words apart.
    """
    spark = docs.sparkSession
    sized = need(docs, "doc_id", "text", "source", *carried).select("doc_id", "source", words(F.col("text")).alias("size"), *carried)
    sized = scratch.table(sized, "sized")
    plan = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "plan")
    slots = scratch.table(schedule(spark, plan.select("n", "target"), block_words), "slots")
    places = ordered(sized, key)
    facts = plan.select(F.col("source").alias("s"), "n", "source_size")
    longest = plan.agg(F.coalesce(F.max(F.octet_length("source")), F.lit(0)).alias("x")).first()["x"]
    places = places.join(checked_broadcast(facts, 64 + longest, SOURCE_BYTES), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "n", "begin", "source_size", *carried)
    places = scratch.table(places, "places")
    # The source's order, repeated: a document lies there once for each round.
    turns = places.where("size > 0").select("n", "begin", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda r: F.struct(r.alias("round"), (F.col("begin") + r * F.col("source_size")).alias("at")))).alias("t"))
    turns = turns.select("n", "begin", "size", "t.round", "t.at")
    # The source's slots have the ranks from 0 to their number less 1, so the mix takes a turn's words up to the end of the last block,
    # and the slot of its first block is its first slot.
    turns = turns.withColumn("block", F.floor(F.col("at") / block_words))
    ends = slots.groupBy(F.col("n").alias("en")).agg((F.count("*") * block_words).alias("end"))
    hits = turns.join(slots.withColumnRenamed("n", "of"), (F.col("n") == F.col("of")) & (F.col("block") == F.col("rank"))).join(checked_broadcast(ends, 32, SOURCE_BYTES), F.col("n") == F.col("en"))
    taken = hits.select("n", "begin", "round", (F.least(F.col("at") + F.col("size"), F.col("end")) - F.col("at")).alias("taken"), "slot")
    return places, taken, plan


def mix(docs: DataFrame, key: str = "mix", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target (its source's), taken (words that the mix takes, repeats counted), first_slot (null if not taken).

    A source's taken words differ from its target by as many blocks as the points are off, a few, whatever their number. No document is
    taken more than ``MOST_REPEATS`` times: later slots of a source that has given all are empty. Null text has no words and is never taken; null is a
    source of its own; repeated rows are documents of their own; an empty table gives no rows; the key fixes the order, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    places, taken, plan = rounds(docs, scratch, key, block_words)
    sums = taken.groupBy(F.col("n").alias("tn"), F.col("begin").alias("tb")).agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    # Documents without words lie at another's beginning; they aren't taken.
    rows = places.join(sums, (F.col("n") == F.col("tn")) & (F.col("begin") == F.col("tb")) & (F.col("size") > 0), "left").drop("source_size")
    facts = plan.select("source", F.col("n").alias("m"), "source_size", "target")
    longest = plan.agg(F.coalesce(F.max(F.octet_length("source")), F.lit(0)).alias("x")).first()["x"]
    rows = rows.join(checked_broadcast(facts, 64 + longest, SOURCE_BYTES), F.col("n") == F.col("m"))
    return rows.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def repeat(docs: DataFrame, key: str = "mix", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` in the order of the mix, each row once for each round that takes half of its words or more. All columns stay; rows without words go.

    Partitions are ranges of the schedule, ordered within, so reading them one after another gives the mix.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    own = docs.columns
    rows = scratch.table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_id")), "rows")
    places, taken, _ = rounds(rows.select("row.doc_id", "row.text", "row.source", "row_id"), scratch, key, block_words, "row_id")
    where = places.where("size > 0").select(F.col("row_id").alias("r"), "size", F.col("n").alias("pn"), F.col("begin").alias("pb"))
    copies = taken.join(where, (F.col("n") == F.col("pn")) & (F.col("begin") == F.col("pb"))).where(2 * F.col("taken") >= F.col("size"))
    copies = scratch.table(copies.groupBy("r").agg(F.collect_list("slot").alias("slots")), "copies")
    release(docs.sparkSession)
    scratch.keep_only("rows", "copies")
    # Where the slots are few enough to be told to all tasks, rows move once, into ranges of slots. Else they move to their slots before, and are
    # written between, so that the files of one move go before the next.
    small = small_enough(copies, 40, TOLD_BYTES)
    both = rows.join(F.broadcast(copies) if small else copies, F.col("row_id") == F.col("r")).select("row", "row_id", F.explode("slots").alias("slot"))
    if not small:
        both = scratch.table(both, "both")
        release(docs.sparkSession)
        scratch.keep_only("both")
    placed = both.repartitionByRange("slot", "row_id").sortWithinPartitions("slot", "row_id")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in own])
