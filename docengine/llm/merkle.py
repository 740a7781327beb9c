"""Document fingerprints: Merkle trees over sections, paragraphs and segments, in SQL functions only.

The whole text is cut without loss: sections end with blank lines, paragraphs with line ends, and leaves are
segments of a paragraph that end with a sentence or after 4 words. A leaf's hash is the SHA-256 of "leaf:" and its text, the hash of a
paragraph, a section and the root that of "node:" and its children's hashes; the fingerprint is the root in hex. So equal
texts, and only these, have equal fingerprints, and where roots differ, differing branches locate the edits.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast, need

#: Fixed values of the format: they cover any text, each match is one node.
SECTION = r"(?s).+?(?:\n[ \t\r]*(?=\n)(?:\s*\n)?|\z)"
PARAGRAPH = r"[^\n]*\n|[^\n]+\z"
LEAF = r"(?:\S++(?<![.!?])[^\S\n]++){0,3}\S++\s*+|\s++"

BUCKET_ROWS = 4000


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, even where ``use`` names it often or in a lambda."""
    return F.transform(F.array(value), use)[0]


def _node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """struct<root: string, sections: array<struct<hash, paragraphs: array<struct<hash, leaves: array<bigint>>>>>>.

    Hashes are hex; ``leaves`` are the leaves' hashes, each shortened to 64 bits.
    """
    leaf = lambda x: F.sha2(F.concat(F.lit("leaf:"), x), 256)
    paragraph = lambda p: _once(
        F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), leaf),
        lambda hashes: F.struct(_node(hashes).alias("hash"), F.transform(hashes, lambda h: F.xxhash64(h)).alias("leaves")),
    )
    section = lambda s: _once(
        F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), 0), paragraph),
        lambda paragraphs: F.struct(_node(paragraphs["hash"]).alias("hash"), paragraphs.alias("paragraphs")),
    )
    return _once(
        F.transform(F.regexp_extract_all(text, F.lit(SECTION), 0), section),
        lambda sections: F.struct(_node(sections["hash"]).alias("root"), sections.alias("sections")),
    )


def leaves(node: Column) -> Column:
    """The tree's distinct leaf hashes."""
    return F.array_distinct(F.flatten(F.flatten(F.transform(node["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    """1 where roots are equal, else the Dice coefficient of the trees' distinct leaves (0 where both have none)."""
    total = F.size(a_leaves) + F.size(b_leaves)
    share = 2.0 * F.size(F.array_intersect(a_leaves, b_leaves)) / total
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(share)


def paragraphs(node: Column) -> Column:
    """The tree's paragraphs in order: array<struct<hash, section, paragraph>> with indexes from 0."""
    return F.flatten(F.transform(node["sections"], lambda s, i: F.transform(s["paragraphs"], lambda p, j: F.struct(p["hash"].alias("hash"), i.alias("section"), j.alias("paragraph")))))


def summary(text: Column) -> Column:
    """What comparing needs of a text's tree: struct<root, paragraphs, leaves>."""
    return _once(tree(text), lambda t: F.struct(t["root"].alias("root"), paragraphs(t).alias("paragraphs"), leaves(t).alias("leaves")))


def edits(a: Column, b: Column) -> Column:
    """Places (indexes from 0) of the paragraphs of ``a`` that differ from those of ``b`` (summaries): array<struct<section, paragraph>>.

    A paragraph is the same if its hash is that of the paragraph at its place, counted from the start or from the end: so what stands
    before the first and after the last edit is told, in time in proportion to the paragraphs. Where roots are equal there are none.
    """

    def differing(z: Column) -> Column:
        shift = F.size(z["known"]) - F.size(z["places"])
        same = lambda x, at: F.coalesce(x["hash"] == F.get(z["known"], at)["hash"], F.lit(False))
        left = F.filter(z["places"], lambda x, k: ~(same(x, k) | same(x, k + shift)))
        return F.transform(left, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    found = _once(F.struct(a["paragraphs"].alias("places"), b["paragraphs"].alias("known")), differing)
    return F.when(a["root"] == b["root"], F.slice(found, 1, 0)).otherwise(found)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``fingerprint`` and ``tree``. Null text counts as empty; further columns stay out."""
    base = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return base.withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", F.col("tree.root"))


def bucket_of(key: Column, cuts: list) -> Column:
    """The number of ascending ``cuts`` below ``key``, by way of a coarse list of them; -1 for null."""
    if not cuts:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("int")
    width = max(1, isqrt(len(cuts)))
    below = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + (key > x).cast("int"))
    first = F.greatest(F.lit(0), below(F.lit(cuts[::width])) - 1) * width
    return F.when(key.isNull(), F.lit(-1)).otherwise(first + below(F.slice(F.lit(cuts), first + 1, F.lit(width)))).cast("int")


def with_next(docs: DataFrame, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with ``own`` (its summary) and ``next`` (struct<text, root, leaves>), of the next row by (doc_id, text); the first one's after the last.

    Rows are dealt into ranges of doc_id by approximate quantiles. A range has ``bucket_rows`` rows, or the square root of all where that is more, so that
    neither a range nor the list of cuts grows with all rows. Each range also gets the first row of the next one,
    so no task sees more than its ranges. Trees are made before the rows move. Null ids come first; a table of one row is its own successor.
    """
    base = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = base.count()
    n = max(1, rows // max(bucket_rows, isqrt(rows)))
    cuts = base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 8 * n)).alias("x")).first()["x"] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    key = F.col("doc_id")
    placed = base.withColumn("bucket", bucket_of(key, cuts)).withColumn("k", F.coalesce(key, F.lit(-(1 << 63))))
    # The first row of each range by (doc_id, text) goes to the range before it as a guard.
    least = scratch.table(placed.groupBy(F.col("bucket").alias("b")).agg(F.min("k").alias("least")), "least")
    ring = Window.orderBy("b")  # bucket numbers alone
    before = F.coalesce(F.lag("b").over(ring), F.max("b").over(Window.partitionBy()))
    told = scratch.table(least.select("b", "least", before.alias("before")), "ring")
    firsts = placed.join(checked_broadcast(told, 32), (F.col("bucket") == F.col("b")) & (F.col("k") == F.col("least")))
    firsts = firsts.groupBy("before").agg(F.min("text").alias("text"))
    guards = firsts.select(F.col("before").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("guard"))
    both = placed.select("bucket", "doc_id", "text", F.lit(False).alias("guard")).unionByName(guards)
    order = Window.partitionBy("bucket").orderBy(F.col("guard"), F.col("doc_id").asc_nulls_first(), F.col("text"))
    following = F.lead(F.struct("text", F.col("own.root").alias("root"), F.col("own.leaves").alias("leaves"))).over(order)
    return both.withColumn("own", summary(F.col("text"))).repartition("bucket").withColumn("next", following).where(~F.col("guard")).select("doc_id", "text", "own", "next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down, in code points) replaced by the first as many code points of ``following``, or all of it."""
    size = F.char_length(text)
    k = F.floor(size / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - k), F.substring(following, F.lit(1), k))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text), of their edited texts, and their likeness to these and to the next document.

    Null text counts as empty: its tree has no sections, and it is like another empty text (1) and no other (0). Texts of any length are one tree. Rows
    that repeat an id follow each other by text; equal rows have likeness 1. A null id comes first. An empty table gives no rows. Further columns are ignored.
    """
    pairs = with_next(docs, Scratch(docs.sparkSession, "merkle"))
    new = _once(edited(F.col("text"), F.col("next.text")), lambda t: F.struct(F.sha2(t, 256).alias("sha256"), summary(t).alias("own")))
    rows = pairs.withColumn("new", new)
    own, changed, following = F.col("own"), F.col("new.own"), F.col("next")
    result = F.struct(
        F.col("new.sha256").alias("edited_sha256"), own["root"].alias("fingerprint"), changed["root"].alias("edited_fingerprint"),
        likeness(own["root"], changed["root"], own["leaves"], changed["leaves"]).alias("near_edited"),
        likeness(own["root"], following["root"], own["leaves"], following["leaves"]).alias("near_next"),
        edits(changed, own).alias("edited_paragraphs"),
    )
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), result.alias("r")).select("doc_id", "n_chars", "r.*")
