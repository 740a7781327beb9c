"""Incremental updates of a chunk index: which chunks are unchanged, moved, modified, added or deleted.

``old``: doc_id, chunk_id, position, structural_hash, embedding_hash. ``new``: the same columns.
A chunk is matched at most once: by id and embedding hash (UNCHANGED), embedding hash (MOVED), id (MODIFIED), structural hash
(MODIFIED), in this order of rules and, within a rule, in order of the new chunks; of several old ones the nearest position wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

DECISIONS = "doc_id long, chunk_id string, position int, kind string, old_chunk_id string, old_position int"
RULES = (("UNCHANGED", ("chunk_id", "embedding_hash")), ("MOVED", ("embedding_hash",)), ("MODIFIED", ("chunk_id",)), ("MODIFIED", ("structural_hash",)))


def match(old: list[dict], new: list[dict]) -> list[tuple]:
    """Decisions (chunk_id, position, kind, old chunk_id, old position) for one document, deletions included."""
    todo, out = sorted(new, key=lambda r: r["position"]), []
    free = {i: r for i, r in enumerate(sorted(old, key=lambda r: r["position"]))}
    for kind, names in RULES:
        index: dict[tuple, list[int]] = {}
        for i, r in free.items():
            index.setdefault(tuple(r[n] for n in names), []).append(i)
        rest = []
        for r in todo:
            places = [i for i in index.get(tuple(r[n] for n in names), ()) if i in free]
            if places:
                was = free.pop(min(places, key=lambda i: (abs(free[i]["position"] - r["position"]), i)))
                out.append((r["chunk_id"], r["position"], kind, was["chunk_id"], was["position"]))
            else:
                rest.append(r)
        todo = rest
    out += [(r["chunk_id"], r["position"], "ADDED", None, None) for r in todo]
    out.sort(key=lambda d: d[1])
    return out + [(None, None, "DELETED", r["chunk_id"], r["position"]) for r in free.values()]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions for all documents: each document's chunks, bounded by its length, meet in one call."""
    names = ["doc_id", "chunk_id", "position", "structural_hash", "embedding_hash"]

    def run(left, right):
        import pandas as pd

        doc = (left if len(left) else right)["doc_id"].iloc[0]
        rows = [(doc, *d) for d in match(left.to_dict("records"), right.to_dict("records"))]
        frame = pd.DataFrame(rows, columns=["doc_id", "chunk_id", "position", "kind", "old_chunk_id", "old_position"])
        return frame.astype({"position": "Int32", "old_position": "Int32"})

    return old.select(*names).groupBy("doc_id").cogroup(new.select(*names).groupBy("doc_id")).applyInPandas(run, DECISIONS)


def diff_unique(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same where ids and hashes are unique within each document: joins alone."""
    o = old.select("doc_id", F.col("chunk_id").alias("old_chunk_id"), F.col("position").alias("old_position"), F.col("structural_hash").alias("os"), F.col("embedding_hash").alias("oe"))
    left, rest, found = o, new.select("doc_id", "chunk_id", "position", "structural_hash", "embedding_hash"), []
    pairs = {"chunk_id": "old_chunk_id", "embedding_hash": "oe", "structural_hash": "os"}
    for kind, names in RULES:
        on = (left["doc_id"] == rest["doc_id"]) & (left[pairs[names[0]]] == rest[names[0]])
        for n in names[1:]:
            on = on & (left[pairs[n]] == rest[n])
        hit = rest.join(left, on).select(rest["doc_id"], "chunk_id", "position", F.lit(kind).alias("kind"), "old_chunk_id", "old_position")
        # Written, so that a rule's plan doesn't hold all rules before it.
        hit = written(hit, "diff-hit")
        found.append(hit)
        rest = written(rest.join(hit.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti"), "diff-new")
        left = written(left.join(hit.select("doc_id", "old_chunk_id"), ["doc_id", "old_chunk_id"], "left_anti"), "diff-old")
    none = F.lit(None)
    found.append(rest.select("doc_id", "chunk_id", "position", F.lit("ADDED").alias("kind"), none.cast("string").alias("old_chunk_id"), none.cast("int").alias("old_position")))
    found.append(left.select("doc_id", none.cast("string").alias("chunk_id"), none.cast("int").alias("position"), F.lit("DELETED").alias("kind"), "old_chunk_id", "old_position"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def statistics(decisions: DataFrame) -> DataFrame:
    """Counts of each kind by document, and how many chunks need a new embedding."""
    kinds = ("UNCHANGED", "MOVED", "MODIFIED", "ADDED", "DELETED")
    counts = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds]
    return decisions.groupBy("doc_id").agg(*counts, F.count_if(F.col("kind").isin("MODIFIED", "ADDED")).alias("embedded"))


def apply(index: DataFrame, decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """The new index (chunk_id, vector): vectors of unchanged and moved chunks are reused, ``fresh`` (chunk_id, vector) gives the others, and obsolete ones go."""
    kept = decisions.where(F.col("kind").isin("UNCHANGED", "MOVED")).select("old_chunk_id", F.col("chunk_id").alias("new_id"))
    reused = index.join(kept, index["chunk_id"] == kept["old_chunk_id"]).select(F.col("new_id").alias("chunk_id"), "vector")
    return reused.unionByName(fresh.select("chunk_id", "vector"))


def upsert(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``index`` with the rows of ``changes`` in place of those of equal key."""
    return index.join(changes.select(key), key, "left_anti").unionByName(changes)
