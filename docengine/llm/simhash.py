"""SimHash near-duplicates: multi-index hashing finds links, contraction joins them into groups.

Fingerprints are cut into segments. Each is a table: a fingerprint is stored under its segment and probes the Hamming ball around
it. A ball of radius 1 is dealt out by pieces: the segment is cut into pieces, and a row goes to the bucket of
all pieces but one, for each of them. Of two segments that differ in one bit, the others are equal, so they meet in the bucket that
leaves out the piece that differs; there the ball's values in that piece are enumerated and looked up. So a text makes as many rows as there are
pieces, not one for each value of a ball. All matches are verified on all bits.

Only distinct fingerprints take part. A task keeps a spanning forest of the links that it has found, nearest first, so
no group of near copies is expanded into all pairs; buckets of more than ``BLOCK_ROWS`` are dealt out in pairs of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, log, log2, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast, need, release, spread_join
from ._graph import components, forest
from .tokens import forget

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Near copies by similarity: words of a shingle, least Jaccard similarity, share of pairs of just this similarity that the tables bring together.
SIMILAR = {"size": 5, "least": 0.8, "recall": 0.99}
#: Prints of 64 bits whose distance orders and bounds the candidates, at least.
LEAST_PRINTS = 8
BLOCK_ROWS = 65_536
#: Links that a task holds before it cuts them down to a forest, and links of a forest that it sends on.
HELD, SENT = 1 << 20, 1 << 19
#: Pairs of texts that are compared at a time, at least; beyond, a quarter of the rows.
COMPARED = 1 << 16
#: Bits of a set's sketch, a power of two.
SKETCH = 1024

SKETCHES = [f"o{k}" for k in range(SKETCH // 64)]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Layout:
    """``segments``: (print, first bit, bits, pieces); no pieces: the segment has to be equal, else one bit may differ."""

    prints: int
    segments: tuple[tuple[int, int, int, int], ...]
    radius: int


#: For 64 bits and radius 4, by the pigeonhole principle: the first or second segment differs in one bit at most, or the third is equal.
EXACT = Layout(1, ((0, 0, 21, 3), (0, 21, 21, 3), (0, 42, 22, 0)), RADIUS)


def layout(rows: int, least: float = SIMILAR["least"], recall: float = SIMILAR["recall"]) -> Layout:
    """Tables for ``rows`` texts in which pairs of similarity ``least`` meet with probability ``recall``.

    Texts of similarity J differ in a bit with probability arccos(2J / (1 + J)) / pi. Segments are as wide as keeps the chance matches of a
    text in a table about constant, whatever the rows; as many as the recall needs, so these grow slowly with the rows.
    The radius lies three standard deviations above what texts of similarity ``least`` differ in.
    """
    differ = acos(2 * least / (1 + least)) / pi
    bits = max(16, 2 * ceil((log2(max(rows, 1)) - 2) / 2))
    hit = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    count, fit = ceil(log(1 - recall) / log(1 - hit)), 64 // bits
    prints = max(LEAST_PRINTS, ceil(count / fit))
    mean = 64 * prints * differ
    return Layout(prints, tuple((k // fit, k % fit * bits, bits, 2) for k in range(count)), int(mean + 3 * sqrt(mean * (1 - differ))))


def shingles(text: str | None, size: int):
    """XXH64 of each of the text's word shingles, repeats included; of the whole text if it has no more than ``size`` words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype="<u8")


def fingerprint(text: str | None, size: int = SHINGLE, prints: int = 1) -> list[int]:
    """The 64-bit SimHashes of the text's word shingles, each by another hash; the first is XXH64's. All 0 without words."""
    return votes(shingles(text, size), prints)


def votes(hashes, prints: int) -> list[int]:
    """The SimHashes of shingles' hashes."""
    import numpy as np

    if not len(hashes):
        return [0] * prints
    out = []
    for k in range(prints):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            hashes ^= hashes >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little"))
    return out


def sketch(hashes):
    """The odd sketch of distinct ``hashes``: a bit is 1 if an odd number of them end in its place. What two sets share cancels out, so their sketches differ in no more bits than the sets in elements."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def may_be_similar(sizes, others, differ, least: float):
    """Whether sets of ``sizes`` and ``others`` elements that differ in at least ``differ`` of them can have Jaccard similarity ``least``: none that has it is ruled out."""
    import numpy as np

    differ = np.maximum(differ, np.abs(sizes - others))
    return (1 + least) * differ <= (1 - least) * (sizes + others) + 1e-6


def fingerprints(docs: DataFrame, size: int = SHINGLE, prints: int = 1) -> DataFrame:
    """(doc_id, p0, p1, ...) of ``docs`` (doc_id, text): its prints as signed 64-bit integers."""

    @F.pandas_udf(", ".join(f"p{k} long" for k in range(prints)))
    def of(texts):
        import numpy as np
        import pandas as pd

        forget()
        rows = np.array([fingerprint(t, size, prints) for t in texts], dtype=np.uint64).reshape(-1, prints).view(np.int64)
        return pd.DataFrame(rows, columns=[f"p{k}" for k in range(prints)])

    return need(docs, "doc_id", "text").select("doc_id", of(F.col("text")).alias("p")).select("doc_id", "p.*")


def tables(how: Layout) -> list[tuple[int, int, int, int, int, bool]]:
    """(print, first bit, bits, first bit of the piece left out, its bits, whether equal segments count) for each table.

    Equal segments meet in all tables of a segment, so they count in the first alone.
    """
    out = []
    for word, first, bits, pieces in how.segments:
        if not pieces:
            out.append((word, first, bits, 0, 0, True))
        cuts = [bits * i // pieces for i in range(pieces)] + [bits] if pieces else []
        out += [(word, first, bits, a, b - a, i == 0) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def _buckets(classes: DataFrame, how: Layout) -> DataFrame:
    """``classes`` (id, p0, ...) once for each table: with ``bucket`` (table and segment without the piece) and ``piece``."""

    def entry(i: int, word: int, first: int, bits: int, low: int, length: int, _: bool) -> Column:
        own = F.shiftrightunsigned(f"p{word}", first).bitwiseAND(F.lit((1 << bits) - 1))
        hole = ((1 << length) - 1) << low
        piece = F.shiftrightunsigned(own.bitwiseAND(F.lit(hole)), low).cast("int")
        return F.struct(own.bitwiseAND(F.lit(((1 << bits) - 1) & ~hole)).bitwiseOR(F.lit(i << 48)).alias("bucket"), piece.alias("piece"))

    rows = classes.select("*", F.explode(F.array(*[entry(i, *t) for i, t in enumerate(tables(how))])).alias("s"))
    return rows.select("s.bucket", "s.piece", *classes.columns)


def matches(piece, group, flips, equal: bool):
    """Pairs of positions (x, y) in one ``group`` each (ascending array) whose ``piece`` differ in one of the bits ``flips``, or are equal if ``equal``; in parts of bounded size."""
    import numpy as np

    code = (group << 32) | piece
    order = np.argsort(code, kind="stable")
    code = code[order]
    for flip in [0] * equal + list(flips):
        if flip:
            probes = np.flatnonzero(code & flip == 0)  # the other end of a pair has the bit
            low = np.searchsorted(code, code[probes] | flip, "left")
            many = np.searchsorted(code, code[probes] | flip, "right") - low
        else:
            probes = np.arange(len(code))
            low = probes + 1
            many = np.searchsorted(code, code, "right") - low
        live = np.flatnonzero(many)
        probes, low, many = probes[live], low[live], many[live]
        work, at = np.cumsum(many), 0
        while at < len(probes):
            upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 100_000, "right")))
            n = many[at:upto]
            x = np.repeat(probes[at:upto], n)
            y = np.repeat(low[at:upto] - np.cumsum(n) + n, n) + np.arange(len(x))
            yield order[x], order[y]
            at = upto


def links(classes: DataFrame, scratch: Scratch, how: Layout = EXACT, block_rows: int = BLOCK_ROWS, name: str = "links", least: float = 0.0) -> DataFrame:
    """(a, b): links that join the same components as all pairs of ``classes`` (id, p0, p1, ...) that meet in a bucket and are within the radius.

    Each task sends a forest of the links that it finds, at most one link less than it has texts with links. If ``classes`` have a ``label`` (long),
    and the ``n`` and ``o0``, ``o1``, ... of their shingle sets (elements and sketch), the links are instead all such pairs whose labels differ, each once, in the first segment where it meets,
    without those whose sketches prove a Jaccard similarity below ``least``.
    """
    prints = [f"p{k}" for k in range(how.prints)]
    labelled = ["label", "n", *SKETCHES] if "label" in classes.columns else []
    rows = _buckets(classes.select("id", *labelled, *prints), how)
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    hot = scratch.table(hot.select(F.col("bucket").alias("h"), F.ceil(F.col("n") / block_rows).cast("int").alias("parts")), f"{name}-hot")
    # A row of a large bucket lies in one block of it, and meets every block: in the pair of blocks, the smaller first.
    live = rows.join(checked_broadcast(hot, 32), F.col("bucket") == F.col("h"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    live = live.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("own", t).alias("i"), F.greatest("own", t).alias("j")))
    dealt = live.select("bucket", "piece", "own", F.explode(pairs).alias("r"), "id", *labelled, *prints).select("bucket", "r.i", "r.j", "own", "piece", "id", *labelled, *prints)
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    known, radius, segments = tables(how), how.radius, how.segments
    segment = [s for s, (_, _, _, pieces) in enumerate(segments) for _ in range(max(1, pieces))]

    def find(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []
        size = 0

        def reduced():
            a, b, d = (np.concatenate([h[k] for h in held]) for k in range(3))
            at = forest(a, b, d)
            return [(a[at], b[at], d[at])]

        def solve(cols):
            nonlocal held, size
            bucket, i, j, own, piece, ids = (c.astype(np.int64, copy=False) for c in cols[:6])
            if labelled:
                label, n = (c.astype(np.int64, copy=False) for c in cols[6:8])
                odd = np.stack([c.view(np.uint64) for c in cols[8 : 6 + len(labelled)]], axis=1)
            p = np.stack([c.view(np.uint64) for c in cols[6 + len(labelled) :]], axis=1)
            group = np.cumsum(np.concatenate([[False], (np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            table = bucket >> 48
            for t in np.unique(table).tolist():
                lo, hi = np.searchsorted(table, t), np.searchsorted(table, t, "right")
                for x, y in matches(piece[lo:hi], group[lo:hi], [1 << k for k in range(known[t][4])], known[t][5]):
                    x, y = x + lo, y + lo
                    apart = (i[x] == j[x]) | (own[x] != own[y])  # rows of one block meet in its own pair
                    distance = np.bitwise_count(p[x] ^ p[y]).sum(axis=1, dtype=np.int16)
                    near = np.flatnonzero(apart & (distance <= radius))
                    if labelled:
                        near = near[label[x[near]] != label[y[near]]]
                        for word, first, bits, pieces in segments[: segment[t]]:
                            differ = (p[x[near], word] ^ p[y[near], word]) >> np.uint64(first) & np.uint64((1 << bits) - 1)
                            near = near[np.bitwise_count(differ) > bool(pieces)]
                        differ = np.bitwise_count(odd[x[near]] ^ odd[y[near]]).sum(axis=1, dtype=np.int64)
                        near = near[may_be_similar(n[x[near]], n[y[near]], differ, least)]
                        x, y = ids[x[near]], ids[y[near]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                    elif len(near):
                        x, y = ids[x[near]], ids[y[near]]
                        held.append((np.minimum(x, y), np.maximum(x, y), distance[near]))
                        size += len(near)
                        if size > HELD:
                            held = reduced()
                            size = len(held[0][0])
                            if size > SENT:
                                yield sent()

        def sent():
            nonlocal held, size
            a, b, _ = reduced()[0] if held else (np.zeros(0, dtype=np.int64),) * 3
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            if rest is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            rest = [np.array(c[cut:]) for c in cols]
            if cut:
                yield from solve([np.ascontiguousarray(c[:cut]) for c in cols])
        if rest is not None:
            yield from solve(rest)
        yield sent()

    pairs = dealt.mapInArrow(find, "a long, b long")
    return scratch.table(pairs if labelled else pairs.distinct(), name)


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each of ``docs`` (doc_id, text): doc_id, its fingerprint p0, component_id (the smallest doc_id that links of at most ``RADIUS`` bits reach, itself included).

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other. Repeated rows are kept. Rows with
    a null doc_id take part, but null is no component's smallest id unless it has no other. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.table(fingerprints(docs, size), "prints")
    classes = scratch.table(table.groupBy("p0").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select(F.col("p0").alias("id"), "p0"), scratch), scratch)
    known = classes.join(labels, F.xxhash64("p0") == F.col("node")).select("p0", "least", "label")
    known = scratch.table(known, "known")
    # Only fingerprints with links need their component's smallest id; all others have their own.
    least = scratch.table(known.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    linked = scratch.table(spread_join(known.select("p0", "label"), least, "label").select("p0", "component_id"), "linked")
    named = classes.join(linked.withColumnRenamed("p0", "p"), F.col("p0") == F.col("p"), "left").select("p0", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(table, scratch.table(named, "named"), "p0").select("doc_id", "p0", "component_id")


def alike(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose ``texts`` (id, text) have shingle sets of Jaccard similarity ``least`` or more."""

    @F.pandas_udf("boolean")
    def close(left, right):
        import numpy as np
        import pandas as pd

        out, last, x = [], None, None
        for a, b in zip(left, right):
            if last is None or a != last:
                last, x = a, np.unique(shingles(a, size))
            y = np.unique(shingles(b, size))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out)

    # The same plan at every size: texts are shuffled, never broadcast.
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    rows = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    return rows.where(close("left", "right")).select("a", "b")


def near_classes(docs: DataFrame, scratch: Scratch, size: int, least: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (id, first, text), whose ids are distinct: (id, digest) and (digest, first, label): classes of equal shingle sets, their least ``first`` and group."""
    how = layout(docs.count(), least, recall)
    names = [f"p{k}" for k in range(how.prints)]

    @F.pandas_udf(", ".join(f"{n} long" for n in [*names, "n", *SKETCHES]) + ", digest binary")
    def of(texts):
        import hashlib

        import numpy as np
        import pandas as pd

        forget()
        rows, digests = [], []
        for t in texts:
            hashes = np.unique(shingles(t, size))  # votes of the set, so that repeats of a shingle don't part near copies
            rows.append([*votes(hashes, how.prints), len(hashes), *sketch(hashes).tolist()])
            digests.append(hashlib.sha256(hashes.tobytes()).digest()[:16])
        out = pd.DataFrame(np.array(rows, dtype=np.uint64).reshape(-1, how.prints + 1 + len(SKETCHES)).view(np.int64), columns=[*names, "n", *SKETCHES])
        return out.assign(digest=digests)

    table = scratch.table(docs.select("id", "first", of(F.col("text")).alias("p")).select("id", "first", "p.*"), "prints")
    prints = F.struct(*names, "n", *SKETCHES)
    classes = table.groupBy("digest").agg(F.min("first").alias("first"), F.min("id").alias("least"), F.min(prints).alias("p"))
    classes = scratch.table(classes.select("digest", "first", F.col("least").alias("id"), "p.*"), "classes")
    found = links(classes.select("id", *names), scratch, how)
    ends = scratch.table(found.select(F.col("a").alias("id")).union(found.select("b")).distinct(), "ends")
    texts = scratch.table(docs.select("id", "text").join(checked_broadcast(ends, 16), "id", "left_semi"), "texts")
    release(docs.sparkSession)
    sure = scratch.table(alike(found, texts, size, least), "sure")
    labels = components(sure, scratch)
    # A forest of candidates may hold pairs that aren't similar in place of one that is: all other candidates between groups are judged, too,
    # by their sketches where these prove them unlike, else by their texts.
    live = classes.join(checked_broadcast(ends, 16), "id", "left_semi").join(labels, F.xxhash64("id") == F.col("node"), "left")
    between = links(live.select("id", F.coalesce("label", F.xxhash64("id")).alias("label"), "n", *SKETCHES, *names), scratch, how, name="between", least=least)
    release(docs.sparkSession)
    between = scratch.table(between.join(found, ["a", "b"], "left_anti"), "uncompared")
    parts = ceil(between.count() / max(COMPARED, classes.count() // 4))
    for k in range(parts):
        part = between.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k)
        if k:
            part = part.join(labels.toDF("x", "u"), F.xxhash64("a") == F.col("x"), "left").join(labels.toDF("y", "v"), F.xxhash64("b") == F.col("y"), "left")
            part = part.where(F.coalesce("u", F.xxhash64("a")) != F.coalesce("v", F.xxhash64("b"))).select("a", "b")
        sure = sure.union(scratch.table(alike(part, texts, size, least), f"sure{k}"))
        labels = components(sure, scratch)
        release(docs.sparkSession)
    told = classes.join(labels, F.xxhash64("id") == F.col("node"), "left").select("digest", "first", F.coalesce("label", F.xxhash64("id")).alias("label"))
    return table.select("id", "digest"), scratch.table(told, "told")


def near_copies(docs: DataFrame, size: int = SIMILAR["size"], least: float = SIMILAR["least"], recall: float = SIMILAR["recall"]) -> DataFrame:
    """For each of ``docs`` (doc_id, text), whose ids are distinct: doc_id, component_id (the smallest doc_id that links of near copies reach).

    Near copies have word shingles of Jaccard similarity ``least`` or more. SimHash tables find the candidates, ``recall`` of the
    pairs of just this similarity; the exact similarity decides about each candidate, until all between different groups are compared or ruled out by their sketches, which rule out no similar pair. Null and empty texts, and texts without words, are
    copies of each other. Texts of equal shingle sets are one class. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    base = need(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("first"), "text")
    table, classes = near_classes(base, scratch, size, least, recall)
    names = scratch.table(classes.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    named = scratch.table(spread_join(classes.select("digest", "label"), names, "label").select("digest", "component_id"), "named")
    return spread_join(table, named, "digest").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, size: int = SIMILAR["size"], least: float = SIMILAR["least"], recall: float = SIMILAR["recall"]) -> DataFrame:
    """``docs`` without all but one document of each group of near copies (see ``near_copies``): the row of its smallest doc_id; of rows that repeat this id, one stays.

    All columns stay. Rows whose id is null are compared by text alone, and stay where their group has no other.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    own = docs.columns
    rows = scratch.table(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_id")), "rows")
    first = F.struct(F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col("row_id").alias("row_id"))
    ids, classes = near_classes(rows.select(F.col("row_id").alias("id"), first.alias("first"), F.col("row.text").alias("text")), scratch, size, least, recall)
    stay = classes.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row_id").alias("keep"))
    # Those that go are fewer: where their ids are small enough to be told to all tasks, no text moves.
    gone = scratch.table(ids.join(stay.hint("merge"), F.col("id") == F.col("keep"), "left_anti").select(F.col("id").alias("gone")), "gone")
    scratch.keep_only("rows", "gone")
    return rows.join(checked_broadcast(gone, 16), F.col("row_id") == F.col("gone"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in own])
