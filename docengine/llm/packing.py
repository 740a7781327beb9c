"""Packing documents into windows of tokens by non-negative least squares over a length histogram.

A document gives full windows and a remainder. Remainders are planned as a histogram of at most
``window - 1`` counts, whatever the size of the corpus: combinations of two or three lengths that
fill a window exactly are enumerated, their repeat counts solved against the histogram by
non-negative least squares and rounded down; the residual counts are packed greedily, longest first,
and a piece is cut where a window ends. What is left after the last full window goes into windows
of power-of-two lengths. Hence no sequence holds padding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, checked_broadcast, need
from .tokens import CACHE_ENTRIES, encoder, text_slices

WINDOW = 4096
COMBINATIONS = 6000
SWEEPS = 30
#: Texts that a worker encodes at a time.
SLICE_BYTES = 8 << 20

TOKENIZED = "doc_id long, part int, n_tokens long, rest int, rest_rank long, full_before long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(histogram, window: int, most: int = COMBINATIONS):
    """At most ``most`` rows of (a, b, c), a <= b <= c, c may stand for nothing (0), a + b + c = window: pairs first, then the triples of the most frequent lengths."""
    import numpy as np

    h = np.asarray(histogram)
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(a), a, window - a], axis=1)
    pairs = pairs[(h[pairs[:, 1]] > 0) & (h[pairs[:, 2]] > 0)]
    room = max(0, most - len(pairs))

    def best(found):
        triples = np.concatenate(found)
        if len(triples) <= room:
            return triples
        return triples[np.lexsort((triples[:, 1], triples[:, 0], -h[triples].min(axis=1)))[:room]]

    # There are up to window * window / 12 triples; the driver holds a few times ``most`` of them.
    found, size = [np.zeros((0, 3), dtype=np.int64)], 0
    for x in range(1, window // 3 + 1):
        if h[x]:
            b = np.arange(x, (window - x) // 2 + 1)
            ok = (h[b] > 0) & (h[window - x - b] > 0)
            b = b[ok]
            found.append(np.stack([np.full_like(b, x), b, window - x - b], axis=1))
            size += len(b)
            if size > 4 * most:
                found = [best(found)]
                size = len(found[0])
    return np.concatenate([pairs, best(found)])


def least_squares(combos, histogram, sweeps: int = SWEEPS):
    """Repeat counts x >= 0 that bring the sum of x times the combinations near the histogram: coordinate descent."""
    import numpy as np

    left = np.asarray(histogram, dtype=float).tolist()
    columns = []
    for row in combos.tolist():
        uses: dict[int, int] = {}
        for length in row:
            if length:
                uses[length] = uses.get(length, 0) + 1
        columns.append((list(uses.items()), float(sum(n * n for n in uses.values()))))
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for i, (uses, norm) in enumerate(columns):
            step = max(-x[i], sum(n * left[length] for length, n in uses) / norm)
            if step:
                x[i] += step
                for length, n in uses:
                    left[length] -= n * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return np.array(x)


@dataclass
class Plan:
    """Where the k-th remainder of a length goes. ``keys`` are length << 44 | first rank, ascending."""

    window: int
    keys: object
    sequence: object  # first sequence id of the interval; -1: the residual line
    offset: object
    line_start: object  # position on the residual line of each length's first residual piece
    first_residual: object  # rank of that piece, by length
    line_sequence: int  # id of the line's first sequence
    line_tokens: int

    def bounds(self, begin: int, end: int):
        """(sequence, offset, length) of the line's cuts of [begin, end)."""
        w, full = self.window, self.line_tokens // self.window * self.window
        while begin < end:
            if begin < full:
                number, first = divmod(begin, w)
                stop, number, first = (number + 1) * w, number, first
            else:
                number, at, rest = full // w, full, self.line_tokens - full
                while True:  # windows of powers of two, longest first
                    size = 1 << (rest.bit_length() - 1)
                    if begin < at + size:
                        break
                    at, rest, number = at + size, rest - size, number + 1
                stop, first = at + size, begin - at
            take = min(end, stop) - begin
            yield self.line_sequence + number, first, take
            begin += take


def plan(histogram, first_sequence: int, window: int = WINDOW) -> Plan:
    """The plan for remainders of the given counts (index: length)."""
    import numpy as np

    h = np.asarray(histogram, dtype=np.int64)
    combos = combinations(h, window)
    repeats = np.floor(least_squares(combos, h)).astype(np.int64)
    used = np.zeros(window, dtype=np.int64)
    intervals: list[tuple[int, int, int, int]] = []
    sequence = first_sequence
    for row, times in zip(combos.tolist(), repeats.tolist()):
        lengths = [x for x in row if x]
        for x in set(lengths):
            times = min(times, (int(h[x]) - int(used[x])) // lengths.count(x))
        if times <= 0:
            continue
        at = 0
        for x in reversed(lengths):
            intervals.append((x, int(used[x]), sequence, at))
            used[x] += times
            at += x
        sequence += times
    left = h - used
    tokens = left * np.arange(window)
    line_start = np.concatenate([np.cumsum(tokens[::-1])[::-1][1:], [0]])  # longer pieces lie before shorter ones
    intervals += [(x, int(used[x]), -1, 0) for x in np.flatnonzero(left).tolist()]
    intervals.sort()
    of = lambda k: np.array([i[k] for i in intervals], dtype=np.int64)
    return Plan(window, (of(0) << 44) | of(1), of(2), of(3), line_start, used, sequence, int(tokens.sum()))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, byte_level: bool = False, cache_entries: int = CACHE_ENTRIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``window`` tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Each document's ids end with ``end_id``; null and empty texts hold just that. Repeated rows are packed each
    by itself; an empty table gives no pieces; further columns are ignored. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    end = end_id.to_bytes(2, "little")

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        work, full = encoder(tokenizer, byte_level, cache_entries), 0
        ranks: dict[int, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts, slice_bytes):
                rows = []
                for doc, raw in zip(ids[a:b], work.encode(texts.slice(a, b - a))):
                    n = len(raw) // 2 + 1
                    windows, rest = divmod(n, window)
                    rows.append((doc, part, n, rest, ranks.get(rest, 0), full, raw + end))
                    ranks[rest] = ranks.get(rest, 0) + 1
                    full += windows
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "part", "n_tokens", "rest", "rest_rank", "full_before", "ids"])

    tokens = scratch.table(need(docs, "doc_id", "text").mapInArrow(encode, TOKENIZED), "tokens")
    full = F.floor(F.col("n_tokens") / window)
    counts = scratch.table(tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(full).alias("full")), "counts")
    histogram = [0] * window  # one count for each length: bounded by the window
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    histogram[0] = 0
    n_full = counts.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]
    p = plan(histogram, n_full, window)

    parts = counts.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("full_base"))
    ranks = counts.select(F.col("part").alias("p"), F.col("rest").alias("r"), (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("rank_base"))
    bases = scratch.table(ranks.join(parts, "p"), "bases")
    placed = tokens.join(checked_broadcast(bases, 64), (F.col("part") == F.col("p")) & (F.col("rest") == F.col("r")))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        kinds = dict(zip(("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"), [pa.int64()] * 6 + [pa.binary()]))
        for batch in batches:
            d = batch.to_pydict()
            rest, rank = np.array(d["rest"], dtype=np.int64), np.array(d["rank"], dtype=np.int64)
            at = np.searchsorted(p.keys, (rest << 44) | rank, side="right") - 1
            rows: list[tuple] = []
            size = 0
            for i, (doc, n, raw, first) in enumerate(zip(d["doc_id"], d["n_tokens"], d["ids"], d["first_full"])):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                cuts = [(first + k, 0, window) for k in range(n // window)]
                r = int(rest[i])
                if r:
                    j = int(at[i])
                    within = int(rank[i]) - (int(p.keys[j]) & ((1 << 44) - 1))
                    if p.sequence[j] >= 0:
                        cuts.append((int(p.sequence[j]) + within, int(p.offset[j]), r))
                    else:
                        begin = int(p.line_start[r]) + within * r
                        cuts += p.bounds(begin, begin + r)
                start = 0
                for sequence, offset, length in cuts:
                    rows.append((doc, start, length, n, sequence, offset, ids[start : start + length].tobytes()))
                    start += length
                size += 4 * n
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    return placed.select("doc_id", "n_tokens", "rest", (F.col("rank_base") + F.col("rest_rank")).alias("rank"), (F.col("full_base") + F.col("full_before")).alias("first_full"), "ids").mapInArrow(place, PIECES)
