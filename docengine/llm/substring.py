"""Exact removal of repeated passages by suffix automata of reference shards.

A window is ``window`` consecutive words. Each window has an anchor: the smallest hash among its word 10-grams, so equal
windows have equal anchors, and consecutive windows mostly share one. Windows whose anchor occurs once in the corpus can't
repeat. The runs of windows of the other anchors are dealt into reference shards by anchor, as words; in
a shard, a generalised suffix automaton of the distinct runs counts the end positions of all their substrings, and streaming
the runs through it gives the windows that occur at least twice. An automaton of all text can't be broadcast, nor each document
streamed past each shard, at a cost in proportion to the input: the anchors tell which shard can hold a match, and lose none.
Anchors of very many runs are dealt out by whole window, so that no shard grows with one passage's copies; those of a thousandth of all
runs or more are told to every task, and no join meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, need, release, spread_join
from .tokens import text_slices

WINDOW = 35
GRAM = 10
#: Anchors of more runs than this are dealt out by window.
HOT = 4000
#: Anchors with more than one in so many of all runs are known to every task; there are fewer than that.
SLICES = 1000
#: Runs of consecutive anchors share an automaton up to about so many words.
SHARD_WORDS = 20_000


class Automaton:
    """A generalised suffix automaton over integers, with weighted counts of end positions."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the longest string of q's class that p reaches by ``symbol``: q, or a copy split from it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, string: list[int], weight: int = 1) -> None:
        """Add a string that occurs ``weight`` times."""
        last = 0
        for symbol in string:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, symbol, self.next[p][symbol])
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Sum counts up the suffix links; before this, they are those of prefixes alone."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeats(self, string: list[int], window: int, least: int = 2) -> list[bool]:
        """For each window of ``string`` whether it occurs at least ``least`` times in what was added: matching statistics cut at ``window``."""
        out, state, matched = [], 0, 0
        for i, symbol in enumerate(string):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if i >= window - 1:
                out.append(matched >= window and self.count[state] >= least)
        return out


def runs_of(texts, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one anchor, for an Arrow string array: arrays (text, first window, windows, anchor)."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = words.offsets.to_numpy()
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    known = flat.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)
    full = np.array([bool(w) for w in known], dtype=bool)[codes] if len(codes) else np.zeros(0, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    h = hashes[codes[full]] if len(codes) else np.zeros(0, dtype=np.uint64)
    if len(h) < window:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    g = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1)
    text = np.searchsorted(ends, np.arange(len(at)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(at)) + window <= ends[text + 1])
    if not len(inside):
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    begin = np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(at[inside]) != 0) | (np.diff(text[inside]) != 0)])
    first = np.flatnonzero(begin)
    s = inside[first]
    return [text[s], s - ends[text[s]], np.diff(np.concatenate([first, [len(inside)]])), g[at[s]]]


def solve(group, window: int = WINDOW):
    """Bit masks of repeated windows for rows (anchor, run's words, count) of some anchors, each anchor's rows complete."""
    words: dict[bytes, int] = {}
    automaton, strings = Automaton(), []
    for _, run, n in group:
        string = [words.setdefault(w, len(words)) for w in run.split(b" ")]
        strings.append(string)
        automaton.add(string, n)
    automaton.finish()
    masks = []
    for (_, _, n), string in zip(group, strings):
        if n > 1:
            masks.append((1 << (len(string) - window + 1)) - 1)
        else:
            masks.append(sum(1 << i for i, x in enumerate(automaton.repeats(string, window)) if x))
    return masks


def repeated_windows(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard_key, run_hash, mask) of distinct ``runs`` (shard_key, run, n): which of a run's windows occur twice at least."""
    ordered = runs.repartition("shard_key").sortWithinPartitions("shard_key")

    def stream(batches):
        import pyarrow as pa
        import xxhash

        def result(group):
            rows = []
            for (key, run, _), mask in zip(group, solve(group, window)):
                if mask:
                    h = xxhash.xxh64_intdigest(run, 42)
                    rows.append((key, h - (1 << 64) if h >> 63 else h, mask))
            return rows

        kinds = (pa.int64(),) * 3
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard_key", "run_hash", "mask"])

        group, own, size, done = [], [], 0, []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if own and own[-1][0] != row[0]:
                    # A key of one distinct run needs no automaton: all its windows are as frequent as the run.
                    if len(own) > 1:
                        group += own
                        size += sum(r[1].count(b" ") + 1 for r in own)
                    elif own[0][2] > 1:
                        group += own
                        size += own[0][1].count(b" ") + 1
                    own = []
                    if size > SHARD_WORDS:
                        done += result(group)
                        group, size = [], 0
                    if len(done) > 20_000:
                        yield out(done)
                        done = []
                own.append(row)
        group += own
        yield out(done + result(group))

    return ordered.select("shard_key", "run", "n").mapInArrow(stream, "shard_key long, run_hash long, mask long")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) without the words that a repeated window covers: doc_id, n_words, n_removed, kept (words joined by one space), spans (removed [begin, end) word ranges).

    A window repeats if its words also start anywhere else, in the same document or another. Null and empty texts have no words;
    texts shorter than a window keep all; rows that repeat are documents of their own, hence copies of each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    base = need(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    # A run has window - grams + 1 windows at most, whose marks are bits of one long.
    grams = window - 1 if window <= GRAM else max(GRAM, window - 60)

    def find(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in text_slices(texts):
                text, first, n, anchor = runs_of(texts.slice(a, b - a), window, grams)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64))], names=["key", "first", "n", "anchor"])

    runs = scratch.table(base.select("key", "text").mapInArrow(find, "key long, first int, n int, anchor long"), "runs")
    often = scratch.table(runs.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("times")).where("times > 1"), "often")
    line = max(HOT, runs.count() // SLICES)
    top = [r["a"] for r in often.where(F.col("times") > line).select("a").collect()]  # fewer than SLICES
    hot = F.col("anchor").isin(top) if top else F.lit(False)
    very, few = runs.where(hot), runs.where(~hot)
    rest = few.join(often.where(F.col("times") <= line), F.col("anchor") == F.col("a"))
    shared = rest.select("key", "first", "n", "anchor", (F.col("times") > HOT).alias("hot")).unionByName(very.select("key", "first", "n", "anchor", F.lit(True).alias("hot")))
    shared = scratch.table(shared, "shared")
    release(spark)
    scratch.drop("runs", "often")

    # Rows that repeat have one key: their runs are the same, and each row gets the list once.
    lists = shared.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("first", "n", "anchor", "hot")).alias("runs"))
    texts = scratch.table(base.join(lists, F.col("key") == F.col("k"), "left").select("key", "doc_id", "text", "runs"), "texts")
    release(spark)
    scratch.drop("shared")

    def cut(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text, firsts, ns, anchors, hots in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                words = text.encode().split()
                for first, n, anchor, hot in zip(firsts, ns, anchors, hots):
                    if first + n + window - 1 > len(words):
                        continue  # another document's key
                    if not hot:
                        rows.append((key, first, anchor, b" ".join(words[first : first + n + window - 1])))
                        continue
                    for i in range(first, first + n):
                        run = b" ".join(words[i : i + window])
                        rows.append((key, i, int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little", signed=True), run))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["key", "first", "shard_key", "run"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["key", "first", "shard_key", "run"])

    listed = texts.where("runs is not null").select("key", "text", "runs.first", "runs.n", "runs.anchor", "runs.hot")
    places = scratch.table(listed.mapInArrow(cut, "key long, first int, shard_key long, run string"), "places")
    distinct = places.groupBy("shard_key", "run").agg(F.count("*").alias("n"))
    masks = scratch.table(repeated_windows(distinct, window), "masks")
    release(spark)
    own = places.select("key", "first", F.struct("shard_key", F.xxhash64("run").alias("run_hash")).alias("at"))
    found = spread_join(own, masks.select(F.struct("shard_key", "run_hash").alias("at"), "mask"), "at", None)
    marks = scratch.table(found.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("first", "mask")).alias("marks")), "marks")
    release(spark)
    scratch.drop("places", "masks")

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<array<int>>")
    def keep(texts, marks):
        import numpy as np
        import pandas as pd

        rows = []
        for text, found in zip(texts, marks):
            words = (text or "").encode().split()
            if found is None or not len(found):
                rows.append((len(words), 0, b" ".join(words).decode(), []))
                continue
            step = np.zeros(len(words) + 1, dtype=np.int64)
            for m in found:
                first, mask = m["first"], m["mask"]
                for i in range(mask.bit_length()):
                    if mask >> i & 1 and first + i + window <= len(words):
                        step[first + i] += 1
                        step[first + i + window] -= 1
            gone = np.cumsum(step)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
            kept, at = [], 0
            for a, b in edges.tolist():
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((len(words), int(gone.sum()), b" ".join(kept).decode(), edges.tolist()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "spans"])

    some = texts.where("runs is not null").select("key", "doc_id", "text").join(marks, F.col("key") == F.col("k"), "left")
    rest = texts.where("runs is null").select("key", "doc_id", "text", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("array<struct<first:int,mask:bigint>>").alias("marks"))
    rows = some.unionByName(rest).withColumn("r", keep("text", "marks"))
    return rows.select("doc_id", "r.n_words", "r.n_removed", "r.kept", "r.spans")
