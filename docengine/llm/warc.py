"""WARC archives: writing with revisit records, and reading by verified boundary chains.

Archives are split into byte ranges. A task scans its range for places that look like a record's
first line and emits for each the offset of its successor: the place where, by its Content-Length,
the record ends. Payloads may hold such places as well, so none is believed by itself: chains are
compressed within each range, then pointer jumping from each file's start over the ranges' exits
keeps just what is reachable from offset 0. The number of rounds is the logarithm of the number of
ranges that a file has.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, create_folder, filesystem, need, spread_join

VERSION = b"WARC/1.1"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
#: So much is read beyond a range for the header of its last record; longer headers are read on to their end.
HEADER_BYTES = 64 << 10
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHAIN = "path string, range int, offset long, exit long, entered boolean, records int"
RECORDS = "path string, offset long, type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, page_id long, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, number: int | None, uri: str | None, payload: bytes, name: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds no payload but tells its digest and size."""
    clean = re.sub(r"[\x00-\x20\x7f]", "", uri or "") or "about:blank"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{name}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    else:
        lines += ["Content-Type: text/html"]
    lines += [f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + END


def parse_head(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) of the record at ``at`` and the offset of its block; None if that is no record."""
    first = MAGIC.match(data, at)
    if not first:
        return None
    fields, begin = {}, first.end()
    while (stop := data.find(b"\r\n", begin)) != begin:
        name, colon, value = data[begin : max(begin, stop)].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        begin = stop + 2
    return (fields, stop + 2) if fields.get("content-length", "").isdigit() else None


def revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``of``: the page that a page revisits, null where it is a response.

    Of pages with equal html of at least ``min_bytes`` bytes, that of the largest page_id is the response; null html
    counts as empty. Of rows that repeat this page_id too, each is a response.
    """
    base = need(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    base = base.withColumn("key", F.sha1("html"))
    last = base.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = spread_join(base, scratch.table(last, "last"), "key", 80, how="left")
    known = (F.octet_length("html") >= min_bytes) & (F.col("page_id") < F.col("last"))
    return own.select("page_id", "url", "html", F.when(known, F.col("last")).alias("of"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each page into archives in ``folder``; returns the list of files (path, bytes, records).

    Null html is an empty payload, null urls are about:blank, rows with a null page_id have a record without a number;
    an empty table writes no file. Each task attempt writes files of its own name; just those of committed attempts are listed.
    """
    create_folder(f"{folder}/data")

    def write(batches):
        import pyarrow as pa

        out, uri, size, n = None, "", 0, 0
        files = []
        for batch in batches:
            for page, url, html, of in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                payload = html.encode()
                data = record("response" if of is None else "revisit", page, url, payload, digest(payload), of)
                if out is not None and size + len(data) > file_bytes:
                    out.close()
                    files.append((uri, size, n))
                    out = None
                if out is None:
                    uri, size, n = f"{folder}/data/{uuid.uuid4().hex}.warc", 0, 0
                    store, path = filesystem(uri)
                    out = store.open_output_stream(path)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            files.append((uri, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), *[pa.array([f[i] for f in files], pa.int64()) for i in (1, 2)]], names=["path", "bytes", "records"])

    files = revisits(pages, Scratch(pages.sparkSession, "revisits"), min_bytes).mapInArrow(write, "path string, bytes long, records long")
    files.write.mode("overwrite").parquet(f"{folder}/files")
    return pages.sparkSession.read.schema("path string, bytes long, records long").parquet(f"{folder}/files")


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """A row for each byte range, dealt out evenly."""
    rows = files.select("path", "bytes").withColumn("range", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("bytes") / range_bytes).cast("int") - 1))))
    n = max(1, rows.count())
    return rows.repartition(min(n, 100_000), "path", "range")


def candidates(data: bytes, base: int, begin: int, end: int, size: int) -> dict[int, int]:
    """Places in [begin, end) that look like records, with their successors; ``data`` starts at ``base``, the file has ``size`` bytes."""
    found = {}
    for m in MAGIC.finditer(data, begin - base):
        at = base + m.start()
        if at >= end:
            break
        head = parse_head(data, m.start())
        if head:
            after = base + head[1] + int(head[0]["content-length"]) + len(END)
            if after <= size:
                found[at] = after
    return found


def _load(store, path: str, begin: int, end: int, size: int) -> bytes:
    """The bytes from ``begin`` to ``end``, and on to the end of a header that starts before ``end``."""
    with store.open_input_file(path) as f:
        data = f.read_at(min(size, end + HEADER_BYTES) - begin, begin)
        # A header has no empty line, so one that is open where the data ends starts after the last one.
        while begin + len(data) < size and MAGIC.search(data, data.rfind(END) + 1, end - begin + len(VERSION) + 2):
            data += f.read_at(min(size - begin - len(data), max(HEADER_BYTES, len(data))), begin + len(data))
        return data


def chains(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each candidate that can be a range's first record: the first offset beyond the range on its chain, and the records up to it.

    A chain enters a range at any of its candidates, so each candidate has a row.
    """

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                store, path = filesystem(r["path"])
                begin, end = r["range"] * range_bytes, min(r["bytes"], (r["range"] + 1) * range_bytes)
                found = candidates(_load(store, path, begin, end, r["bytes"]), begin, begin, end, r["bytes"])
                leave: dict[int, tuple[int, int]] = {}
                for at in sorted(found, reverse=True):
                    away, n = leave.get(found[at], (found[at], 0))
                    leave[at] = (away, n + 1)
                for at, (away, n) in leave.items():
                    rows.append((r["path"], r["range"], at, away, at == 0, n))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["path", "range", "offset", "exit", "entered", "records"])

    return _ranges(files, range_bytes).mapInArrow(scan, CHAIN)


def entries(files: DataFrame, scratch: Scratch, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, range, offset): where the chain from the file's start first enters each range, by pointer jumping.

    After round k a node's pointer skips 2^k ranges, and all nodes within 2^k ranges of a start are marked.
    """
    nodes = scratch.table(chains(files, range_bytes), "chain0")
    most = files.agg(F.max("bytes").alias("n")).first()["n"] or 0
    reached = nodes.where("entered").select("path", "offset")
    jumps, known = nodes.select("path", "offset", "exit"), nodes.select("path", "offset")
    k = 0
    while (range_bytes << k) < most:
        step = jumps.select("path", "offset", F.col("exit").alias("next"))
        more = reached.join(step, ["path", "offset"]).select("path", F.col("next").alias("offset"))
        more = more.join(known, ["path", "offset"], "left_semi")
        reached = scratch.table(reached.union(more).distinct(), f"reached{k + 1}")
        far = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        jumps = scratch.table(jumps.join(far, ["path", "exit"]).select("path", "offset", F.col("beyond").alias("exit")), f"jumps{k + 1}")
        k += 1
    counts = nodes.select("path", "offset", "records")
    return reached.join(counts, ["path", "offset"]).select("path", F.floor(F.col("offset") / range_bytes).cast("int").alias("range"), "offset", "records")


def read_warc(files: DataFrame, scratch: Scratch, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records that are reachable from their file's start, with payload, in any order.

    ``files``: path, bytes; with a column ``records``, a file of which another number can be reached makes the read fail. Payloads of revisits are empty; ``payload_bytes`` and ``payload_digest`` are those of the full payload.
    A response whose payload has another digest than its header says makes the read fail. A file that doesn't start with
    a record gives none; what follows a broken record is unreachable.
    """
    spark = files.sparkSession
    starts = scratch.table(entries(files, scratch, range_bytes), "entries")
    if "records" in files.columns:
        got = starts.groupBy(F.col("path").alias("p")).agg(F.sum("records").alias("n"))
        bad = files.join(got, F.col("path") == F.col("p"), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> records").first()
        if bad is not None:
            raise ValueError(f"{bad['path']}: {bad['records']} records written, {bad['n']} can be read")

    def read(batches):
        import pyarrow as pa

        names = ("path", "offset", "type", "record_id", "uri", "refers_to", "payload_digest", "payload_bytes", "page_id", "payload")
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for r in batch.to_pylist():
                store, path = filesystem(r["path"])
                begin, end, size = r["offset"], (r["range"] + 1) * range_bytes, r["bytes"]
                data = _load(store, path, begin, min(end, size), size)
                at, rows = begin, []
                while at < min(end, size):
                    head = parse_head(data, at - begin)
                    if head is None:
                        break
                    fields, block = head
                    n = int(fields["content-length"])
                    if block + n <= len(data):
                        payload = data[block : block + n]
                    else:  # the last record reaches beyond the range
                        with store.open_input_file(path) as f:
                            payload = f.read_at(n, begin + block)
                    name, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("warc-type", "")
                    if kind == "response" and name and digest(payload) != name:
                        raise ValueError(f"{r['path']} at {at}: the payload's digest isn't {name}")
                    number = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
                    rows.append((r["path"], at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), name or digest(payload), int(fields.get("x-payload-bytes", n)), int(number[1]) if number else None, payload))
                    at = begin + block + n + len(END)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=list(names))
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=list(names))

    sizes = files.select(F.col("path").alias("p"), "bytes")
    work = starts.join(sizes, F.col("path") == F.col("p")).select("path", "range", "offset", "bytes")
    n = max(1, starts.count())
    return work.repartition(min(n, 100_000), "path", "range").mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    scratch = Scratch(spark, "warc")
    return read_warc(write_warc(pages, scratch.root, min_bytes), scratch)
