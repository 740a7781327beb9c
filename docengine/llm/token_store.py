"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

File format, all integers little-endian::

    b"DTOK0001"
    for each document: one zstandard frame of its ids (unsigned 16-bit), made with the dictionary
    index: a zstandard frame of JSON {"doc_id": [...], "offset": [...], "size": [...], "tokens": [...]}
    footer, 60 bytes: index offset u64, index size u64, documents u32, SHA-256 of the dictionary (32 bytes),
                      b"DTOK0001"

A reader fetches the footer and the index, then just the frames that it needs. Documents are in
ascending order of doc_id in a file and from file to file (nulls first, equal ids by the text's hash); the
manifest table gives each file's order. Every task attempt writes a file of its own name and only
committed attempts come into the manifest, so retries and lost executors leave no wrong data.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, create_folder, filesystem, need
from .tokens import encoder, text_slices

MAGIC = b"DTOK0001"
FOOTER = "<QQI32s8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 1024
SAMPLE_CHARS = 20_000

MANIFEST = "shard int, path string, documents long, tokens long, bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; raw content where there are too few; empty without samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, byte_level: bool = True) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files into ``folder``; returns the manifest, written there too.

    Null and empty texts hold just ``end_id``; an empty table writes no file; repeated rows are kept;
    further columns are ignored. The dictionary is fitted on a bounded sample: about
    ``SAMPLE_DOCUMENTS`` documents of smallest id hash, without those of over ``SAMPLE_CHARS`` characters.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    docs = need(docs, "doc_id", "text")
    end = end_id.to_bytes(2, "little")
    share = SAMPLE_DOCUMENTS / max(SAMPLE_DOCUMENTS, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = chosen.where(F.char_length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_DOCUMENTS).collect()
    data = train_dictionary([x + end for x in encoder(tokenizer, byte_level).encode(pa.array([r.text for r in sample], pa.string()))])
    create_folder(f"{folder}/data")
    store, path = filesystem(f"{folder}/dictionary")
    with store.open_output_stream(path) as f:
        f.write(data)

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        compress = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data)).compress
        encode = encoder(tokenizer, byte_level).encode
        uri = f"{folder}/data/{uuid.uuid4().hex}.tok"
        out, at, total = None, len(MAGIC), 0
        index: dict[str, list] = {"doc_id": [], "offset": [], "size": [], "tokens": []}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts):
                if out is None:
                    out = filesystem(uri)[0].open_output_stream(filesystem(uri)[1])
                    out.write(MAGIC)
                for doc, raw in zip(ids[a:b], encode(texts.slice(a, b - a))):
                    out.write(frame := compress(raw + end))
                    n = len(raw) // 2 + 1
                    for k, v in zip(index, (doc, at, len(frame), n)):
                        index[k].append(v)
                    at, total = at + len(frame), total + n
        if out is not None:
            out.write(frame := zstandard.compress(json.dumps(index).encode()))
            out.write(struct.pack(FOOTER, at, len(frame), len(index["doc_id"]), hashlib.sha256(data).digest(), MAGIC))
            out.close()
            row = [TaskContext.get().partitionId(), uri, len(index["doc_id"]), total, at + len(frame) + FOOTER_BYTES]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "documents", "tokens", "bytes"), row))], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows that repeat an id are dealt out too
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """One file, opened for access to single documents."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, length, self.documents, digest, magic = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"made with another dictionary: {uri}")
        self.index = json.loads(zstandard.decompress(self.file.read_at(length, at)))
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, i: int):
        """Ids of the file's i-th document, a NumPy array."""
        import numpy as np

        return np.frombuffer(self.decompress(self.file.read_at(self.index["size"][i], self.index["offset"][i])), "<u2")

    def close(self) -> None:
        self.file.close()


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files in the manifest: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    store, path = filesystem(f"{folder}/dictionary")
    with store.open_input_stream(path) as f:
        dictionary = f.read()

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path, dictionary)
                rows, size = [], 0
                for i, doc in enumerate(f.index["doc_id"]):
                    ids = f.ids(i)
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                f.close()

    bases = manifest.select("shard", "path", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    return bases.repartition(max(1, manifest.count()), "shard").select("path", "base").mapInArrow(read, TOKENS)


def token_store(docs: DataFrame, tokenizer: str, end_id: int, byte_level: bool = True) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "token-store")
    return read_tokens(write_tokens(docs, scratch.root, tokenizer, end_id, byte_level), scratch.root)
