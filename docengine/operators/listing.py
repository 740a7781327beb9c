"""Lists with filters, search and pages, and the duplicates of an ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def matching(rows: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """``rows`` of which one of ``columns`` holds ``term``, signs such as % and _ taken as they are; all for a null or blank term."""
    term = (term or "").strip()
    if not term:
        return rows
    return rows.where(reduce(Column.__or__, [F.coalesce(F.col(c).contains(F.lit(term)), F.lit(False)) for c in columns]))


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """``rows`` whose columns have the wanted value, or one of the wanted values; None asks for nothing."""
    for column, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(column).isin(*value))
        elif value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The page of ``rows`` in ``order``, and the total (n) of all. The order needs a unique tie-break; Spark takes the top of each partition first."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("n"))


def ingest(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``duplicate_of``, the smallest earlier id of an equal file or, failing that, of equal normalized content, and ``reason`` (CHECKSUM, CONTENT); null for the first of each.

    Equal files are counted within each task first, so a file of any number of copies lands as one row. Null texts equal each other.
    A text is hashed in one pass over an Arrow batch, and only the hashes are shuffled.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_hashes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, checksum binary, content binary")
    files = rows.groupBy("checksum", "content").agg(F.min("doc_id").alias("first"))
    contents = files.groupBy("content").agg(F.min("first").alias("first_content"))
    known = files.join(contents, "content").select(F.col("checksum").alias("c"), "first", "first_content")
    both = rows.select("doc_id", "checksum").join(known, F.col("checksum") == F.col("c"))
    reason = F.when(F.col("first") < F.col("doc_id"), "CHECKSUM").when(F.col("first_content") < F.col("doc_id"), "CONTENT")
    of = F.when(F.col("first") < F.col("doc_id"), F.col("first")).when(F.col("first_content") < F.col("doc_id"), F.col("first_content"))
    return both.select("doc_id", of.alias("duplicate_of"), reason.alias("reason"))


def _hashes(batches):
    """SHA-256 of each text's bytes and of its clean form; no bytes for a null text."""
    from hashlib import sha256

    import pyarrow as pa

    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(1)]
        checksum = [b"" if t is None else sha256(t).digest() for t in texts]
        content = [b"" if t is None else sha256(text.clean_text(t.decode()).encode()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(checksum, pa.binary()), pa.array(content, pa.binary())], names=["doc_id", "checksum", "content"])
