"""Model steps behind plain functions over batches, with deterministic offline defaults.

A model is a function from a list of inputs to a list of as many outputs; a real one is put in by its function. Batches that it
refuses (wrong count, bad keys) are tried once more and then halved, down to single items, which fail with an error code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """A unit vector of hashed words: equal texts are equal, texts that share words are near."""
    import hashlib
    import math

    v = [0.0] * dims
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, batch: int = DEFAULTS.embedding_batch) -> DataFrame:
    """``chunks`` (chunk_id, embedding_text) with ``vector``, in batches of ``batch``."""
    work = model or (lambda texts: [hash_embedding(t) for t in texts])

    def run(frames):
        for f in frames:
            texts, out = f["embedding_text"].tolist(), []
            for i in range(0, len(texts), batch):
                got = work(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("as many vectors as texts are needed")
                out += got
            f = f[["chunk_id"]].copy()
            f["vector"] = out
            yield f

    return chunks.select("chunk_id", "embedding_text").mapInPandas(run, "chunk_id string, vector array<double>")


def covered(expected: list[str], got: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(missing, unknown, duplicate) keys, sorted."""
    return sorted(set(expected) - set(got)), sorted(set(got) - set(expected)), sorted({g for g in got if got.count(g) > 1})


def judge_batch(items: list[dict], model: Callable[[list[dict]], list[dict]], tries: int = 2) -> list[dict]:
    """Judgments of all items by key ``requirement_key``; a refused batch is tried again, then halved."""
    if not items:
        return []
    keys = [i["requirement_key"] for i in items]
    for _ in range(tries):
        got = model(items)
        if not any(covered(keys, [g["requirement_key"] for g in got])):
            by = {g["requirement_key"]: g for g in got}
            return [by[k] for k in keys]
    if len(items) == 1:
        return [{"requirement_key": keys[0], "status": "ERROR", "reason": "the model's answer doesn't cover the item"}]
    half = len(items) // 2
    return judge_batch(items[:half], model, tries) + judge_batch(items[half:], model, tries)


def rule_judge(items: list[dict]) -> list[dict]:
    """The offline judge: supported where evidence has a score of at least one half."""
    return [{"requirement_key": i["requirement_key"], "status": "SUPPORTED" if (i["score"] or 0) >= 0.5 else "NEED_REVIEW", "reason": f"score {i['score'] or 0:.3f}"} for i in items]


def judge(requirements: DataFrame, model: Callable[[list[dict]], list[dict]] = rule_judge, batch: int = DEFAULTS.judge_batch) -> DataFrame:
    """``requirements`` (requirement_key, score) with status and reason."""

    def run(frames):
        import pandas as pd

        for f in frames:
            items = f[["requirement_key", "score"]].to_dict("records")
            rows = [r for i in range(0, len(items), batch) for r in judge_batch(items[i : i + batch], model)]
            yield pd.DataFrame(rows, columns=["requirement_key", "status", "reason"])

    return requirements.select("requirement_key", "score").mapInPandas(run, "requirement_key string, status string, reason string")


def citations(judgments: DataFrame) -> DataFrame:
    """``judgments`` (requirement_key, status, available, selected: arrays) with the first error of their citations."""
    code = (
        F.when(F.size(F.array_distinct("available")) < F.size("available"), "DUPLICATE_AVAILABLE")
        .when(F.size(F.array_distinct("selected")) < F.size("selected"), "DUPLICATE_SELECTED")
        .when(F.size(F.array_except("selected", "available")) > 0, "UNKNOWN_SELECTED")
        .when((F.col("status") != "NEED_REVIEW") & (F.size("selected") == 0), "NOTHING_SELECTED")
    )
    return judgments.withColumn("error_code", code)
