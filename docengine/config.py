"""Default limits, thresholds and budgets of the engine. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    score_threshold: float = 0.25
    dense_prefetch: int = 40
    sparse_prefetch: int = 40
    fusion_limit: int = 30
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    upload_bytes: int = 50 << 20
    pdf_max_pages: int = 500
    min_text_chars: int = 20
    garbled_ratio: float = 0.10
    scanned_coverage: float = 0.60
    mixed_coverage: float = 0.35
    image_area: float = 0.02
    image_width: float = 0.20
    image_height: float = 0.08
    requirement_tokens: int = 1000
    requirement_overlap: int = 100
    requirement_chunks: int = 20
    chunk_chars: int = 1500
    chunk_overlap: int = 200
    parent_tokens: int = 1200
    child_tokens: int = 350
    child_overlap: int = 40
    embedding_dims: int = 1024
    embedding_batch: int = 64
    judge_batch: int = 8
    proposal_batch: int = 8
    evidence_chars: int = 1200
    relay_batch: int = 50
    backoff_first: float = 1.0
    backoff_most: float = 300.0


DEFAULTS = Settings()
