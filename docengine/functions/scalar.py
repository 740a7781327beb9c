"""Numeric, status and similarity functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

#: Progress in percent by stage.
PROGRESS = {"queued": 5, "parse_document": 15, "document_parsed": 25, "extract_requirements": 35, "requirements_extracted": 50, "evaluate_capabilities": 60, "capabilities_evaluated": 75, "generate_proposal": 85, "human_review": 95, "approved": 100}


def backoff(attempts: Column, first: float = DEFAULTS.backoff_first, most: float = DEFAULTS.backoff_most) -> Column:
    """Seconds before the next attempt: doubled with each one, the exponent held in 0 to 30."""
    exponent = F.least(F.lit(30), F.greatest(F.lit(0), attempts))
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), exponent))


def transport_delay(n: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), n), F.lit(8.0))


def restart_delay(failures: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(failures - 1, F.lit(5))), F.lit(30.0))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rrf(rank: Column, k: int = DEFAULTS.rrf_k) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def progress(stage: Column, status: Column) -> Column:
    steps = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.when(status.isin("APPROVED", "COMPLETED"), F.lit(100)).otherwise(F.coalesce(F.try_element_at(steps, stage), F.lit(0)))


def elapsed_seconds(begin: Column, end: Column) -> Column:
    """Whole seconds, never below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(begin)) / 1_000_000)).cast("long")


def duration_label(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def area_ratio(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A rectangle's share of its page, cut to the page."""
    w = F.greatest(F.lit(0.0), F.least(x1, width) - F.greatest(x0, F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least(y1, height) - F.greatest(y0, F.lit(0.0)))
    return w * h / (width * height)


def page_class(chars: Column, garbled: Column, coverage: Column, significant: Column, cfg=DEFAULTS) -> Column:
    """empty, scanned, mixed or text by characters, garbled ratio, image coverage and large images: the first rule that holds."""
    pictured = (coverage >= cfg.scanned_coverage) | significant
    return (
        F.when((chars == 0) & ~pictured, "empty")
        .when((garbled > cfg.garbled_ratio) | ((chars < cfg.min_text_chars) & pictured), "scanned")
        .when(coverage >= cfg.mixed_coverage, "mixed")
        .otherwise("text")
    )


def page_confidence(kind: Column, chars: Column, garbled: Column, coverage: Column, cfg=DEFAULTS) -> Column:
    strength = F.least(F.lit(1.0), chars / cfg.min_text_chars)
    return F.round(
        F.when(kind == "empty", F.lit(1.0))
        .when(kind == "scanned", F.greatest(F.lit(0.5), coverage, garbled))
        .when(kind == "mixed", F.greatest(F.lit(0.5), F.least(F.lit(1.0), (strength + coverage) / 2)))
        .otherwise(F.greatest(F.lit(0.5), (1 - garbled) * (0.8 + 0.2 * strength))),
        6,
    )
