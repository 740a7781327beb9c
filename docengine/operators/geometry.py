"""Page geometry: the area that rectangles cover together, and page quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import scalar, text


def union_area(rectangles: DataFrame) -> DataFrame:
    """(page_id, coverage): the share of each page that ``rectangles`` (page_id, x0, y0, x1, y1, width, height) cover, 1 at most.

    The page is cut into vertical strips at all edges; in a strip the rectangles' heights are merged by a running maximum.
    """
    zero = F.lit(0.0)
    cut = rectangles.select("page_id", "width", "height", *[F.greatest(zero, F.least(F.col(c), F.col(m))).alias(c) for c, m in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))])
    cut = cut.where("x1 > x0 and y1 > y0")
    edges = cut.select("page_id", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    strips = edges.withColumn("right", F.lead("x").over(Window.partitionBy("page_id").orderBy("x"))).where("right is not null")
    inside = strips.join(cut, "page_id").where("x0 < right and x1 > x")
    before = Window.partitionBy("page_id", "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(zero, F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(before), zero)))
    parts = inside.withColumn("area", fresh * (F.col("right") - F.col("x")))
    return parts.groupBy("page_id").agg(F.round(F.least(F.lit(1.0), F.sum("area") / F.max(F.col("width") * F.col("height"))), 6).alias("coverage"))


def page_quality(pages: DataFrame, images: DataFrame, cfg: Settings = DEFAULTS, texts: DataFrame | None = None) -> DataFrame:
    """Type, confidence and measures of ``pages`` (page_id, text) with ``images`` and ``texts``, the boxes of text (page_id, x0, y0, x1, y1, width, height).

    Coverages are shares of the page: of all images, of the significant ones, and of text boxes (0 where none are given).
    """
    sized = images.withColumn("area", scalar.area_ratio(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")]))
    large = (F.col("area") >= cfg.image_area) & ((F.col("x1") - F.col("x0")) / F.col("width") >= cfg.image_width) & ((F.col("y1") - F.col("y0")) / F.col("height") >= cfg.image_height)
    facts = sized.groupBy("page_id").agg(F.count_if(large).alias("significant"), F.round(F.max("area"), 6).alias("largest"))
    x = F.coalesce("text", F.lit(""))
    rows = pages.withColumn("visible", text.visible_count(x)).withColumn("garbled_chars", text.garbled_count(x)).withColumn("words", text.word_count(x))
    rows = rows.withColumn("chars", F.col("visible") - F.col("garbled_chars")).withColumn("garbled", F.when(F.col("visible") > 0, F.col("garbled_chars") / F.col("visible")).otherwise(F.lit(0.0)))
    rows = rows.join(facts, "page_id", "left").join(union_area(images), "page_id", "left")
    rows = rows.join(union_area(sized.where(large)).withColumnRenamed("coverage", "significant_coverage"), "page_id", "left")
    rows = rows.withColumn("text_coverage", F.lit(None).cast("double")) if texts is None else rows.join(union_area(texts).withColumnRenamed("coverage", "text_coverage"), "page_id", "left")
    rows = rows.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("significant", F.coalesce("significant", F.lit(0)))
    kind = scalar.page_class(F.col("chars"), F.col("garbled"), F.col("coverage"), F.col("significant") > 0, cfg)
    rows = rows.withColumn("page_type", kind).withColumn("requires_ocr", F.col("page_type").isin("scanned", "mixed"))
    return rows.select("page_id", "page_type", scalar.page_confidence(F.col("page_type"), F.col("chars"), F.col("garbled"), F.col("coverage"), cfg).alias("confidence"), "requires_ocr", "chars", "words", F.round("garbled", 6).alias("garbled_ratio"), "coverage", "significant", F.coalesce("largest", F.lit(0.0)).alias("largest_image"), F.coalesce("significant_coverage", F.lit(0.0)).alias("significant_coverage"), F.coalesce("text_coverage", F.lit(0.0)).alias("text_coverage"))


def document_type(pages: DataFrame) -> DataFrame:
    """text_based, scanned or mixed by ``pages`` (doc_id, page_type); empty pages don't count."""
    n = F.count_if(F.col("page_type") != "empty")
    of = lambda t: F.count_if(F.col("page_type") == t)
    return pages.groupBy("doc_id").agg(F.when(n == of("text"), "text_based").when(n == of("scanned"), "scanned").otherwise("mixed").alias("document_type"))


def preflight(files: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """``files`` (path, is_pdf, encrypted, pages) with the first error that applies."""
    code = F.when(~F.col("is_pdf"), "NOT_A_PDF").when(F.col("encrypted"), "ENCRYPTED").when(F.col("pages") == 0, "NO_PAGES").when(F.col("pages") > cfg.pdf_max_pages, "TOO_MANY_PAGES")
    return files.withColumn("error_code", code)
