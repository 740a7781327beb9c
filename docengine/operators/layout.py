"""Positioned page blocks as nodes of the hierarchy, or as character chunks of a page and section.

``blocks``: doc_id, page_number, block_id, type, text, html, reading_order, bbox, kept, as made by ``sources.files.layout_blocks``.
Headers and footers are left out, titles are the outline (level 3 unless a column ``heading_level`` says otherwise).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..sources.files import table_markdown
from . import chunks
from .blocks import Outline

FIGURES = ("table", "image")
ATOMIC = ("table", "image", "formula")
NODES = "doc_id long, position int, node_id string, node_type string, text string, section_path array<string>, page_start int, page_end int, block_ids array<string>, atomic boolean"
CHUNKS = "doc_id long, position int, text string, page_number int, section_path array<string>, block_types array<string>, block_ids array<string>, parent_id string"


@dataclass
class Block:
    block_id: str
    kind: str
    text: str
    page: int
    path: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    first_page: int = 0


def read_blocks(frame) -> list[Block]:
    """A document's blocks in reading order with their section path; titles, headers, footers and empty blocks are gone."""
    outline, out = Outline(), []
    levels = frame["heading_level"] if "heading_level" in frame else [None] * len(frame)
    rows = sorted(zip(frame["page_number"], frame["reading_order"], frame["block_id"], frame["type"], frame["text"], frame["html"], levels), key=lambda r: r[:2])
    for page, _, name, kind, body, html, level in rows:
        text = (table_markdown(html) if kind == "table" and html else body or "").strip()
        if kind == "title":
            outline.enter(int(level) if level and 1 <= level <= 6 else 3, text)
        elif text and kind not in ("header", "footer"):
            out.append(Block(name, kind, text, int(page), outline.path, [name], [kind], int(page)))
    return out


def nodes(blocks: list[Block]) -> list[Block]:
    """Captions go before the table or image right after them, on the next page too; other captions stand alone."""
    out: list[Block] = []
    for b in blocks:
        last = out[-1] if out else None
        if last and last.kind == "caption" and b.kind in FIGURES:
            out[-1] = Block(b.block_id, b.kind, f"{last.text}\n\n{b.text}", b.page, b.path, last.ids + b.ids, last.kinds + b.kinds, b.page)
        else:
            out.append(b)
    return out


def structural(blocks: list[Block], size: int) -> list[Block]:
    """Blocks of one page and section joined while they fit; a caption starts anew, and goes before any atomic block of its page and section."""
    out: list[Block] = []
    open_ = False  # whether the last one may take more
    for b in blocks:
        last = out[-1] if open_ else None
        near = last is not None and (last.page, last.path) == (b.page, b.path)
        joined = Block(b.block_id, b.kind, f"{last.text}\n\n{b.text}", b.page, b.path, last.ids + b.ids, list(dict.fromkeys(last.kinds + b.kinds))) if near else None
        if b.kind in ATOMIC:
            if joined and last.kinds == ["caption"]:
                out[-1] = joined
            else:
                out.append(b)
            open_ = False
        elif joined and b.kind != "caption" and len(joined.text) <= size:
            out[-1] = joined
        else:
            out.append(b)
            open_ = True
    return out


def to_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes of each document; its blocks, bounded by its length, meet in one call."""

    def run(frame):
        import pandas as pd

        doc = frame["doc_id"].iloc[0]
        rows = [(doc, i, n.block_id, n.kind, n.text, n.path, n.first_page, n.page, n.ids, n.kind in ATOMIC) for i, n in enumerate(nodes(read_blocks(frame)))]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(", ", NODES)])

    return blocks.where("kept").groupBy("doc_id").applyInPandas(run, NODES)


def to_chunks(blocks: DataFrame, title: str | None = None, version: str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Character chunks with context lines; large tables are split with their head, other text by windows."""

    def run(frame):
        import hashlib

        import pandas as pd

        doc, rows = frame["doc_id"].iloc[0], []
        for b in structural(read_blocks(frame), cfg.chunk_chars):
            parts = [b.text] if len(b.text) <= cfg.chunk_chars else ("table" in b.kinds and chunks.split_table(b.text, cfg.chunk_chars)) or chunks.windows(b.text, cfg.chunk_chars, cfg.chunk_overlap)
            head = "\n".join([f"{k}: {v}" for k, v in (("Document", title), ("Version", version), ("Section", " > ".join(b.path))) if v])
            parent = "section:" + hashlib.sha256((" > ".join(b.path).casefold() or f"page:{b.page}").encode()).hexdigest()[:16]
            rows += [(doc, len(rows) + i, f"{head}\n\n{p}" if head else p, b.page, b.path, b.kinds, b.ids, parent) for i, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(", ", CHUNKS)])

    return blocks.where("kept").groupBy("doc_id").applyInPandas(run, CHUNKS)


def marked_pages(docs: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, position, page, piece) of texts with page marks: windows of each page's section; an error row where nothing is left."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = [(page, w) for page, section in chunks.pages(text or "") for w in chunks.windows(section, cfg.chunk_chars, cfg.chunk_overlap)]
                rows += [(doc, i, page, w, None) for i, (page, w) in enumerate(found)] or [(doc, None, None, None, "NO_TEXT")]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "page", "piece", "error_code"]).astype({"position": "Int32", "page": "Int32"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, position int, page int, piece string, error_code string")
