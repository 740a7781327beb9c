"""Markdown blocks: a line scanner, and its use over a table of documents.

Blocks are found in this order at each line: fence, ATX heading, setext heading, table, blank line, rule, list or text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The line patterns of the block types.
FENCE = re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})")
ATX = re.compile(r" {0,3}(?P<level>#{1,6})(?:[ \t]+(?P<title>.*))?$")
SETEXT = re.compile(r" {0,3}(?P<mark>=+|-+)\s*$")
RULE = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
ITEM = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+\S")
DASHES = re.compile(r":?-{3,}:?")

UNITS = "doc_id long, position int, block_id string, block_type string, text string, section_path array<string>, line_start int, line_end int, atomic boolean"


@dataclass
class Unit:
    block_type: str
    text: str
    path: list[str]
    line_start: int
    line_end: int

    @property
    def atomic(self) -> bool:
        return self.block_type in ("code", "table")


class Outline:
    """The headings above the current line: a heading of a level ends those of its level and deeper ones."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> None:
        title = re.sub(r"[ \t]+#+[ \t]*$", "", title).strip()
        if title:
            self.levels = [x for x in self.levels if x[0] < level] + [(level, title)]

    @property
    def path(self) -> list[str]:
        return [t for _, t in self.levels]


def is_separator(line: str) -> bool:
    """Whether a line parts a table's head from its rows: two columns at least."""
    inner = line.strip().strip("|")
    return "|" in inner and all(DASHES.fullmatch(c.strip().replace(" ", "")) for c in inner.split("|"))


def _spans(lines: list[str], outline: Outline) -> Iterator[tuple[str, int, int]]:
    """(type, first line, line after the last) of code, tables and single lines of lists and text; ("", i, i + 1) ends what runs on."""
    i = 0
    while i < len(lines):
        line, after = lines[i], lines[i + 1] if i + 1 < len(lines) else None
        if fence := FENCE.match(line):
            mark = fence["mark"]
            shut = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            end = next((j + 1 for j in range(i + 1, len(lines)) if shut.match(lines[j])), len(lines))
            kind = "code"
        elif heading := ATX.match(line):
            yield "", i, i + 1
            outline.enter(len(heading["level"]), heading["title"] or "")
            i += 1
            continue
        elif after is not None and line.strip() and (under := SETEXT.match(after)):
            yield "", i, i + 2
            outline.enter(1 if under["mark"][0] == "=" else 2, line.strip())
            i += 2
            continue
        elif after is not None and "|" in line and is_separator(after):
            end = next((j for j in range(i + 2, len(lines)) if not lines[j].strip() or "|" not in lines[j]), len(lines))
            kind = "table"
        elif not line.strip() or RULE.match(line):
            end, kind = i + 1, ""
        else:
            end, kind = i + 1, "list" if ITEM.match(line) else "text"
        yield kind, i, end
        i = end


def parse(text: str) -> list[Unit]:
    """The blocks of a text; runs of list lines and of text lines are a block each."""
    lines, outline = text.splitlines(), Outline()
    units: list[Unit] = []
    run: list[int] = []
    kind, path = "", []

    def close() -> None:
        if run and (body := "\n".join(lines[run[0] : run[-1] + 1]).strip()):
            units.append(Unit(kind, body, path, run[0] + 1, run[-1] + 1))
        run.clear()

    for found, begin, end in _spans(lines, outline):
        if found in ("list", "text"):
            if run and found != kind:
                close()
            kind, path = found, outline.path
            run.append(begin)
            continue
        close()
        if found and (body := "\n".join(lines[begin:end]).strip()):
            units.append(Unit(found, body, outline.path, begin + 1, end))
    close()
    return units


def group(units: list[Unit], size: int) -> list[Unit]:
    """Neighbouring blocks of a section joined by blank lines while they fit ``size`` characters; code and tables stand alone."""
    out: list[Unit] = []
    for u in units:
        last = out[-1] if out else None
        if last and not last.atomic and not u.atomic and last.path == u.path and len(last.text) + 2 + len(u.text) <= size:
            kinds = "+".join(dict.fromkeys([last.block_type, u.block_type]))
            out[-1] = Unit(kinds, f"{last.text}\n\n{u.text}", last.path, last.line_start, u.line_end)
        else:
            out.append(u)
    return out


def units(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text), one row each; null texts have none."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(d, i, f"md_b{i + 1:04d}", u.block_type, u.text, u.path, u.line_start, u.line_end, u.atomic) for d, t in zip(batch["doc_id"], batch["text"]) if t for i, u in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "block_id", "block_type", "text", "section_path", "line_start", "line_end", "atomic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, UNITS)
