"""Text, hash and identity functions as columns. Python's Unicode rules are followed where they differ from Spark's."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

UNIT, RECORD = "\u001f", "\u001e"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: What Python's str.strip and str.split take for space.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def squeeze(x: Column) -> Column:
    """Words joined by one space."""
    return F.array_join(F.filter(F.split(x, f"{SPACE}+"), lambda w: w != ""), " ")


@F.pandas_udf(StringType())
def _casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    import unicodedata

    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def beyond_ascii(x: Column) -> Column:
    """``x`` where it has a sign beyond ASCII, else null: what Python's Unicode rules have to see."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), x)


def casefold(x: Column) -> Column:
    """Python's casefold. ASCII text is lower-cased in the JVM and doesn't go to Python."""
    return F.coalesce(_casefold(beyond_ascii(x)), F.lower(x))


def nfkc(x: Column) -> Column:
    """Unicode's NFKC form. ASCII text has it already and doesn't go to Python."""
    return F.coalesce(_nfkc(beyond_ascii(x)), x)


def clean_lines(x: Column) -> Column:
    """Line ends as LF, no space at line ends, one empty line at most between lines, none around the text."""
    unix = F.regexp_replace(x, "\r\n|\r", "\n")
    flat = F.regexp_replace(unix, f"[\\t\\x0B\\f \\x{{A0}}\\x{{3000}}]+(?=\n|\\z)", "")
    return strip(F.regexp_replace(flat, "\n{3,}", "\n\n"))


def clean_text(x: str) -> str:
    """``clean_lines`` of the NFKC form, in Python."""
    x = x if x.isascii() else unicodedata.normalize("NFKC", x)
    x = "\n".join(line.rstrip("\t\x0b\f \xa0\u3000") for line in x.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return (_BLANKS.sub("\n\n", x) if "\n\n\n" in x else x).strip()


def document_hash(x: Column, compose: bool = True) -> Column:
    """SHA-256 of the normalized text. ``compose=False`` leaves out NFKC for text known to be composed: no Python then."""
    return sha256(clean_lines(nfkc(x) if compose else x))


def fingerprint(x: Column) -> Column:
    """The identity of a requirement's wording."""
    return sha256(casefold(squeeze(x)))


def uuid5(name: Column) -> Column:
    """Version 5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def embedding_hash(model: Column, dims: Column, text: Column) -> Column:
    return sha256(F.concat_ws(UNIT, model, dims.cast("string"), text))


def structural_hash(block_types: Column, path: Column, source_type: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return sha256(F.to_json(F.struct(block_types.alias("block_types"), path.alias("section_path"), source_type.alias("source_type"))))


def parent_anchor(source_type: Column, path: Column, block_types: Column, content_hash: Column) -> Column:
    return sha256(F.concat_ws(UNIT, source_type, F.array_join(path, RECORD), F.array_join(block_types, RECORD), content_hash))


def section_id(path: Column, page: Column) -> Column:
    """section: and 16 hex digits of the hash of the path, else of the page, else of the document."""
    where = F.when(F.size(path) > 0, casefold(F.array_join(path, " > "))).otherwise(F.coalesce(F.concat(F.lit("page:"), page.cast("string")), F.lit("document")))
    return F.concat(F.lit("section:"), F.substring(sha256(where), 1, 16))


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(x) / 4)).cast("long")


def context_prefix(title: Column, version: Column, path: Column, text: Column) -> Column:
    """Document, version and section lines before a chunk's text; what is null or empty has no line."""
    section = F.array_join(path, " > ")
    head = F.concat_ws("\n", F.concat(F.lit("Document: "), title), F.concat(F.lit("Version: "), F.nullif(version, F.lit(""))), F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))))
    return F.concat_ws("\n\n", head, text)


def lexical_tokens(x: Column) -> Column:
    """Latin terms, and single CJK signs and pairs; the whole text where there are none."""
    low = F.lower(strip(nfkc(x)))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9._+/#\-]*"), 0)
    runs = F.regexp_extract_all(low, F.lit(r"[\x{3400}-\x{9FFF}]+"), 0)
    ones = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    twos = F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) > 1, F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    every = F.concat(latin, ones, twos)
    return F.when(F.size(every) > 0, every).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))


#: Signs that a Latin term may have after its first; each byte as it stands in a term (Latin letters in lower case), all others as a space.
_SIGNS = b"._+/#-"
_GAPS = [b" " + bytes([c]) for c in _SIGNS]
_TERM = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz0123456789" + _SIGNS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BLANKS = re.compile("\n{3,}")
_CJK = re.compile("[\u3400-\u9fff]+")


def latin_terms(x: Column) -> Column:
    """Latin terms alone, of the text as it is. The two signs beyond ASCII whose lower case is a Latin letter count as that letter."""
    return F.regexp_extract_all(F.lower(F.translate(x, "\u0130\u212a", "ik")), F.lit(r"[a-z0-9][a-z0-9._+/#\-]*"), 0)


def latin_tally(x: bytes) -> dict[bytes, int]:
    """How often each of ``latin_terms`` occurs in a UTF-8 text: a term is a run of its signs from the first letter or digit on."""
    if not x.isascii():
        x = x.replace("\u0130".encode(), b"i").replace("\u212a".encode(), b"k")
    x = b" " + x.translate(_TERM)
    counts = Counter(x.split())
    if any(gap in x for gap in _GAPS):
        for w in [w for w in counts if w[0] in _SIGNS]:
            n, bare = counts.pop(w), w.lstrip(_SIGNS)
            if bare:
                counts[bare] += n
    return counts


def lexical_tally(x: bytes) -> dict[bytes, int]:
    """How often each of ``lexical_tokens`` occurs in a UTF-8 text."""
    if x.isascii():
        return latin_tally(x) or ({low: 1} if (low := x.decode().strip().lower().encode()) else {})
    low = unicodedata.normalize("NFKC", x.decode()).strip().lower()
    counts = Counter(latin_tally(low.encode()))
    for run in _CJK.findall(low):
        counts.update(c.encode() for c in run)
        counts.update(run[i : i + 2].encode() for i in range(len(run) - 1))
    return counts or ({low.encode(): 1} if low else {})


@F.pandas_udf(LongType())
def token_id(token: pd.Series) -> pd.Series:
    """An unsigned 32-bit id by BLAKE2b."""
    import hashlib

    return token.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big"))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\w+")).cast("long")


def garbled_count(x: Column) -> Column:
    """Replacement, control and surrogate characters that aren't space."""
    return F.regexp_count(F.regexp_replace(x, r"(?U)\s", ""), F.lit(r"[\x{FFFD}\p{Cc}\p{Cs}]")).cast("long")


def visible_count(x: Column) -> Column:
    return F.char_length(F.regexp_replace(x, r"(?U)\s", "")).cast("long")


def item_id(x: Column) -> Column:
    """A leading item number such as B-001, or null."""
    return F.nullif(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]*-\d{2,})\b", 1), F.lit(""))


def markdown_cell(x: Column) -> Column:
    """Stripped, bars escaped, lines joined by a space: each line break, as Python splits lines, becomes one."""
    return F.replace(F.regexp_replace(strip(x), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", " "), F.lit("|"), F.lit("\\|"))


def ascii_name(x: Column) -> Column:
    """A file name of ASCII letters, digits, dot, dash and underscore, at most 200."""
    safe = F.regexp_replace(x, r"[^A-Za-z0-9._\-]+", "_")
    return F.substring(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), 1, 200)


def unicode_name(x: Column) -> Column:
    safe = F.regexp_replace(x, r"(?U)[^\w.\-]+", "_")
    return F.substring(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), 1, 80)


#: Content types by extension.
CONTENT_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "md": "text/markdown", "markdown": "text/markdown"}


def content_type(name: Column, told: Column) -> Column:
    """The content type that an upload tells, or that of its extension where it tells none or just bytes; null for unknown extensions."""
    by = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    extension = F.regexp_extract(F.lower(name), r"[.]([a-z0-9]+)$", 1)
    return F.coalesce(F.nullif(F.nullif(told, F.lit("")), F.lit("application/octet-stream")), F.try_element_at(by, extension))


def code(x: Column) -> Column:
    """A customer's or product's code as it is kept: upper case."""
    return F.upper(x)


def category(x: Column) -> Column:
    """A category as it is compared: stripped, lower case."""
    return F.lower(strip(x))


def or_default(x: Column, default: Column) -> Column:
    """``x`` unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default)
