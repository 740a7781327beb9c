"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ids_of(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def token_store(docs):
    encode, at, out = ids_of("byte_bpe_50k.json"), 0, []

    def signed(text):  # XXH64 with seed 42; null's is the seed
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = [*encode(text), 0]
        out.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def warc(pages):
    last: dict[str, int] = {}
    for page, html in pages:
        if page is not None:
            last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, html in pages:
        b, of = (html or "").encode(), last.get(html or "")
        revisit = page is not None and page < of
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    return out


def check_packing(docs, pieces, window: int = 4096) -> int:
    """Asserts what must hold for ``pieces`` (doc_id, start, length, crc, doc_tokens, sequence, offset) of distinct ids; returns the padding."""
    encode = ids_of("word_bpe_49k.json")
    ids = {d: [*encode(t), 2] for d, t in docs}
    at = dict.fromkeys(ids, 0)
    for doc, start, length, c, n, _, _ in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == at[doc] and n == len(ids[doc]) and c == crc(ids[doc][start : start + length])
        at[doc] += length
    assert all(at[d] == len(ids[d]) for d in ids)
    padding, fill = 0, Counter()
    for p in sorted(pieces, key=lambda p: (p[5], p[6])):
        assert p[6] == fill[p[5]]
        fill[p[5]] += p[2]
    for n in fill.values():
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert sorted(fill) == list(range(len(fill)))
    return padding


def simhash(text: str | None, size: int = 4) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items: dict, radius: int = 4) -> dict:
    """Smallest id that each reaches; ``items``: id -> fingerprint."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(items)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if (items[a] ^ items[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def remove_repeats(texts: list, window: int = 35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def nearest(vectors: dict, every: int = 20, k: int = 20):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            scores = [(-float((np.array(v) * np.array(x)).sum()), i) for i, x in vectors.items() if i != q]
            out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5) -> dict:
    """Targets by source: the excess over twice a source's size is dealt out again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return got | {s: left * weight[s] / total for s in free}
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
            free.remove(s)
    return got


def taken(sizes: dict, target: dict, block: int) -> dict:
    """Words that each source gives: as many blocks as points of the golden ratio fall into its part of the circle, at most twice its size."""
    order = [s for s in sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes) if target[s] > 0]
    total, high, edge = sum(target.values()), 0.0, []
    for s in order:
        high += target[s]
        edge.append(high / total * (1 << 31))
    got = dict.fromkeys(sizes, 0)
    for i in range(int(total / block + 0.5)):
        point = i * 1327217885 % (1 << 31)
        got[order[next((k for k, e in enumerate(edge[:-1]) if point < e), len(edge) - 1)]] += block
    return {s: min(got[s], 2 * sizes[s]) for s in sizes}


def merkle(text: str):
    """(root, set of leaf hashes) by walking the text word by word."""
    import re

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf_texts(paragraph: str):
        out, at = [], 0
        while at < len(paragraph):
            space = re.compile(r"\s+", re.A).match(paragraph, at)
            if space:
                end = space.end()
            else:
                end, n = at, 0
                while True:  # up to four words; a sentence's end or a line's ends the leaf
                    word = re.compile(r"\S+", re.A).match(paragraph, end)
                    gap = re.compile(r"[^\S\n]+", re.A).match(paragraph, word.end())
                    after = gap and re.compile(r"\S", re.A).match(paragraph, gap.end())
                    n += 1
                    if n == 4 or not after or word[0][-1] in ".!?":
                        end = re.compile(r"\s*", re.A).match(paragraph, word.end()).end()
                        break
                    end = gap.end()
            out.append(paragraph[at:end])
            at = end
        return out

    sections, known = [], set()
    for section in re.findall(r"(?s).+?(?:\n[ \t\r]*(?=\n)(?:\s*\n)?|\Z)", text, re.A):
        paragraphs = []
        for paragraph in re.findall(r"[^\n]*\n|[^\n]+\Z", section):
            hashes = [sha("leaf:" + x) for x in leaf_texts(paragraph)]
            known.update(hashes)
            paragraphs.append(sha("node:" + "".join(hashes)))
        sections.append(sha("node:" + "".join(paragraphs)))
    return sha("node:" + "".join(sections)), known


def alike(a, b) -> float:
    if a[0] == b[0]:
        return 1.0
    total = len(a[1]) + len(b[1])
    return 2 * len(a[1] & b[1]) / total if total else 0.0
