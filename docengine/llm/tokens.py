"""Fast exact encoding with the ``tokenizers`` library: each distinct piece is encoded once.

Both public BPE files split a text before any merge, and never across a single space between
two characters that aren't space. A text is therefore cut at those spaces, and each distinct piece
goes through the library once per worker; its ids are kept as little-endian unsigned 16-bit bytes
in a bounded cache. Texts with other space patterns go through the library as a whole where the
byte-level rule needs it.
"""

from __future__ import annotations

import json
import os


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()
#: Words of letters; below U+0180, and but for U+0130, composing changes nothing and lower case is one letter for each.
ANY_WORD = r"^\p{L}+$"
SAFE_WORD = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+$"
#: ASCII's marks, and runs of them.
SIGNS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
MARKS = r"[!-/:-@\[-`{-~]{0,8}"
#: Pieces in a generation of a worker's cache.
CACHE_ENTRIES = 500_000


#: Runs of marks that an encoder knows at most, but for those of one call.
MARKED = 50_000


def strings(array) -> list[str]:
    """The values of an Arrow string array without nulls."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``byte_level``: a piece keeps the space before it (GPT-2 rule); else spaces are dropped."""

    def __init__(self, path: str, byte_level: bool, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need 16 bits at most")
        self.byte_level, self.entries = byte_level, entries
        self.word = ANY_WORD if byte_level else SAFE_WORD
        self.compound = rf"^{self.word[1:-1]}{MARKS}(\n{self.word[1:-1]}{MARKS})?$"
        #: Ids of runs of marks, and of a line break.
        self.marks: dict[str, bytes] = {}
        self.line = self._library(["\n"])[0]
        self.separator = None
        if not any(BYTE_SIGNS[0] in k for k in self.tokenizer.get_vocab() if len(k) > 1):
            self.separator = self.tokenizer.token_to_id(BYTE_SIGNS[0])
        # The same merges without any rule before them.
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if byte_level else None
        #: A cache by what stands before its pieces (a space or nothing), in two generations.
        self.known: dict[str, dict[str, bytes | None]] = {"": {}, " ": {}}
        self.old: dict[str, dict[str, bytes | None]] = {"": {}, " ": {}}

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cache: dict, pieces: list[str], before: str) -> None:
        """Put the ids of distinct new pieces into ``cache``; None where the piece has space at an end by the byte-level rule."""
        import pyarrow as pa
        import pyarrow.compute as pc

        new = pa.array(pieces, pa.string())
        # Letters, marks, and perhaps once more after a line break: by either rule each is a piece by itself, and nothing stands before the second word.
        ok = pc.match_substring_regex(new, self.compound)
        plain = pc.match_substring_regex(new, self.word)
        alone, joined = strings(new.filter(plain)), strings(new.filter(pc.and_not(ok, plain)))
        lines = [p.partition("\n") for p in joined]
        words, seconds = [a.rstrip(SIGNS) for a, _, _ in lines], [b.rstrip(SIGNS) for _, _, b in lines]
        ends, last = [a[len(w) :] for w, (a, _, _) in zip(words, lines)], [b[len(w) :] for w, (_, _, b) in zip(seconds, lines)]
        first = self._each([*alone, *words], cache, before)
        cache.update(first)
        marks, line = self.marks, self.line
        if len(marks) > MARKED:
            marks.clear()
        if unknown := list({*ends, *last} - marks.keys()):
            marks.update(zip(unknown, self._library(unknown)))
        second = self._each([w for w in seconds if w], self.known[""], "")
        cache.update([(p, first[w] + marks[e] + line + second[v] + marks[f] if v else first[w] + marks[e]) for p, w, e, v, f in zip(joined, words, ends, seconds, last)])
        rest = []
        for p in strings(new.filter(pc.invert(ok))):
            if not p or (self.byte_level and (p[0].isspace() or p[-1].isspace())):
                cache[p] = b"" if not p and not self.byte_level else None
            else:
                rest.append(p)
        for i in range(0, len(rest), 1024):
            cache.update(zip(rest[i : i + 1024], self._pieces([before + p for p in rest[i : i + 1024]])))

    def _each(self, words: list[str], cache: dict, before: str) -> dict[str, bytes]:
        """Ids of words of letters by word, from ``cache`` where it has them."""
        out = {w: cache.get(w) for w in words}
        new = [w for w, ids in out.items() if ids is None]
        for i in range(0, len(new), 512):
            out.update(zip(new[i : i + 512], self._words(new[i : i + 512], before)))
        return out

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters by the library's model: for these its normalizer is ``lower`` or nothing."""
        import numpy as np

        if not self.byte_level:
            tokenize = self.tokenizer.model.tokenize
            signs = "\0".join(words).lower().encode().decode("latin-1").translate(BYTE_SIGNS).split(BYTE_SIGNS[0])
            ids = [[t.id for t in tokenize(w)] for w in signs]
            ends = np.cumsum([len(x) for x in ids])
            data = np.array([i for x in ids for i in x], dtype="<u2").tobytes()
            cuts = [0, *(2 * ends).tolist()]
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if self.separator is None:
            return self._pieces([before + w for w in words])
        # No token but its own holds the sign of byte 0: words that it separates are merged each by itself.
        text = before + ("\0" + before).join(words)
        signs = text.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = np.array(self.bare.encode_batch_fast([signs], add_special_tokens=False)[0].ids, dtype="<u2")
        cuts = [-1, *np.flatnonzero(ids == self.separator).tolist(), len(ids)]
        data = ids.tobytes()
        return [data[2 * a + 2 : 2 * b] for a, b in zip(cuts, cuts[1:])]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by itself, in one call."""
        import numpy as np

        e = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u2").tobytes()
        ends = 2 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(pieces)), side="right")
        out, a = [], 0
        for b in ends.tolist():
            out.append(ids[a:b])
            a = b
        return out

    def _lookup(self, pieces: list[str], before: str) -> list[bytes | None]:
        """Ids of the pieces. When a generation is full, it becomes the old one; what is met again moves on to the new one."""
        cache, old = self.known[before], self.old[before]
        if len(cache) > self.entries:
            self.old[before] = old = cache
            self.known[before] = cache = {}
        if new := [p for p in pieces if p not in cache]:
            cache.update([(p, old[p]) for p in new if p in old])
            if new := [p for p in new if p not in cache]:
                self._learn(cache, list(dict.fromkeys(new)), before)
        return [cache[p] for p in pieces]

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow string array (null: empty) as bytes of little-endian unsigned 16-bit integers."""
        import numpy as np
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        offsets = pieces.offsets.to_numpy()
        offsets = offsets - offsets[0]
        distinct = pieces.flatten().dictionary_encode()
        codes = distinct.indices.to_numpy().copy()
        found = self._lookup(strings(distinct.dictionary), " " if self.byte_level else "")
        if self.byte_level:  # no space stands before a text's first piece
            starts = offsets[:-1]
            firsts = strings(distinct.dictionary.take(distinct.indices.take(starts)))
            codes[starts] = len(found) + np.arange(len(starts))
            found += self._lookup(firsts, "")
        odd = np.array([x is None for x in found])
        lengths = np.array([len(x) // 2 if x else 0 for x in found], dtype=np.int32)
        data = np.frombuffer(b"".join([x for x in found if x]), dtype="<u2")
        at = np.cumsum(lengths, dtype=np.int32) - lengths
        sizes = lengths[codes]
        ends = np.cumsum(sizes, dtype=np.int32)
        ids = data[np.repeat(at[codes] - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        cuts = (2 * np.concatenate([[0], ends]).astype(np.int64)[offsets]).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        if odd.any():  # space beside space, or at an end: no cut there
            for i in np.flatnonzero(np.logical_or.reduceat(odd[codes], offsets[:-1])).tolist():
                out[i] = self._library([texts[i].as_py()])[0]
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, byte_level: bool, entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder per worker and file, with caches of generations of ``entries`` pieces."""
    if (path, byte_level) not in _encoders:
        give_back()
        _encoders[path, byte_level] = Encoder(path, byte_level, entries)
    return _encoders[path, byte_level]


def forget() -> None:
    """Drop this worker's encoders and caches and give their memory back: other operators call it, since workers outlive an operator."""
    if _encoders:
        _encoders.clear()
        give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_slices(texts, most: int = 8 << 20):
    """Ranges of consecutive texts (an Arrow string array) of about ``most`` bytes at most: bounds a worker's memory."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end
