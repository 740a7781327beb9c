"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; one binary classifier for each bit, a logistic regression over hashed byte n-grams
of the lower-cased text, predicts it. Decoding takes the codeword of least weighted loss, where a bit weighs what its classifier
gets right on rows kept out of its fit, and flags texts whose two nearest codewords are about as near.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need
from .tokens import forget

#: At most about so many labelled rows of each language are fitted, and so many in all where that leaves each its least; chosen by hashes of their id.
ROWS_PER_LANGUAGE = 500
SAMPLE_ROWS = 8192
LEAST_ROWS = 16
BUCKETS = 1 << 16
#: n-grams with weights: the commonest of each language.
NGRAMS = 4096
AMBIGUOUS = 0.1


def codewords(n: int):
    """An n x bits matrix of -1 and 1 with distinct rows: all non-trivial splits for up to 5 languages, else the best of seeded random codes."""
    import numpy as np

    if n == 1:
        return np.ones((1, 1), dtype=np.int8)
    if n <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    bits = max(15, 4 * int(np.ceil(np.log2(n))))
    while True:
        best, most = None, 0
        for seed in range(64 if n <= 512 else 2):
            code = np.where(np.random.RandomState(seed).rand(n, bits) < 0.5, -1, 1).astype(np.int8)
            both = (np.abs(code.sum(axis=0)) < n).all()
            apart = min(int((code[i + 1 :] != code[i]).sum(axis=1).min()) for i in range(n - 1))
            if both and apart > most:
                best, most = code, apart
        if best is not None:
            return best
        bits += 8


#: ASCII letters in lower case, other ASCII as space; bytes of other letters stay.
TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: str):
    """Hashed counts' places: one bucket index for each byte 2- and 3-gram of the lower-cased text that has a letter."""
    import numpy as np

    if not text.isascii():
        text = text.lower()
    words = text.encode("utf-8", "replace").translate(TABLE).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    return np.concatenate([two * np.uint32(2654435761) >> np.uint32(16), three * np.uint32(2246822519) >> np.uint32(16)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    code: object
    weights: object  # BUCKETS x bits
    bias: object
    trust: object  # a weight for each bit

    def margins(self, text: str):
        import numpy as np

        places = features(text)
        if len(places) > BUCKETS // 2:
            counts = np.bincount(places, minlength=BUCKETS).astype(np.float32)
            return counts @ self.weights / len(places) + self.bias
        return self.weights[places].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous; ``und``, 0, True for null, or text without a letter."""
        import numpy as np

        if text is None or not self.languages or not has_letter(text):
            return "und", 0.0, True
        losses = (np.logaddexp(0, -self.code * self.margins(text)) * self.trust).sum(axis=1)
        likely = np.exp(losses.min() - losses)
        likely /= likely.sum()
        order = np.argsort(losses, kind="stable")
        close = len(order) > 1 and likely[order[0]] - likely[order[1]] < AMBIGUOUS
        return self.languages[order[0]], float(likely[order[0]]), bool(close)


def fit(rows: list[tuple[str, str]], epochs: int = 300) -> Model:
    """A model from (text, language) rows. Without any it predicts ``und`` alone."""
    import numpy as np

    rows = sorted((t, lang) for t, lang in rows if t and has_letter(t))
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    code = codewords(len(languages))
    # An n-gram counts by the share of rows that have it, in the language where that is largest: so each language has its own.
    share = np.zeros(BUCKETS, dtype=np.float32)
    of: dict[str, list[str]] = {}
    for t, lang in rows:
        of.setdefault(lang, []).append(t)
    for texts in of.values():
        used = np.zeros(BUCKETS, dtype=np.float32)
        for t in texts:
            used[np.unique(features(t))] += 1
        share = np.maximum(share, used / len(texts))
    kept = np.argsort(-share, kind="stable")[:NGRAMS]
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), len(kept)), dtype=np.float32)
    for i, (t, _) in enumerate(rows):  # texts are counted again rather than all their counts held
        places, n = np.unique(features(t), return_counts=True)
        at = column[places]
        x[i, at[at >= 0]] = n[at >= 0] / n.sum()
    scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-7)
    x *= scale / 8
    index = np.searchsorted(np.array(languages, dtype=object), np.array([lang for _, lang in rows], dtype=object))
    y = code[index].astype(np.float32)
    balance = (1 / np.bincount(index, minlength=len(languages)))[index].astype(np.float32)
    balance /= balance.sum()
    out = np.arange(len(rows)) % 5 == 0

    def solve(use):
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        v, c = w.copy(), b.copy()
        ws = (balance * use)[:, None] / balance[use].sum()
        rate = 1.0
        for _ in range(epochs):
            z = x @ (w + 0.9 * v) + b + 0.9 * c
            g = -y * ws / (1 + np.exp(np.clip(y * z, -30, 30)))
            v = 0.9 * v - rate * (x.T @ g + 1e-4 * w)
            c = 0.9 * c - rate * g.sum(axis=0)
            w, b = w + v, b + c
        return w, b

    trust = np.ones(code.shape[1])
    if out.sum() >= 20 and (~out).any():
        w, b = solve(~out)
        right = ((x[out] @ w + b) * y[out] > 0).mean(axis=0)
        trust = np.maximum(0.05, 2 * right - 1)
    w, b = solve(np.ones(len(rows), dtype=bool))
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    weights[kept] = w * (scale / 8)[:, None]
    return Model(languages, code.astype(np.float32), weights, b, trust)


def train(docs: DataFrame, usable=None, rows_per_language: int = ROWS_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds.

    Every non-null value of lang is learned, from about ``rows_per_language`` rows, or an equal part of ``sample_rows`` where there are many languages, but
    ``LEAST_ROWS`` at least, chosen by id hash. Rows with null text or lang are left out. The sample is the operator's only bounded step; it goes to the driver.
    """
    spark = docs.sparkSession
    base = need(docs, "doc_id", "text", "lang")
    labelled = base.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") > 0))
    if usable is not None:
        labelled = labelled.where(usable)
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    wanted = max(LEAST_ROWS, min(rows_per_language, sample_rows // len(counts)))
    scale = 1 << 30
    shares = spark.createDataFrame([(r["lang"], min(scale, wanted * scale // r["count"])) for r in counts], "l string, share long")
    drawn = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(scale)) < F.col("share")
    chosen = labelled.join(F.broadcast(shares), F.col("lang") == F.col("l")).where(drawn)
    return fit([(r.text, r.lang) for r in chosen.select("text", "lang").toLocalIterator()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; the model sees column text alone. Columns of these names are overwritten.

    Texts that are null or have no letter get ``und`` with score 0; repeated rows the same result; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def guess(texts):
        import pandas as pd

        forget()
        return pd.DataFrame([told.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), guess(F.col("text")).alias("guess"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "guess.lang_pred", "guess.score", "guess.ambiguous")
