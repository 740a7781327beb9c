"""Maximum inner product search: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

Codebooks of 16 centres for each pair of dimensions are trained on a bounded sample with a loss in which the part of
the residual that is parallel to the vector, which shifts its inner products, weighs more than the orthogonal part. Each vector is
coded once, into a stored index. Queries go out in broadcast blocks of bounded bytes, and each task scans its part of the index: it sums two-subspace tables over the code
bytes, scores the best exactly, and so every other row whose table sum lies within its quantisation error of the k-th best so far. So none of the
nearest is lost, whatever the ties, and of each query only the nearest ``k`` leave a task. Vectors are neither copied nor sent anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, need

#: The quantiser of each length is fitted on at most so many vectors: those of the smallest id hashes.
SAMPLE = 8192
CENTRES = 16
WIDTH = 2
PARALLEL = 4.0
#: Rows that a task scans at a time, and bytes of the queries that go out together.
VECTOR_BLOCK = 16_384
QUERY_BYTES = 16 << 20
RERANK = 128
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Quantiser:
    books: object  # subspaces x 16 x width
    parallel: float

    def assign(self, x, sweeps: int = 2):
        """Codes (rows x subspaces, 0-15) by coordinate descent on the anisotropic loss, from the nearest centres on."""
        import numpy as np

        subs, centres, width = self.books.shape
        parts = x.reshape(len(x), subs, width)
        codes = np.stack([((parts[:, s, None] - self.books[s]) ** 2).sum(-1).argmin(1) for s in range(subs)], axis=1)
        norm = np.maximum((x**2).sum(1), 1e-12)
        residual = parts - self.books[np.arange(subs), codes]
        along = (residual * parts).sum((1, 2))
        for _ in range(sweeps):
            for s in range(subs):
                others = along - (residual[:, s] * parts[:, s]).sum(1)
                trial = parts[:, s, None] - self.books[s]
                dot = (trial * parts[:, s, None]).sum(-1) + others[:, None]
                loss = (trial**2).sum(-1) + (self.parallel - 1) * dot**2 / norm[:, None]
                codes[:, s] = loss.argmin(1)
                residual[:, s] = trial[np.arange(len(x)), codes[:, s]]
                along = dot[np.arange(len(x)), codes[:, s]]
        return codes.astype(np.uint8)

    def pack(self, codes):
        """Two four-bit codes in a byte."""
        import numpy as np

        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries):
        """queries x bytes x 256: the inner product of each query with what a code byte stands for."""
        import numpy as np

        subs, centres, width = self.books.shape
        lut = np.einsum("qsw,scw->qsc", queries.reshape(len(queries), subs, width), self.books).astype(np.float32)
        if subs % 2:
            lut = np.concatenate([lut, np.zeros((len(lut), 1, centres), np.float32)], axis=1)
        return (lut[:, ::2, None, :] + lut[:, 1::2, :, None]).reshape(len(queries), -1, centres * centres)


def fit(x, parallel: float = PARALLEL, rounds: int = 6) -> Quantiser:
    """Codebooks for the rows of ``x``: k-means, then rounds of anisotropic assignment and of the centres that fit best, a subspace at a time."""
    import numpy as np

    dims = x.shape[1]
    width = WIDTH if dims % WIDTH == 0 else 1
    subs = dims // width
    random = np.random.RandomState(0)
    parts = x.reshape(len(x), subs, width)
    books = np.stack([parts[random.choice(len(x), CENTRES, replace=len(x) < CENTRES), s] for s in range(subs)])
    for _ in range(8):
        for s in range(subs):
            near = ((parts[:, s, None] - books[s]) ** 2).sum(-1).argmin(1)
            for c in range(CENTRES):
                if (near == c).any():
                    books[s, c] = parts[near == c, s].mean(0)
    q = Quantiser(books, parallel)
    unit = (x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)).reshape(parts.shape)
    for _ in range(rounds):
        codes = q.assign(x)
        books = q.books.copy()
        along = (unit * (parts - books[np.arange(subs), codes])).sum((1, 2))  # the parallel part of each residual
        for s in range(subs):
            u, v = unit[:, s], parts[:, s]
            others = along - (u * (v - books[s, codes[:, s]])).sum(-1)
            # Least of |v - c|^2 + (p - 1) (u (v - c) + others)^2: a system of ``width`` unknowns for each centre.
            right = v + (parallel - 1) * u * ((u * v).sum(-1) + others)[:, None]
            a = np.zeros((CENTRES, width, width))
            b = np.zeros((CENTRES, width))
            np.add.at(a, codes[:, s], np.eye(width) + (parallel - 1) * u[:, :, None] * u[:, None])
            np.add.at(b, codes[:, s], right)
            used = np.bincount(codes[:, s], minlength=CENTRES) > 0
            books[s, used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
            along = others + (u * (v - books[s, codes[:, s]])).sum(-1)
        q = Quantiser(books, parallel)
    return q


def usable(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) that take part: not null, not zero, all components finite; components as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return need(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).withColumn("embedding", v).where(F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def decoded(q: Quantiser, codes):
    """The vectors that codes stand for."""
    import numpy as np

    subs = q.books.shape[0]
    return q.books[np.arange(subs), codes].reshape(len(codes), -1)


def nearest(q: Quantiser, index, queries, k: int, rerank: int, best=None):
    """(ids, scores): for each query its ``k`` largest exact products among ``index`` and ``best``, padded with -inf.

    ``index``: ids, vectors, code bytes and residuals' lengths; ``queries``: ids and vectors; ``best``: a former result. The ``rerank`` best by the tables
    give a k-th best product; rows whose table sum and largest possible error (the lengths of the query and of the row's residual multiplied)
    stay below it can't be among the nearest. All others, ties included, are scored.
    """
    import numpy as np

    ids, x, packed, error = index
    query_ids, asked = queries
    found, scores = best if best is not None else (np.zeros((len(asked), k), dtype=np.int64), np.full((len(asked), k), -np.inf))
    rerank = min(max(rerank, k + 1), len(ids))
    longest = np.sqrt((x**2).sum(1).max())
    for i in range(0, len(asked), 64):
        some, asking = asked[i : i + 64], query_ids[i : i + 64]
        length = np.sqrt((some**2).sum(1))
        own = asking[:, None] == ids[None]
        tables, total = q.tables(some), np.zeros((len(some), len(x)), dtype=np.float32)
        for m in range(packed.shape[1]):
            total += tables[:, m][:, packed[:, m]]
        total[own] = -np.inf
        first = np.argpartition(total, len(ids) - rerank, axis=1)[:, len(ids) - rerank :]
        known = np.stack([x[b] @ v for b, v in zip(first, some)])
        known[np.take_along_axis(own, first, axis=1)] = -np.inf
        line = np.sort(np.concatenate([known, scores[i : i + 64]], axis=1), axis=1)[:, -k]
        # The last term covers the rounding of the tables and of the products.
        rows = np.flatnonzero((total + length[:, None] * (error + 1e-4 * longest) >= line[:, None]).any(0))
        product = some @ x[rows].T
        product[own[:, rows]] = -np.inf
        for j, (query, size) in enumerate(zip(some, length)):
            least = np.partition(product[j], len(rows) - k)[len(rows) - k] if len(rows) > k else -np.inf
            near = rows[(product[j] >= max(least, line[j]) - 1e-9 * size * longest) & (product[j] > -np.inf)]
            exact = np.concatenate([scores[i + j], (x[near] * query).sum(1)])
            names = np.concatenate([found[i + j], ids[near]])
            order = np.lexsort((names, -exact))[:k]
            found[i + j], scores[i + j] = names[order], exact[order]
    return found, scores


def build(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[int, Quantiser]]:
    """The stored index of ``rows`` (vec_id, embedding, d: their length), each coded by the quantiser of its length: with code bytes and the residual's length; and the quantisers."""
    import numpy as np

    lengths = [r["d"] for r in rows.groupBy("d").count().collect()]
    fitted = {}
    for d in lengths:  # few: vectors of different lengths have no product
        sample = rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
        fitted[d] = fit(np.array([r[0] for r in sample]))
    told = rows.sparkSession.sparkContext.broadcast(fitted)

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for at in groups(batch.column(2).to_numpy()):
                some = batch.take(pa.array(at))
                x = vectors_of(some.column(1))
                q = told.value[x.shape[1]]
                codes = q.assign(x)
                error = np.sqrt(((x - decoded(q, codes)) ** 2).sum(1))
                packed = q.pack(codes)
                cuts = pa.array(np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1])
                as_bytes = pa.Array.from_buffers(pa.binary(), len(packed), [None, cuts.buffers()[1], pa.py_buffer(np.ascontiguousarray(packed).tobytes())])
                yield pa.RecordBatch.from_arrays([*some.columns, as_bytes, pa.array(error)], names=["vec_id", "embedding", "d", "codes", "error"])

    index = rows.select("vec_id", "embedding", "d").mapInArrow(code, "vec_id long, embedding array<double>, d int, codes binary, error double")
    return scratch.table(index, "index"), fitted


def groups(keys):
    """Positions of each distinct key."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []


def vectors_of(column):
    """A matrix of the lists of one length in an Arrow column."""
    import numpy as np

    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, block: int = VECTOR_BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` vectors of largest inner product for each query (vec_id divisible by ``every``): query_id, rank, vec_id, score.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with a null id; a query's candidates are the vectors of
    its length. Of repeated ids each row is a candidate, the smallest vector asks, and no query finds its own id. Ties go to the
    smaller vec_id. An empty table gives no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.table(usable(vectors).withColumn("d", F.size("embedding")), "vectors")
    index, fitted = build(rows, scratch)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.table(asked.withColumn("d", F.size("embedding")), "queries")
    size = asked.agg(F.sum(F.col("d").cast("long") * 8 + 16)).first()[0] or 0
    parts = max(1, -(-size // query_bytes))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    quantisers = spark.sparkContext.broadcast(fitted)
    out = scratch.path("found")
    for part in range(parts):  # blocks of the stated query set; each is one pass over the index
        told = spark.sparkContext.broadcast(queries_of(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)))
        found = index.mapInArrow(scanner(quantisers, told, k, rerank, block), FOUND)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        told.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(out)


def queries_of(asked: DataFrame) -> dict:
    """A block of queries by length: ids and vectors."""
    import numpy as np

    by: dict[int, tuple[list, list]] = {}
    for r in asked.select("vec_id", "embedding").collect():
        ids, rows = by.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["vec_id"])
        rows.append(r["embedding"])
    return {d: (np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)) for d, (ids, rows) in by.items()}


def scanner(quantisers, told, k: int, rerank: int, block: int):
    """The scan of a task's part of the index for one block of queries."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        asked, best = told.value, {}
        held: dict[int, list] = {}

        def solve(d: int) -> None:
            columns = [np.concatenate(c) for c in zip(*held.pop(d))]
            order = np.argsort(columns[0], kind="stable")
            best[d] = nearest(quantisers.value[d], [c[order] for c in columns], asked[d], k, rerank, best.get(d))

        for batch in batches:
            for at in groups(batch.column(2).to_numpy()):
                some = batch.take(pa.array(at))
                d = some.column(2)[0].as_py()
                if d not in asked:
                    continue
                codes = np.frombuffer(b"".join(some.column(3).to_pylist()), dtype=np.uint8).reshape(len(at), -1)
                held.setdefault(d, []).append((some.column(0).to_numpy(), vectors_of(some.column(1)), codes, some.column(4).to_numpy()))
                if sum(len(h[0]) for h in held[d]) >= block:
                    solve(d)
        for d in list(held):
            solve(d)
        for d, (ids, scores) in best.items():
            query, place = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked[d][0][query]), pa.array(ids[query, place]), pa.array(scores[query, place])], names=["query_id", "vec_id", "score"])

    return scan
