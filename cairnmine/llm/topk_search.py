"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are turned into integers floor(1024 * x). Over a segment of length l with means m, m' and deviations d, d', an
inner product is at most l * (m * m' + d * d') (which is the lower bound l * ((m - m')^2 + (d - d')^2) of the squared
distance, seen from the other side), so the sum over segments bounds the score from above. Bounds are computed coarse
to fine: candidates that stay above a query's current k-th score go on to shorter segments, and survivors get their
exact integer scores. A bound never lies below the true score (a margin covers rounding), so the result is exact.

What makes bounds cut: every query starts with the k-th score that it has among ``SAMPLE`` candidates, which its final one can't
be below, so no partition starts from nothing; queries of a block are ordered by the pivot (one of them) they are most like and
taken ``TOGETHER``, so that those which meet a candidate at once need much the same ones. Vectors in clusters are cut to
their own ones; of vectors without any structure (all directions alike) coarse bounds cut next to nothing, as for any method
of this kind. ``computed`` counts the pairs that got an exact score.

Queries are taken in blocks of ``block`` vectors. A block is broadcast (at most ``block`` rows, so its size is bounded by
parameter and dimension); every partition of candidates streams past it and keeps k for each query; then partial top-k
lists are merged by query, first within a salt and then overall.

Defined cases: vectors that are null, or that hold a null or non-finite component, take no part. Only vectors of equal
length meet; empty vectors score 0. Rows with the query's own id are its own row and no candidates. Repeated ids are
separate candidates for other queries; of several vectors with one id the least one asks. Fewer than k candidates: all of them. Ties go to the smaller id. Scores beyond
53 bits are computed with Python integers; a score beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, smallest_hashes

SCALE, BLOCK, SEGMENTS, SALTS, SAMPLE, PIVOTS, TOGETHER = 1024, 16384, (4, 16), 16, 4096, 64, 128


def _matrix(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(SCALE * x) as float64) by vector length."""
    ids, col = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = flat[(off[at][:, None] + np.arange(d)).astype(np.int64)] if d else np.zeros((len(at), 0))
        out.append((ids[at], np.floor(x.astype(np.float64) * SCALE)))
    return out


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a plain inner product is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            s = x[:, a:b]
            parts += [s.mean(axis=1) * np.sqrt(b - a), s.std(axis=1) * np.sqrt(b - a)]
    return np.stack(parts, axis=1) if parts else np.zeros((len(x), 1))


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q_ids, self.q, self.k, self.pairs = q_ids, q, k, 0
        self.floor = np.full(len(q), -np.inf) if floor is None else floor  # the k-th score is no less
        self.stats = {s: _stats(q, s) for s in SEGMENTS}
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        worst = np.maximum(self.score[:, -1], self.floor)
        alive = np.ones((len(self.q), len(ids)), bool)
        if np.isfinite(worst).any():
            for s in SEGMENTS:
                cols = np.flatnonzero(alive.any(axis=0))
                if not len(cols):
                    return
                bound = self.stats[s] @ _stats(x[cols], s).T
                margin = 1e-9 * np.abs(bound) + 1e-3
                alive[:, cols] &= bound + margin >= worst[:, None]
        alive &= self.q_ids[:, None] != ids[None, :]
        cols = np.flatnonzero(alive.any(axis=0))
        if not len(cols):
            return
        live = np.flatnonzero(alive.any(axis=1))
        got = np.full((len(self.q), len(cols)), -np.inf)
        got[live] = np.where(alive[np.ix_(live, cols)], self.q[live] @ x[cols].T, -np.inf)
        self.pairs += len(live) * len(cols)
        rows = np.flatnonzero((got >= worst[:, None]).any(axis=1) & np.isfinite(got).any(axis=1))
        for r in rows.tolist():
            c = np.flatnonzero(got[r] >= worst[r])
            c = c[np.isfinite(got[r, c])]
            score, own = np.concatenate([self.score[r], got[r, c]]), np.concatenate([self.ids[r], ids[cols[c]]])
            top = np.lexsort((own, -score))[: self.k]
            self.score[r], self.ids[r] = score[top], own[top]


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether all inner products and their partial sums are whole numbers that a double holds."""
    most = lambda m: float(np.abs(m).max()) if m.size else 0.0
    return most(x) * most(q) * max(1, x.shape[1]) < 2.0**53


def _search(queries, k: int, computed=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for ids, q, floor in queries.value:
            best[q.shape[1]] = _Best(ids, q, k, floor)
        wide: dict[int, list] = {}
        for b in batches:
            for ids, x in _matrix(b):
                if (own := best.get(x.shape[1])) is None:
                    continue
                for i in range(0, len(ids), 2048):
                    part, part_ids = x[i : i + 2048], ids[i : i + 2048]
                    if _exact(part, own.q):
                        for j in range(0, len(own.q), TOGETHER):
                            _add(own, j, j + TOGETHER, part_ids, part)
                    else:
                        wide.setdefault(x.shape[1], []).append(_whole(own, part_ids, part, k))
        if computed is not None:
            computed.add(sum(own.pairs for own in best.values()))
        for d, own in best.items():
            at, rank = np.nonzero(np.isfinite(own.score))
            yield _batch(own.q_ids[at], own.ids[at, rank], own.score[at, rank].astype(np.int64))
            for rows in wide.get(d, []):
                yield _batch(*rows)

    return run


def _batch(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])


def _add(own: _Best, i: int, j: int, ids: np.ndarray, x: np.ndarray) -> None:
    part = object.__new__(_Best)
    part.k, part.q_ids, part.q, part.floor, part.pairs = own.k, own.q_ids[i:j], own.q[i:j], own.floor[i:j], 0
    part.stats = {s: v[i:j] for s, v in own.stats.items()}
    part.score, part.ids = own.score[i:j], own.ids[i:j]  # views: the update is in place
    part.add(ids, x)
    own.pairs += part.pairs


def _ordered(ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries in the order of their pivots, and what their k-th scores are at least."""
    like = q @ q[np.linspace(0, len(q) - 1, min(PIVOTS, len(q))).astype(int)].T
    order = np.lexsort((-like.max(axis=1), like.argmax(axis=1)))
    ids, q, floor = ids[order], q[order], np.full(len(q), -np.inf)
    if sample is not None and len(sample[0]) and _exact(sample[1], q):
        for i in range(0, len(q), 1024):
            score = np.where(ids[i : i + 1024, None] == sample[0][None, :], -np.inf, q[i : i + 1024] @ sample[1].T)
            if score.shape[1] >= k:
                floor[i : i + 1024] = np.partition(score, -k, axis=1)[:, -k]
    return ids, q, floor


def _whole(own: _Best, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for very large components, with Python integers."""
    to_int = lambda m: [[int(v) for v in row] for row in m]
    qs, xs, out = to_int(own.q), to_int(x), []
    for qi, q in zip(own.q_ids.tolist(), qs):
        got = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in zip(ids.tolist(), xs) if i != qi]
        out += [(qi, i, -s) for s, i in sorted(got)[:k]]
    a, b, c = zip(*out) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.int64)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", computed=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other vectors for each row whose id is divisible by ``every``.

    computed: an accumulator for the number of pairs with an exact score.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    scratch = Scratch(spark)
    asked = scratch.write(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "queries")
    n = asked.count()
    blocks = max(1, -(-n * 5 // (4 * block)))
    few = smallest_hashes(rows.withColumn("h", F.xxhash64("id", "v")), SAMPLE).select("id", "v").toArrow().combine_chunks().to_batches()  # SAMPLE rows
    samples = {x.shape[1]: (ids, x) for batch in few for ids, x in _matrix(batch)}
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod("block", F.lit(blocks)) == b).select("id", "v").toArrow()  # about ``block`` rows
        queries: dict[int, list] = {}
        for batch in own.combine_chunks().to_batches():
            for ids, q in _matrix(batch):
                queries.setdefault(q.shape[1], []).append((ids, q))
        merged = [_ordered(np.concatenate([i for i, _ in x]), np.concatenate([q for _, q in x]), samples.get(d), k) for d, x in queries.items()]
        shared = spark.sparkContext.broadcast(merged)
        part = rows.mapInArrow(_search(shared, k, computed), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = scratch.write(_merge(part, k), "part")
            shared.destroy()
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if blocks > 1 else _merge(out, k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    by = [F.desc("score"), F.asc("vec_id")]
    salted = found.select("query_id", "vec_id", "score", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("s"))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("query_id", "s").orderBy(*by))).where(F.col("r") <= k)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
    return last.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
