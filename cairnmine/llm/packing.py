"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A document is cut into full pieces of ``capacity`` bytes and a rest. Pieces go, largest first, into the bin with the
least residual that takes them and has no conflict: a bin holds at most one piece of a source and at most one of a
duplicate cluster. Bins are kept in order of residual with bitmaps of their sources and clusters; from the first bin
that is large enough the search goes on to the next larger residual until a compatible one is found, or opens a bin.
No cap ends the search.

Scale: rows are dealt into groups of about ``GROUP`` documents by a hash of id and text, each packed on its own, so no
task holds more than a group and a hot source or cluster is spread over all of them. Only ids, sizes and hashes are
shuffled, never texts. Size is UTF-8 bytes (tokens of a byte-level model).

Defined cases: null or empty texts are one piece of size 0 that still takes a place; a null source conflicts with
nothing, empty and null texts belong to no cluster; repeated rows are copies, so they never share a bin; an id may be
null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_key

CAPACITY, GROUP, STEP = 8192, 4096, 512


class Bins:
    """Open bins in ascending order of residual (equal residuals: in the order in which bins came to them)."""

    def __init__(self, capacity: int, kinds: tuple[int, int]):
        self.capacity, self.n, self.room = capacity, 0, 64
        self.residual = np.zeros(64, np.int64)
        self.bin = np.zeros(64, np.int64)
        self.bits = [np.zeros((64, k // 64 + 1), np.uint64) for k in kinds]  # by bin, not by place

    def _compatible(self, bins: np.ndarray, marks: tuple[int, int]) -> np.ndarray:
        ok = np.ones(len(bins), bool)
        for bits, mark in zip(self.bits, marks):
            if mark >= 0:
                ok &= (bits[bins, mark >> 6] >> np.uint64(mark & 63)) & np.uint64(1) == 0
        return ok

    def put(self, size: int, marks: tuple[int, int]) -> int:
        at = int(np.searchsorted(self.residual[: self.n], size, "left"))
        while at < self.n:
            ok = self._compatible(self.bin[at : min(at + STEP, self.n)], marks)
            if ok.any():
                at += int(ok.argmax())
                break
            at += len(ok)
        if at < self.n:
            own, left = int(self.bin[at]), int(self.residual[at]) - size
            to = int(np.searchsorted(self.residual[:at], left, "right"))
            self.residual[to + 1 : at + 1] = self.residual[to:at].copy()
            self.bin[to + 1 : at + 1] = self.bin[to:at].copy()
        else:
            own, left = self.n, self.capacity - size
            if self.n == self.room:
                self.room *= 2
                self.residual, self.bin = np.resize(self.residual, self.room), np.resize(self.bin, self.room)
                self.bits = [np.concatenate([b, np.zeros_like(b)]) for b in self.bits]
            to = int(np.searchsorted(self.residual[: self.n], left, "right"))
            self.residual[to + 1 : self.n + 1] = self.residual[to : self.n].copy()
            self.bin[to + 1 : self.n + 1] = self.bin[to : self.n].copy()
            self.n += 1
        self.residual[to], self.bin[to] = left, own
        for bits, mark in zip(self.bits, marks):
            if mark >= 0:
                bits[own, mark >> 6] |= np.uint64(1) << np.uint64(mark & 63)
        return own


def _codes(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Small numbers for values that occur more than once; -1 for the rest, which can't conflict."""
    found, code, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = np.full(len(found), -1)
    keep[times > 1] = np.arange((times > 1).sum())
    return np.where(known, keep[code], -1)


def pack_group(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, in the given order."""
    bins = Bins(capacity, (int(source.max(initial=0)) + 1, int(cluster.max(initial=0)) + 1))
    return np.array([bins.put(s, (a, b)) for s, a, b in zip(size.tolist(), source.tolist(), cluster.tolist())], np.int64)


def _pack(capacity: int):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            t = t.sort_by([("group", "ascending"), ("size", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending")])
            group = t.column("group").to_numpy()
            cuts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
            own = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                s = t.slice(a, b - a)
                source = _codes(s.column("source").to_numpy(), s.column("has_source").to_numpy(zero_copy_only=False))
                cluster = _codes(s.column("cluster").to_numpy(), s.column("has_cluster").to_numpy(zero_copy_only=False))
                own.append(pack_group(s.column("size").to_numpy(), source, cluster, capacity))
            out = t.select(["doc_id", "piece", "pieces", "start", "size"])
            out = out.append_column("bin", pa.array((group << np.int64(32)) + np.concatenate(own)))
            yield from out.combine_chunks().to_batches()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, pieces, start, size, bin): which bytes of which document lie in which bin.

    cluster_col: a column of duplicate classes; without it equal texts are one cluster.
    """
    text, source = F.col(text_col), F.col(source_col)
    cluster = F.col(cluster_col) if cluster_col else F.when(F.length(text) > 0, text)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(source).alias("source"), source.isNotNull().alias("has_source"),
        F.xxhash64(cluster).alias("cluster"), cluster.isNotNull().alias("has_cluster"), F.xxhash64(F.col(id_col), text, F.monotonically_increasing_id()).alias("h"),
    )
    groups = max(1, -(-docs.count() // GROUP))
    pieces = F.greatest(F.lit(1), F.expr(f"(bytes + {capacity - 1}) div {capacity}")).cast("int")
    rows = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    start = F.col("piece").cast("long") * capacity
    rows = rows.withColumn("start", start).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("bytes") - start)).withColumn("group", F.pmod("h", F.lit(groups).cast("long")))
    rows = rows.select("group", "doc_id", "piece", "pieces", "start", "size", "source", "has_source", "cluster", "has_cluster")
    return per_key(rows, "group", _pack(capacity), "doc_id long, piece int, pieces int, start long, size long, bin long")
