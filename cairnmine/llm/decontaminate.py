"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short and documents long, so a document's own minwise values say little about an item inside it. The
search therefore sketches the items: an item's ``k`` minwise shingles are looked up among all shingles of a document, and the
share found estimates how much of the item the document contains.

Items are partitioned by size (a power of two of their shingles). Every partition is an index of its own, with its sketch size
k, its least count of hits (five standard deviations below the threshold) and its least size: a document looks its shingles up
only in partitions whose items it is large enough to contain. Every candidate (document, item) is then verified on full
shingle sets: containment = |shared shingles| / |item's shingles| >= 0.8.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text, so case and punctuation don't hide
a passage; a shingle is five words; an item of fewer words is one run of its own length.

Items are read in blocks of at most ``BLOCK`` shingles, so what is broadcast is bounded by a parameter; every block
passes over all documents. Documents are not shuffled.

Defined cases: null or empty documents contain nothing; null or wordless items are found nowhere; repeated rows each
count; items that share an id are judged by each text, and a pair is reported once with its largest containment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch

SHINGLE, THRESHOLD, BLOCK = 5, 80, 4_000_000
_MASK = (1 << 22) - 1


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tx.string_buffers(lowered(b.column("text")))
        h, first = tx.words(data, off, tx.ALNUM)
        sets = list(tx.row_shingles(h, first, SHINGLE))
        size = np.minimum(np.diff(first), SHINGLE)
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(size, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["item_id", "run", "n", "shingles"])


@dataclass
class Index:
    """Sketches and sets of one block's items of one size class, whose shingles have ``run`` words each."""

    run: int
    ids: list[int]
    sets: list[np.ndarray]
    hashes: np.ndarray  # sorted sketch entries
    item: np.ndarray  # of each sketch entry
    least_hits: np.ndarray  # by item
    n: np.ndarray

    @classmethod
    def of(cls, run: int, ids: list[int], sets: list[np.ndarray]) -> Index:
        sketch = 8 * len(sets[0]).bit_length()  # the class's size
        hashes, item, least = [], [], []
        for i, s in enumerate(sets):
            k = min(len(s), sketch)
            order = np.argsort(tx.mix(s ^ tx.U(0xC2B2AE3D27D4EB4F)))[:k]
            hashes.append(s[order])
            item.append(np.full(k, i))
            share = THRESHOLD / 100
            least.append(max(1, int(np.floor(k * share - 5 * np.sqrt(k * share * (1 - share))))))
        hashes, item = np.concatenate(hashes), np.concatenate(item)
        order = np.argsort(hashes, kind="stable")
        return cls(run, ids, sets, hashes[order], item[order], np.array(least), np.array([len(s) for s in sets]))

    def search(self, run: np.ndarray, row: np.ndarray, per_row: np.ndarray, cuts: np.ndarray, maybe: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of what the threshold lets pass. run, row: all shingles and their rows, which have
        ``per_row`` each and begin at ``cuts``; maybe: positions that the filter let pass."""
        maybe = maybe[100 * per_row[row[maybe]] >= THRESHOLD * self.n.min()]
        lo, hi = np.searchsorted(self.hashes, run[maybe], "left"), np.searchsorted(self.hashes, run[maybe], "right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(maybe):
            return
        times = hi - lo
        entry = np.repeat(lo - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        hit = np.unique(np.stack([np.repeat(row[maybe], times), entry], axis=1), axis=0)
        pairs, hits = np.unique(np.stack([hit[:, 0], self.item[hit[:, 1]]], axis=1), axis=0, return_counts=True)
        ok = (hits >= self.least_hits[pairs[:, 1]]) & (100 * per_row[pairs[:, 0]] >= THRESHOLD * self.n[pairs[:, 1]])
        for r, i in pairs[ok].tolist():
            shared = int(np.isin(self.sets[i], run[cuts[r] : cuts[r + 1]]).sum())
            if 100 * shared >= THRESHOLD * len(self.sets[i]):
                yield r, i, shared


def _filters(indexes: list[Index]) -> dict[int, np.ndarray]:
    """For each length of run, which low bits the sketches of its partitions have."""
    out: dict[int, np.ndarray] = {}
    for x in indexes:
        out.setdefault(x.run, np.zeros(_MASK + 1, bool))[(x.hashes & tx.U(_MASK)).astype(np.int64)] = True
    return out


def _found(batch: pa.RecordBatch, indexes: list[Index], filters: dict[int, np.ndarray]) -> Iterator[tuple[int, Index, int, int]]:
    data, off = tx.string_buffers(lowered(batch.column("text")))
    for a, b in tx.chunks(off):
        h, first = tx.words(data, off[a : b + 1], tx.ALNUM)
        for size, bits in filters.items():
            run, row = tx.runs(h, first, size)
            maybe = np.flatnonzero(bits[(run & tx.U(_MASK)).astype(np.int64)])
            if len(maybe):
                per_row, cuts = np.bincount(row, minlength=len(first) - 1), np.searchsorted(row, np.arange(len(first)))
                for index in (x for x in indexes if x.run == size):
                    for r, i, shared in index.search(run, row, per_row, cuts, maybe):
                        yield a + r, index, i, shared


def _pairs(shared) -> Callable:
    def run(batches):
        indexes = shared.value
        filters = _filters(indexes)
        for b in batches:
            ids = b.column("doc_id")
            rows = [(ids[r].as_py(), x.ids[i], int(x.n[i]), k) for r, x, i, k in _found(b, indexes, filters)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def _clean(shared, text_col: str) -> Callable:
    def run(batches):
        indexes = shared.value
        filters = _filters(indexes)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            own = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(text_col))], ["text"])
            keep[[r for r, *_ in _found(own, indexes, filters)]] = False
            yield b.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Index]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    sets = Scratch(benchmark.sparkSession).write(items.mapInArrow(_items, "item_id long, run int, n long, shingles binary").where("n > 0"), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total * 3 // (2 * BLOCK)))
    for b in range(blocks):
        classes: dict[tuple[int, int], tuple[list, list]] = {}
        for r in sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b).collect():  # about BLOCK shingles of eight bytes
            ids, own = classes.setdefault((r["run"], r["n"].bit_length()), ([], []))
            ids.append(r["item_id"])
            own.append(np.frombuffer(bytes(r["shingles"]), tx.U))
        yield [Index.of(run, ids, own) for (run, _), (ids, own) in sorted(classes.items())]


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item that a document contains."""
    spark, rows = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(_pairs(spark.sparkContext.broadcast(block)), "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shingles", "x.n_shared", "x.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that contain no item."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(block), text_col), docs.schema)
    return docs
