"""MinHash near-duplicate detection by a chosen-path set similarity join.

1. Every text becomes its set of word shingles, a 128-bit digest of that set and ``POSITIONS`` minwise tokens. Equal
   sets are one class from here on, represented by their least id: copies are never expanded into pairs.
2. Independent trees: a root branches on two of the minwise positions, so a node holds the sets that chose the same
   tokens. A node of at most ``LEAF`` sets is compared exhaustively; a larger one branches again on two more positions,
   chosen by a hash of the path. A child with half of its parent's sets is dense (a large group of near copies would
   never get small), and so is a large one of the last level: it is dealt into buckets of about ``LEAF`` sets, each of
   which also gets the node's hubs. Components of all trees' edges follow, and what is outside of a dense node's largest
   component is compared in blocks with all of that node: near sets of one node always end in one component.
   Two sets of similarity s share a given leaf of a tree with probability of about s^2 or a little less; with 16 trees
   and s = 0.8 a pair is missed about once in a million, and a group is found through any of its links.
3. Comparisons in nodes use a sketch of 128 bytes: two bits of each of 512 minwise tokens, the least hashes of the eight
   parts of a set under 64 hash functions. A pair passes up to ``most_unequal``, 4.5 standard deviations of the sketch below
   0.8 and some more for small sets (0.69 for sets of 200). Passing only joins sets into blobs: a blob is a superset of the
   true components in it, and texts that share a template of over half their words are not in one.
4. Each blob gets its texts once and confirms links on full sets: all pairs whose ends are not yet in the same component
   are tried. A blob beyond ``BUCKET`` sets is dealt into buckets with hubs, components are computed, and then what is
   outside of the blob's largest component is compared in blocks with all of the blob. So no link within a blob is lost.

Defined cases: null or empty text (or white space only) has an empty set and is linked with nothing; a text of fewer
words than the shingle size is one shingle; a row without an id takes part only through an equal set, and gets that
set's component or none; repeated rows each get a result row; rows with one id and different texts are one document, which is
linked with whatever one of its texts is linked with, and all of its rows are kept or none. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, components, fraction, per_key

POSITIONS, TREES, DEEPEST = 64, 16, 10
LEAF, BUCKET, HUBS, BUCKET_SHINGLES, BLOCK = 256, 512, 32, 4_000_000, 8192
PARTS, SKETCH = 8, 128
_A = (tx.mix(np.arange(1, POSITIONS + 1, dtype=tx.U)) >> tx.U(32)).astype(np.uint32) | np.uint32(1)
_B = (tx.mix(np.arange(1001, POSITIONS + 1001, dtype=tx.U)) >> tx.U(32)).astype(np.uint32)
_ROOT = np.random.RandomState(7).permutation(POSITIONS)[: 2 * TREES].reshape(TREES, 2)


def minwise(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of 64-bit hashes: its minwise tokens for POSITIONS hash functions, and its sketch (bytes).

    The set falls into PARTS by bits of the hashes; each function's least values in them are the sketch's tokens,
    and the least of those is the token of the whole set.
    """
    low = np.full((POSITIONS, PARTS), 0xFFFFFFFF, np.uint32)
    x = (s >> tx.U(32)).astype(np.uint32)
    part = (s & tx.U(PARTS - 1)).astype(np.int64)
    for k in range(PARTS):
        own = x[part == k]
        for i in range(0, len(own), 1 << 13):
            np.minimum(low[:, k], (own[i : i + (1 << 13)] * _A[:, None] + _B[:, None]).min(axis=1), out=low[:, k])
    bits = ((low.reshape(-1) * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8)
    return low.min(axis=1), np.r_[np.packbits(bits & 1), np.packbits(bits >> 1)]


def unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tokens in which sketches (as rows of 64-bit words) differ."""
    d = x ^ y
    return np.bitwise_count(d[..., : SKETCH // 16] | d[..., SKETCH // 16 :]).sum(axis=-1, dtype=np.int64)


def most_unequal(n: np.ndarray) -> np.ndarray:
    """How many tokens may differ in a pair whose smaller set has n members: equal ones are s + (1 - s) / 4 of all. Never grows with n."""
    least = 0.8 - 4.5 * 0.021 - 4 / np.maximum(n, 1)
    return np.floor(POSITIONS * PARTS * 0.75 * (1 - np.maximum(least, 0))).astype(np.int64)


def _signatures(size: int, word_bytes: np.ndarray):
    def run(batches):
        for b in batches:
            n, h1, h2, sig, sk = [], [], [], [], []
            for s in tx.shingle_sets(b.column("text"), size, word_bytes):
                n.append(len(s))
                h1.append(int(tx.mix(s).sum(dtype=tx.U)) if len(s) else 0)
                h2.append(int(tx.mix(s ^ tx.U(0x5851F42D4C957F2D)).sum(dtype=tx.U)) if len(s) else 0)
                low, sketch = minwise(s) if len(s) else (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
                sig.append(low.tobytes())
                sk.append(sketch.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(h1, tx.U).view(np.int64)), pa.array(np.array(h2, tx.U).view(np.int64)), pa.array(sig, pa.binary()), pa.array(sk, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig", "sk"])

    return run


def _matrix(col: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    data, off = tx.string_buffers(col)
    return data[off[0] : off[-1]].view(dtype).reshape(len(off) - 1, width)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, n, sk) for each tree."""
    for b in batches:
        sig = _matrix(b.column("sig"), np.uint32, POSITIONS)
        for t, (i, j) in enumerate(_ROOT):
            key = tx.mix(sig[:, i].astype(tx.U) << tx.U(32) ^ sig[:, j].astype(tx.U) ^ tx.mix(np.full(len(sig), t + 1, tx.U)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("rep"), b.column("n"), b.column("sk")], ["key", "rep", "n", "sk"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two children that each set of a node chooses; their positions follow from the node's key alone."""
    for b in batches:
        sig = _matrix(b.column("sig"), np.uint32, POSITIONS)
        key = b.column("key").to_numpy(zero_copy_only=False).view(tx.U)
        for c in range(2):
            way = tx.mix(key + tx.U(c + 1))
            token = sig[np.arange(len(sig)), (way % tx.U(POSITIONS)).astype(int)].astype(tx.U)
            child = tx.mix(way ^ token * tx.U(0x9FB21C651E98DF25))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("rep"), b.column("n"), b.column("sk"), b.column("c")], ["key", "rep", "n", "sk", "parent_c"])


def _leaves(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Exhaustive comparison of nodes by sketch; gives edges that connect whatever passed, at most one fewer than sets in large nodes."""
    for t in tables:
        key = t.column("key").to_numpy()
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        size = np.diff(cuts)
        if not (size > 1).any():
            continue
        rep, n, sk = t.column("rep").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("sk"), np.uint64, SKETCH // 8)
        a, b = [], []
        for m in range(2, 9):  # small nodes of equal size at once
            starts = cuts[:-1][size == m]
            for i in range(m - 1 if len(starts) else 0):
                for j in range(i + 1, m):
                    x, y = starts + i, starts + j
                    near = (10 * np.minimum(n[x], n[y]) >= 8 * np.maximum(n[x], n[y])) & (rep[x] != rep[y])
                    x, y = x[near], y[near]
                    near = unequal(sk[x], sk[y]) <= most_unequal(np.minimum(n[x], n[y]))
                    a.append(rep[x[near]])
                    b.append(rep[y[near]])
        for s, m in zip(cuts[:-1][size > 8].tolist(), size[size > 8].tolist()):
            own, own_n, own_sk, label = rep[s : s + m], n[s : s + m], sk[s : s + m], np.arange(m)
            for i in range(m - 1):
                js = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (10 * np.minimum(own_n[i], own_n[i + 1 :]) >= 8 * np.maximum(own_n[i], own_n[i + 1 :])))
                if len(js):
                    js = js[unequal(own_sk[js], own_sk[i]) <= most_unequal(np.minimum(own_n[js], own_n[i]))]
                if len(js):
                    found, at = np.unique(label[js], return_index=True)
                    a.append(np.full(len(found), own[i]))
                    b.append(own[js[at]])
                    label[np.isin(label, found)] = label[i]
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _blocks(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Comparison by sketch of left rows (u = 2) with rows of their node (u = 1 if outside of its largest component, else 0).

    Two rows outside of it are each other's left rows in two blocks; the one with the lesser id counts.
    """
    for t in tables:
        key = t.column("key").to_numpy()
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        columns = [t.column(c).to_numpy() for c in ("rep", "n", "comp", "u")]
        sk = _matrix(t.column("sk"), np.uint64, SKETCH // 8)
        a, b = [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            order = s + np.lexsort((columns[0][s:e], -columns[3][s:e]))
            rep, n, label, u = (c[order] for c in columns)
            lefts, rest = np.searchsorted(-u, (-2, -1), "right").tolist()
            words, most = np.ascontiguousarray(sk[order].T), most_unequal(n)
            first = lefts + np.searchsorted(rep[lefts:rest], rep[:lefts], "right")
            for i, j in enumerate(first.tolist()):
                d = words[:, j:] ^ words[:, i : i + 1]
                far = np.bitwise_count(d[: SKETCH // 16] | d[SKETCH // 16 :]).sum(axis=0, dtype=np.uint16)
                js = j + np.flatnonzero((far <= np.maximum(most[j:], most[i])) & (label[j:] != label[i]))
                js = js[10 * np.minimum(n[i], n[js]) >= 8 * np.maximum(n[i], n[js])]
                if len(js):
                    found, at = np.unique(label[js], return_index=True)
                    a.append(np.full(len(found), rep[i]))
                    b.append(rep[js[at]])
                    label[np.isin(label, found)] = label[i]
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, on sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < 80 * len(y) or not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _confirm(size: int, word_bytes: np.ndarray, across: bool):
    """Links on full sets within each key. Pairs in one component already are skipped.

    across: a row's ``u`` says which side of the block it is on; only pairs with a left row are tried.
    """

    def run(tables):
        for t in tables:
            key = t.column("key").to_numpy()
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            out = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = t.slice(s, e - s)
                rep, label = part.column("rep").to_numpy(), part.column("comp").to_numpy().copy()
                left = np.flatnonzero(part.column("u").to_numpy() == 1) if across else np.arange(e - s)
                sets = list(tx.shingle_sets(part.column("text"), size, word_bytes))
                n = np.array([len(x) for x in sets])
                sk = np.stack([minwise(x)[1] for x in sets]).view(np.uint64) if e - s > 2 else np.zeros((e - s, SKETCH // 8), np.uint64)
                for i in left.tolist():
                    js = np.flatnonzero((label != label[i]) & (10 * np.minimum(n[i], n) >= 8 * np.maximum(n[i], n)))
                    js = js if across else js[js > i]
                    if len(js):
                        js = js[unequal(sk[js], sk[i]) <= most_unequal(np.minimum(n[js], n[i]))]
                    for j in js.tolist():
                        if label[j] != label[i] and _near(sets[i], sets[j]):
                            out.append((max(rep[i], rep[j]), min(rep[i], rep[j])))
                            label[label == label[j]] = label[i]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], ["a", "b"])

    return run


def _with_key(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.xxhash64(*cols).alias("key"), "rep", "comp", "u", "text")


def near_duplicates(docs: DataFrame, shingle: int = 5, word_bytes: np.ndarray = tx.NOT_SPACE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``. See the module's text for method and cases."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = scratch.write(docs.mapInArrow(_signatures(shingle, word_bytes), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, sk binary"), "sigs")
    reps = scratch.write(sigs.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("sk").alias("sk")).where("rep is not null"), "reps")

    blobs = components(scratch, _candidates(scratch, reps)).withColumnsRenamed({"id": "rep", "component": "blob"})
    links = _links(scratch, docs, reps, blobs, shingle, word_bytes)
    found = components(scratch, links)
    of_set = reps.select("h1", "h2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    of_set = scratch.write(of_set, "of_set")
    scratch.drop(reps)
    out = sigs.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _candidates(scratch: Scratch, reps: DataFrame) -> DataFrame:
    """Edges that connect the sets that are in one node and whose sketches are near."""
    rows = "key long, rep long, n long, sk binary"
    level = reps.select("rep", "n", "sig", "sk").mapInArrow(_roots, rows).withColumn("parent_c", F.lit(None).cast("long"))
    edges, small, dense = [], [], []
    for depth in range(DEEPEST + 1):
        counts = level.groupBy("key").agg(F.count("*").alias("c"), F.max("parent_c").alias("p")).where(F.col("c") > LEAF)
        last = depth == DEEPEST
        large = scratch.write(counts.select("key", "c", (F.lit(last) | F.coalesce(F.col("c") * 2 >= F.col("p"), F.lit(False))).alias("dense")), f"large{depth}")
        small.append(level.join(large, "key", "left_anti").select("key", "rep", "n", "sk"))
        n_large, n_dense = large.agg(F.count("*"), F.count_if("dense")).first()
        if n_dense:
            dense.append(scratch.write(level.join(large.where("dense"), "key", "left_semi").select("key", "rep").distinct(), f"dense{depth}"))
            node = level.join(large.where("dense"), "key").withColumn("h", F.xxhash64("key", "rep"))
            buckets = F.ceil(F.col("c") / LEAF).cast("int")
            hub = fraction(F.col("h")) < F.lit(HUBS) / F.col("c")
            node = node.withColumn("to", F.when(hub, F.sequence(F.lit(0), buckets - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep", "key", F.lit(1)), buckets.cast("long")).cast("int"))))
            node = node.select("key", F.explode("to").alias("to"), "rep", "n", "sk")
            small.append(node.select(F.xxhash64("key", "to").alias("key"), "rep", "n", "sk"))
        edges.append(scratch.write(per_key(_union(small), "key", _leaves, "a long, b long"), f"edges{depth}"))
        small = []
        if n_large == n_dense:
            break
        node = level.join(large.where("not dense").drop("dense"), "key").select("key", "rep", "c").join(reps.select("rep", "n", "sig", "sk"), "rep")
        level = scratch.write(node.select("key", "rep", "n", "sig", "sk", "c").mapInArrow(_branch, rows + ", parent_c long"), f"level{depth + 1}")
    return _with_rest(scratch, reps, _union(edges), _union(dense)) if dense else _union(edges)


def _with_rest(scratch: Scratch, reps: DataFrame, edges: DataFrame, dense: DataFrame) -> DataFrame:
    """Edges, and those that the buckets of dense nodes (key, rep) left out: between any two components of one node."""
    comps = components(scratch, edges)
    found = comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
    state = dense.join(comps.withColumnsRenamed({"id": "rep", "component": "comp"}), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    state = scratch.write(state, "state")
    sizes = state.groupBy("key", "comp").agg(F.count("*").alias("k"))
    nodes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", F.negative("comp"))).alias("main"), F.max("k").alias("k"), F.sum("k").alias("c")).where("k < c")
    nodes = scratch.write(nodes.select("key", "main", F.ceil((F.col("c") - F.col("k")) / BLOCK).alias("blocks"), F.ceil(F.col("c") / BLOCK).alias("buckets")), "nodes")
    if not nodes.limit(1).count():
        return found
    outside = F.col("comp") != F.col("main")
    own, bucket = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("buckets"))
    right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), bucket.alias("bucket"), outside.cast("int").alias("u")))
    left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1), lambda b: F.struct(own.alias("block"), b.alias("bucket"), F.lit(2).alias("u")))
    rows = state.join(nodes, "key").select("key", "rep", "comp", F.explode(F.when(outside, F.concat(left, right)).otherwise(right)).alias("to"))
    rows = rows.select(F.xxhash64("key", "to.block", "to.bucket").alias("key"), "rep", "comp", "to.u").join(reps.select("rep", "n", "sk"), "rep")
    rest = scratch.write(per_key(rows.select("key", "rep", "n", "comp", "u", "sk"), "key", _blocks, "a long, b long"), "rest")
    scratch.drop(state)
    return found.unionByName(rest)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _links(scratch: Scratch, docs: DataFrame, reps: DataFrame, blobs: DataFrame, shingle: int, word_bytes: np.ndarray) -> DataFrame:
    """Confirmed links (a, b) that connect the true components within blobs."""
    sized = blobs.join(reps.select("rep", "n"), "rep")
    need = sized.groupBy("blob").agg(F.count("*").alias("m"), F.sum("n").alias("words"))
    need = need.withColumn("buckets", F.greatest(F.ceil(F.col("m") / BUCKET), F.ceil(F.col("words") / BUCKET_SHINGLES)).cast("int"))
    need = scratch.write(need, "need")
    member = blobs.join(need, "blob")
    hub = (F.col("buckets") > 1) & (fraction(F.xxhash64("rep", "blob")) < F.lit(HUBS) / F.col("m"))
    member = member.withColumn("to", F.when(hub, F.sequence(F.lit(0), F.col("buckets") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("buckets").cast("long")).cast("int"))))
    texts = scratch.write(docs.join(member.select(F.col("rep").alias("doc_id"), "blob", "buckets", "to"), "doc_id").select(F.col("doc_id").alias("rep"), "blob", "buckets", "to", "text"), "texts")
    rows = texts.select("rep", "blob", F.explode("to").alias("to"), F.col("rep").alias("comp"), F.lit(0).alias("u"), "text")
    first = scratch.write(per_key(_with_key(rows, "blob", "to"), "key", _confirm(shingle, word_bytes, False), "a long, b long"), "links")
    large = texts.where("buckets > 1")
    if not large.limit(1).count():
        scratch.drop(texts)
        return first
    comps = components(scratch, first).withColumnsRenamed({"id": "rep", "component": "comp"})
    state = scratch.write(large.select("rep", "blob", "buckets").distinct().join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "state")
    sizes = state.groupBy("blob", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("blob").agg(F.max_by("comp", F.struct("k", F.negative("comp"))).alias("main"))
    left = scratch.write(state.join(main, "blob").where("comp <> main").select("rep", "blob", "buckets", "comp"), "left")
    blocks = scratch.write(left.groupBy("blob").agg(F.ceil(F.count("*") / (BUCKET // 2)).cast("int").alias("blocks")), "blocks")
    all_rows = large.drop("to").join(state.select("rep", "comp"), "rep").join(blocks, "blob")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks").cast("long")).cast("int")
    bucket = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("buckets").cast("long")).cast("int")
    right = all_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bucket", bucket).withColumn("u", F.lit(0))
    lefts = all_rows.join(left.select("rep"), "rep", "left_semi").withColumn("block", own).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("u", F.lit(1))
    second = per_key(_with_key(right.unionByName(lefts), "blob", "block", "bucket"), "key", _confirm(shingle, word_bytes, True), "a long, b long")
    second = scratch.write(second, "links")
    scratch.drop(texts)
    return first.unionByName(second)

