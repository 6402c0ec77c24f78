"""Density peeling of bipartite graphs.

The mode is the caller's choice and never follows the size. ``exact`` removes one node at a time in one task, whose memory grows
with the nodes and not with the edges (``removal``); it refuses graphs of more than ``MOST_EXACT`` edges (counted). ``batch`` peels in distributed rounds that remove every node of less than
(1 + eps) times the density: its result is at least 1 / (2 + 2 eps) of the best density, and is not the exact mode's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..tables import cut
from . import removal

#: Edges on the disk of the one task, 16 bytes for each end.
MOST_EXACT = 2_000_000_000


def peel_arrays(src: np.ndarray, dst: np.ndarray, w: np.ndarray, most: int = -1) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, cols, density) of the densest prefix: the least degree goes first, rows before columns, then the lower id.

    The whole graph is a candidate, later sets replace it only if denser. ``most``: largest size that counts, if positive.
    """
    rows, r = np.unique(src, return_inverse=True)
    cols, c = np.unique(dst, return_inverse=True)
    nr, n = len(rows), len(rows) + len(cols)
    ends, other, weight = np.concatenate([r, c + nr]), np.concatenate([c + nr, r]), np.concatenate([w, w])
    order = np.lexsort((other, ends))
    adj = removal.Adjacency(n)
    adj.add(ends[order], other[order], weight[order])
    adj.close()
    keep, best = removal.peel(adj, np.bincount(ends, weight, n), float(w.sum()), most)
    return rows[keep[:nr]], cols[keep[nr:]], best


def exact(edges: DataFrame, most: int = -1) -> DataFrame:
    """(kind, id, density) of ``edges`` (src, dst, w)."""
    e = removal.checked(edges.select("src", "dst", "w"), MOST_EXACT, "exact peeling")
    ends = e.select(F.lit(0).alias("side"), F.col("src").alias("id")).distinct().unionByName(e.select(F.lit(1).alias("side"), F.col("dst").alias("id")).distinct())
    nodes, n = removal.numbered(ends, ["side", "id"])
    u = nodes.where("side = 0").select(F.col("id").alias("src"), F.col("k").alias("u"))
    v = nodes.where("side = 1").select(F.col("id").alias("dst"), F.col("k").alias("v"))
    found = removal.peeled(e.join(u, "src").join(v, "dst").select("u", "v", F.col("w").cast("double").alias("w")), n, most)
    kind = F.when(F.col("side") == 0, "row").otherwise("col").alias("kind")
    return nodes.join(found, "k").select(kind, F.col("id").cast("long").alias("id"), "density")


def batch(edges: DataFrame, eps: float = 1.0) -> DataFrame:
    """Distributed rounds; each is one degree aggregate a side and two semi-joins."""
    e = cut(edges.select("src", "dst", "w"))
    best, kept, before = -1.0, e, -1
    while True:
        r, c = cut(graph.degree(e, "src")), cut(graph.degree(e, "dst"))
        nr, total = r.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0.0))).first()
        n = nr + c.count()
        if not n or n == before:  # empty, or all degrees are equal
            break
        before = n
        density = total / n
        if density > best:
            best, kept = density, e
        least = (1 + eps) * density
        e = cut(graph.inside(e, r.where(F.col("degree") >= least), c.where(F.col("degree") >= least)))
    rows = kept.select(F.lit("row").alias("kind"), F.col("src").alias("id")).distinct()
    cols = kept.select(F.lit("col").alias("kind"), F.col("dst").alias("id")).distinct()
    return rows.unionByName(cols).withColumn("density", F.lit(float(best)))


def peel(edges: DataFrame, mode: str = "exact", most: int = -1) -> DataFrame:
    if mode not in ("exact", "batch") or mode == "batch" and most > 0:
        raise ValueError("mode is exact or batch; only exact keeps to a largest size")
    return exact(edges, most) if mode == "exact" else batch(edges)


def fraudar(edges: DataFrame, k: int = 1, weights: str = "log", most: int = -1, mode: str = "exact", binary: bool = True) -> DataFrame:
    """(block, kind, id, density) of k rounds: column-weighted peeling, then the block's inner edges go.

    binary: entries count as 1, as the weights do.
    """
    e = edges.select("src", "dst", F.lit(1.0).alias("w")) if binary else edges.select("src", "dst", "w")
    out = None
    for b in range(k):
        found = cut(peel(graph.column_weights(e, weights).select("src", "dst", (F.col("w") * F.col("cw")).alias("w")), mode, most))
        part = found.select(F.lit(b).alias("block"), "*")
        out = part if out is None else out.unionByName(part)
        if b + 1 < k:
            e = cut(graph.without_inside(e, found.where("kind = 'row'"), found.where("kind = 'col'")))
    return out


def symmetric(edges: DataFrame) -> DataFrame:
    """(id, density) of the densest subgraph of one node set: density is weight over nodes. Exact, so in one task."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w"))
    e = removal.checked(e, MOST_EXACT, "exact peeling")
    nodes, n = removal.numbered(e.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"])
    u, v = nodes.select(F.col("id").alias("a"), F.col("k").alias("u")), nodes.select(F.col("id").alias("b"), F.col("k").alias("v"))
    found = removal.peeled(e.join(u, "a").join(v, "b").select("u", "v", F.col("w").cast("double").alias("w")), n)
    return nodes.join(found, "k").select(F.col("id").cast("long").alias("id"), "density")


def specgreedy(edges: DataFrame, rounds: int = 1, k: int = 3, weights: str = "log", delete: str = "edge", mode: str = "exact") -> DataFrame:
    """(block, kind, id, density): the densest of the peeled outlier blocks of k singular vectors, round by round.

    Vectors are tried in order until twice the best density reaches the next singular value, which bounds what is left.
    """
    from ..functions.linalg import outliers, singular

    out = None
    e = edges.select("src", "dst", "w")
    for b in range(rounds):
        weighted = cut(graph.column_weights(e, weights).select("src", "dst", (F.col("w") * F.col("cw")).alias("w")))
        sigma, left, right = singular(weighted, k)
        rows, cols = cut(outliers(left, len(sigma))), cut(outliers(right, len(sigma)))
        best, best_density = None, -1.0
        for j in range(len(sigma)):
            if 2 * best_density >= sigma[j]:
                break
            part = graph.inside(weighted, rows.where(F.col("vector") == j), cols.where(F.col("vector") == j))
            found = cut(peel(part, mode))
            top = found.agg(F.max("density")).first()[0]
            if top is not None and top > best_density:
                best, best_density = found, top
        if best is None:
            break
        one = best.select(F.lit(b).alias("block"), "*")
        out = one if out is None else out.unionByName(one)
        if b + 1 < rounds:
            drop = graph.without_inside if delete == "edge" else graph.without_touching
            e = cut(drop(e, best.where("kind = 'row'"), best.where("kind = 'col'")))
    return out if out is not None else edges.sparkSession.createDataFrame([], "block int, kind string, id long, density double")


def specgreedy_undirected(edges: DataFrame, k: int = 5) -> DataFrame:
    """(id, density): the densest of the exactly peeled subgraphs that outliers of the k leading eigenvectors span, on one node set.

    As in ``specgreedy``, vectors are tried until twice the best density reaches the next eigenvalue.
    """
    from ..functions.linalg import outliers, singular

    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))
    e = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    sigma, left, _ = singular(e, k)
    nodes = cut(outliers(left, len(sigma), both_signs=True))
    best, best_density = None, -1.0
    for j in range(len(sigma)):
        if 2 * best_density >= sigma[j]:
            break
        own = nodes.where(F.col("vector") == j)
        found = cut(symmetric(graph.inside(e, own, own)))
        top = found.agg(F.max("density")).first()[0]
        if top is not None and top > best_density:
            best, best_density = found, top
    return best if best is not None else edges.sparkSession.createDataFrame([], "id long, density double")


def eigenspokes(edges: DataFrame, k: int = 5) -> DataFrame:
    """(side, vector, id, score): outliers of the top singular vectors."""
    from ..functions.linalg import outliers, singular

    sigma, left, right = singular(edges, k)
    rows = outliers(left, len(sigma), both_signs=True).select(F.lit("row").alias("side"), "*")
    return rows.unionByName(outliers(right, len(sigma), both_signs=True).select(F.lit("col").alias("side"), "*"))


def spectral_block(edges: DataFrame, threshold: str | float = "avg") -> DataFrame:
    """(kind, id, score): the block of the first singular vectors, above 1 / sqrt(n) or a given value; scores scaled by sqrt(sigma)."""
    from ..functions.linalg import singular

    sigma, left, right = singular(edges, 1)
    root = float(np.sqrt(sigma[0])) if len(sigma) else 0.0
    side = lambda x, kind: x.where(F.col("x0") > (1 / np.sqrt(max(1, x.count())) if threshold == "avg" else float(threshold))).select(F.lit(kind).alias("kind"), "id", (F.col("x0") * root).alias("score"))
    return side(left, "row").unionByName(side(right, "col"))
