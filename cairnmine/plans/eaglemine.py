"""Micro-clusters in feature histograms: a water-level tree of islands, goodness-of-fit search, stitching, cell labels.

Nodes are binned in Spark; what follows works on the cells of the histogram, whose number is bounded by the bins (not by
the nodes), in one task. Labels go back to nodes by a join on the cell.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, histogram
from .laws import Law, description_length, fit_mixture, fit_normal, fit_truncated, is_truncated, moments, normal_cdf

#: Least cell probability by strictness, and 5 % point of the Anderson-Darling statistic with fitted parameters.
CRITICAL = (0.1, 0.05, 0.01, 1e-3, 1e-4, 1e-5)
AD_5 = 0.752
EFFECTIVE = 200


def chi2_tail(x: float, d: int) -> float:
    """P(chi-square of d degrees > x), by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 1.0
    if x > 700:
        return 0.0
    term = total = math.exp(-x + a * math.log(x) - math.lgamma(a + 1))
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return max(0.0, 1 - total)


def weighted_ad(x: np.ndarray, w: np.ndarray) -> float:
    """Anderson-Darling statistic of weighted values against a fitted normal, at an effective sample size of at most
    ``EFFECTIVE`` (cells are discrete, so large counts would reject anything)."""
    total = w.sum()
    mean = (w * x).sum() / total
    std = math.sqrt(max((w * (x - mean) ** 2).sum() / total, 1e-12))
    order = np.argsort(x)
    z = np.clip(normal_cdf((x[order] - mean) / std), 1e-10, 1 - 1e-10)
    p = np.cumsum(w[order]) / total
    mid = p - w[order] / total / 2
    n = min(total, EFFECTIVE)
    dz = np.diff(np.r_[0, z, 1])
    f = np.r_[0, mid]
    grid = np.clip((np.r_[0, z] + np.r_[z, 1]) / 2, 1e-10, 1 - 1e-10)
    a2 = n * float((((f - grid) ** 2) / (grid * (1 - grid)) * dz).sum())
    return a2 * (1 + 0.75 / n + 2.25 / n**2)


@dataclass
class Island:
    cells: frozenset
    level: float
    children: list[Island] = field(default_factory=list)


def neighbours(cell: tuple) -> list[tuple]:
    return [tuple(c + s for c, s in zip(cell, step)) for step in product((-1, 0, 1), repeat=len(cell)) if any(step)]


def islands(cells: set) -> list[frozenset]:
    """Parts of cells that touch by sides or corners."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            c = todo.pop()
            part.add(c)
            for x in neighbours(c):
                if x in left:
                    left.remove(x)
                    todo.append(x)
        out.append(frozenset(part))
    return sorted(out, key=lambda p: (-len(p), min(p)))


def opened(cells: set) -> set:
    """Cells that some 2 x ... x 2 square inside the set covers (morphological opening)."""
    out: set = set()
    d = len(next(iter(cells))) if cells else 0
    for c in cells:
        square = [tuple(x + s for x, s in zip(c, step)) for step in product((0, 1), repeat=d)]
        if all(x in cells for x in square):
            out.update(square)
    return out


def level_tree(height: dict, least: float = 1.0, step: float = 0.2, min_cells: int = 4, opening: bool = False) -> list[Island]:
    """Roots of the tree of islands of cells at or above rising levels of log2(1 + n); single-child chains are contracted."""
    roots: list[Island] = []
    above: list[Island] = []
    level, top = least, max(height.values(), default=0)
    while level <= top + 1e-9:
        now = {c for c, h in height.items() if h >= level}
        now = opened(now) if opening else now
        found = [Island(p, level) for p in islands(now) if len(p) > min_cells]
        for f in found:
            parent = next((a for a in above if f.cells <= a.cells), None)
            (parent.children if parent else roots).append(f)
        above = found
        level += step
    return [contract(r) for r in roots]


def contract(node: Island) -> Island:
    while len(node.children) == 1:
        node = Island(node.cells, node.level, node.children[0].children)
    node.children = [contract(c) for c in node.children]
    return node


def prune(node: Island, n: dict, alpha: float = 0.8) -> Island:
    """Children that hold less than alpha of a node's mass are dropped together with what is below them."""
    mass = lambda i: sum(n[c] for c in i.cells)
    if node.children and sum(map(mass, node.children)) < alpha * mass(node):
        node.children = []
    node.children = [prune(c, n, alpha) for c in node.children]
    return node


def expand(node: Island) -> Island:
    """Children grow over their parent's cells, ring by ring, without overlap."""
    if node.children:
        owner = {c: k for k, i in enumerate(node.children) for c in i.cells}
        edge = sorted(owner)
        while edge:
            new: dict = {}
            for c in edge:
                for x in neighbours(c):
                    if x in node.cells and x not in owner:
                        new.setdefault(x, owner[c])
            owner.update(new)
            edge = sorted(new)
        for k, i in enumerate(node.children):
            i.cells = frozenset(c for c, o in owner.items() if o == k)
            expand(i)
    return node


def heavy_path(roots: list[Island], n: dict) -> list[Island]:
    """The fullest root, its fullest child, and so on."""
    out, now = [], roots
    while now:
        out.append(max(now, key=lambda i: sum(n[c] for c in i.cells)))
        now = out[-1].children
    return out


def describe(roots: list[Island], n: dict, law: str = "normal") -> list[tuple[Island, Law]]:
    """Every island of the trees with its law: ``normal`` or ``truncated`` (at 0); two of them mixed on the heavy path."""
    heavy, todo, out = {id(i) for i in heavy_path(roots, n)}, list(roots), []
    while todo:
        i = todo.pop(0)
        out.append((i, law_of(i, n, law, id(i) in heavy)))
        todo += i.children
    return out


def law_of(island: Island, n: dict, law: str, mixed: bool) -> Law:
    cells = sorted(island.cells)
    left, w = np.array(cells, float), np.array([n[c] for c in cells], float)
    low = 0.0 if law == "truncated" else None
    if mixed and len(cells) > 3 * left.shape[1]:
        return fit_mixture(left, w, 2, low)
    return fit_truncated(left, w, low) if low is not None else fit_normal(left, w)


def fit(cells: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return moments(np.array(cells, float), w)


def is_normal(cells: list, w: np.ndarray) -> bool:
    """Anderson-Darling along the eigenvectors."""
    x = np.array(cells, float) + 0.5
    _, vec = np.linalg.eigh(fit(cells, w)[1])
    return all(weighted_ad(x @ vec[:, k], w) < AD_5 for k in range(x.shape[1]))


def search(roots: list[Island], n: dict, min_points: int = 20, law: str = "normal") -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(mean, covariance, mass) of accepted islands, breadth first: one that fits, or has no children, is taken whole.

    law: ``normal`` tests along eigenvectors; ``truncated`` fits normals cut off at 0, a mixture of two on the heavy path, and
    tests each dimension's upper tail by simulation; a mixture that fits counts as its components.
    """
    heavy = {id(i) for i in heavy_path(roots, n)} if law == "truncated" else set()
    todo, out = list(roots), []
    while todo:
        i = todo.pop(0)
        cells = sorted(i.cells)
        w = np.array([n[c] for c in cells], float)
        if w.sum() < min_points:
            continue
        if law == "truncated":
            found = law_of(i, n, law, id(i) in heavy)
            if not i.children or is_truncated(np.array(cells, float), w, found):
                out += [(m, c, float(w.sum() * x)) for m, c, x in zip(found.means, found.covs, found.weights) if w.sum() * x >= 1]
                continue
        elif not i.children or is_normal(cells, w):
            out.append((*fit(cells, w), float(w.sum())))
            continue
        todo += i.children
    return out


def are_close(a: tuple, b: tuple) -> bool:
    """Centres nearer than twice the larger of 1 and the deviations' sum."""
    return float(np.linalg.norm(a[0] - b[0])) < 2 * max(1.0, float((np.sqrt(np.diag(a[1])) + np.sqrt(np.diag(b[1]))).max()))


def merge_by_loss(islands: list[Island], n: dict, law: str = "normal", most_loss: float = np.inf) -> list[tuple[Island, Law]]:
    """Islands with their laws after merging close ones, each time the pair that costs the least log-likelihood for a point, as long as
    that is at most ``most_loss``."""
    now = [(i, law_of(i, n, law, False)) for i in islands]
    loss = lambda i, own: own.loss(np.array(sorted(i.cells), float), np.array([n[c] for c in sorted(i.cells)], float))
    while len(now) > 1:
        best = None
        for a in range(len(now)):
            for b in range(a + 1, len(now)):
                (x, p), (y, q) = now[a], now[b]
                if are_close((p.means[0], p.covs[0]), (q.means[0], q.covs[0])):
                    both = Island(x.cells | y.cells, min(x.level, y.level))
                    own = law_of(both, n, law, False)
                    cost = (loss(both, own) - loss(x, p) - loss(y, q)) / sum(n[c] for c in both.cells)
                    if cost <= most_loss and (best is None or cost < best[0]):
                        best = (cost, a, b, (both, own))
        if best is None:
            break
        now = [v for k, v in enumerate(now) if k not in best[1:3]] + [best[3]]
    return now


def stitch(found: list[tuple]) -> list[tuple]:
    """Merges islands whose centres are nearer than twice the larger of 1 and their summed deviations, nearest first, as long
    as the merged deviation stays below that sum."""
    found = list(found)
    while True:
        best = None
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                (ma, ca, _), (mb, cb, _) = found[i], found[j]
                reach = math.sqrt(np.trace(ca) / len(ma)) + math.sqrt(np.trace(cb) / len(mb))
                d = float(np.linalg.norm(ma - mb))
                if d < max(1.0, reach) and (best is None or d < best[0]):
                    best = (d, i, j)
        if best is None:
            return found
        _, i, j = best
        (ma, ca, wa), (mb, cb, wb) = found[i], found[j]
        w = wa + wb
        m = (wa * ma + wb * mb) / w
        c = (wa * (ca + np.outer(ma - m, ma - m)) + wb * (cb + np.outer(mb - m, mb - m))) / w
        found = [f for k, f in enumerate(found) if k not in (i, j)] + [(m, c, w)]


def label_cells(cells: list, clusters: list[tuple], strictness: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(label, probability) by cell; -1: no cluster gives it more than the critical probability."""
    p = np.zeros((len(cells), len(clusters)))
    for k, (mean, cov, _) in enumerate(clusters):
        d = np.array(cells, float) + 0.5 - mean
        m = (d @ np.linalg.inv(cov) * d).sum(axis=1)
        p[:, k] = [chi2_tail(x, len(mean)) for x in m]
    if not clusters:
        return np.full(len(cells), -1), np.zeros(len(cells))
    best = p.argmax(axis=1)
    top = p[np.arange(len(cells)), best]
    return np.where(top > CRITICAL[strictness], best, -1), top


def divergence(clusters: list[tuple], cells: list, n: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted KL divergence of each cluster's cells from the majority cluster's law (smoothed by 1e-15)."""
    if not clusters:
        return np.zeros(0)
    main = int(np.argmax([c[2] for c in clusters]))
    mean, cov, _ = clusters[main]
    d = np.array(cells, float) + 0.5 - mean
    q = np.exp(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1)) + 1e-15
    q /= q.sum()
    out = np.zeros(len(clusters))
    for k in range(len(clusters)):
        own = label == k
        if own.any():
            p = n[own] / n[own].sum()
            out[k] = float((weight[own] * p * np.log2((p + 1e-15) / q[own])).sum())
    return out


def cluster_cells(cells: DataFrame, strictness: int = 3, step: float = 0.2, alpha: float = 0.8, min_points: int = 20, law: str = "normal") -> DataFrame:
    """(cell, n, label, p, suspicious, bits) of cells (cell array, n, weight); bits: the whole description's length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [tuple(int(v) for v in c) for c in pdf["cell"]]
        n = dict(zip(keys, pdf["n"].astype(float)))
        roots = [expand(prune(r, n, alpha)) for r in level_tree({c: math.log2(1 + v) for c, v in n.items()}, step=step)]
        clusters = stitch(search(roots, n, min_points, law))
        order = sorted(n)
        at = {c: k for k, c in enumerate(keys)}
        count, weight = np.array([n[c] for c in order]), pdf["weight"].to_numpy(float)[[at[c] for c in order]]
        label, p = label_cells(order, clusters, strictness)
        laws = [Law(m[None], c[None], np.ones(1), np.zeros(len(m)) if law == "truncated" else None) for m, c, _ in clusters]
        left = np.array(order, float)
        expected = np.zeros(len(order))
        for k, own in enumerate(laws):
            expected[label == k] = own.probability(left[label == k], left[label == k] + 1) if (label == k).any() else 0.0
        bits = description_length(count, label, expected, laws, tuple(int(v) + 1 for v in left.max(axis=0)))
        kl = divergence(clusters, order, count, label, weight / max(weight.max(initial=0), 1e-12))
        return pd.DataFrame({"cell": [list(c) for c in order], "n": count.astype(int), "label": label, "p": p, "suspicious": [float(kl[k]) if k >= 0 else None for k in label], "bits": bits})

    return cells.select("cell", "n", F.col("weight").cast("double").alias("weight")).withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "cell array<long>, n long, label int, p double, suspicious double, bits double")


def features(edges: DataFrame, kind: str = "outdegree2hubness") -> DataFrame:
    """(id, degree, score): out-degree with hubness, in-degree with authority, or degree with PageRank."""
    from ..functions.linalg import singular

    if kind == "degree2pagerank":
        d, s = graph.total_degree(edges).withColumn("degree", F.col("degree").cast("double")), graph.pagerank(edges).withColumnRenamed("rank", "score")
    else:
        _, left, right = singular(edges, 1)
        side = "src" if kind == "outdegree2hubness" else "dst"
        d = graph.degree(edges, side, weighted=False)
        s = (left if side == "src" else right).select("id", F.greatest("x0", F.lit(0.0)).alias("score"))
    return d.join(s, "id").select("id", "degree", "score")


def eaglemine(nodes: DataFrame, degree: str = "degree", score: str = "score", bins: int = 80, strictness: int = 3, law: str = "normal") -> DataFrame:
    """(id, cell, label, p, suspicious, bits) of nodes (id, degree, score) with positive features."""
    edges = histogram.ticks(nodes, [degree, score], degree=degree, bins=bins)
    binned = histogram.assign(nodes, edges)
    cells = histogram.cells(binned, [degree, score]).withColumn("weight", F.col(f"avg_{degree}"))
    found = cluster_cells(cells, strictness, law=law)
    return binned.select("id", "cell").join(found.drop("n"), "cell")


def counts_by_label(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def tree_rows(roots: list[Island]) -> list[tuple[int, int | None, float, list]]:
    """(number, parent, level, cells) of a level tree, for saving as a table."""
    out: list = []
    todo = [(r, None) for r in roots]
    while todo:
        i, parent = todo.pop(0)
        out.append((len(out), parent, i.level, sorted(i.cells)))
        todo += [(c, len(out) - 1) for c in i.children]
    return out


def tree_from_rows(rows: list[tuple]) -> list[Island]:
    made: dict = {}
    kids: dict = defaultdict(list)
    for k, parent, level, cells in rows:
        made[k] = Island(frozenset(tuple(c) for c in cells), level)
        kids[parent].append(made[k])
    for k, i in made.items():
        i.children = kids[k]
    return kids[None]
