"""Graphs as edge tables (src, dst, w, and properties): degrees, subgraphs, scores, components, cores, triangles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import cut


def edges_of(df: DataFrame, src: str, dst: str, w: str | None = None, weighted: bool = True, bipartite: bool = True) -> DataFrame:
    """(src, dst, w), one row an edge: weights summed; unweighted: 1; not bipartite: the larger of both directions, both ways."""
    e = df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg((F.sum(w) if w else F.count("*")).cast("double").alias("w"))
    e = e.where("w <> 0")
    if not weighted:
        e = e.where("w > 0").withColumn("w", F.lit(1.0))
    if not bipartite:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        e = e.unionByName(back).groupBy("src", "dst").agg(F.max("w").alias("w"))
    return e


def property_edges(df: DataFrame, src: str, dst: str, prop: str, w: str | None = None) -> DataFrame:
    """(src, dst, prop, w): one property mode kept, the others summed out."""
    return df.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(prop).alias("prop")).agg((F.sum(w) if w else F.count("*")).cast("double").alias("w"))


def degree(edges: DataFrame, side: str = "src", weighted: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree) of one side; with ``ids`` (id) nodes without edges have 0."""
    d = edges.groupBy(F.col(side).alias("id")).agg((F.sum("w") if weighted else F.count("*").cast("double")).alias("degree"))
    return d if ids is None else ids.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def degree_distribution(edges: DataFrame, side: str = "src", weighted: bool = False) -> DataFrame:
    """(degree, n) for 0 .. largest degree, gaps included."""
    counts = degree(edges, side, weighted).groupBy(F.col("degree").cast("long").alias("degree")).agg(F.count("*").alias("n"))
    full = counts.agg(F.max("degree").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"))
    return full.join(counts, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).alias("n"))


def total_degree(edges: DataFrame) -> DataFrame:
    """(id, degree): in and out together, in a graph of one node set."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def out_in_degree(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of distinct neighbours, 0 if none."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    return out.join(into, "id", "full").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def inside(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Edges with src in ``rows`` (id) and dst in ``cols`` (id)."""
    r, c = rows.select(F.col("id").alias("src")), cols.select(F.col("id").alias("dst"))
    return edges.join(r, "src", "left_semi").join(c, "dst", "left_semi")


def subgraph(edges: DataFrame, rows: Sequence[int], cols: Sequence[int]) -> DataFrame:
    """Edges between listed nodes, ids replaced by their places in the lists."""
    spark = edges.sparkSession
    r = spark.createDataFrame([(int(v), k) for k, v in enumerate(rows)], "src long, r long")
    c = spark.createDataFrame([(int(v), k) for k, v in enumerate(cols)], "dst long, c long")
    return edges.join(r, "src").join(c, "dst").select(F.col("r").alias("src"), F.col("c").alias("dst"), "w")


def block_edges(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(n, w): number and sum of the edges inside a block."""
    return inside(edges, rows, cols).agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def without_inside(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Edges but those with both ends in the block."""
    r, c = rows.select(F.col("id").alias("src"), F.lit(True).alias("_r")), cols.select(F.col("id").alias("dst"), F.lit(True).alias("_c"))
    return edges.join(r, "src", "left").join(c, "dst", "left").where("_r is null or _c is null").select(*edges.columns)


def without_touching(edges: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Edges but those with either end in the block."""
    r, c = rows.select(F.col("id").alias("src")), cols.select(F.col("id").alias("dst"))
    return edges.join(r, "src", "left_anti").join(c, "dst", "left_anti").select(*edges.columns)


def above_degree(edges: DataFrame, src_above: float, dst_above: float) -> DataFrame:
    """Edges whose src and dst both have degrees above the thresholds (of the whole graph)."""
    r = degree(edges, "src").where(F.col("degree") > src_above)
    c = degree(edges, "dst").where(F.col("degree") > dst_above)
    return inside(edges, r, c)


def column_weights(edges: DataFrame, kind: str = "log", c: float = 5.0) -> DataFrame:
    """Edges with their column's weight ``cw``: 1/ln(colsum + c), 1/sqrt(colsum + c), or 1."""
    d = degree(edges, "dst").withColumnRenamed("id", "dst")
    w = {"log": 1 / F.ln(F.col("degree") + c), "sqrt": 1 / F.sqrt(F.col("degree") + c), "even": F.lit(1.0)}[kind]
    return edges.join(d.select("dst", w.alias("cw")), "dst").select(*edges.columns, "cw")


def neighbour_degree(edges: DataFrame, side: str = "src") -> DataFrame:
    """(id, avg_degree): mean degree (rounded down) of a node's neighbours on the other side."""
    other = "dst" if side == "src" else "src"
    d = degree(edges, other, weighted=False).withColumnRenamed("id", other)
    return edges.join(d, other).groupBy(F.col(side).alias("id")).agg(F.floor(F.avg("degree")).cast("long").alias("avg_degree"))


def hits(edges: DataFrame, rounds: int = 15) -> tuple[DataFrame, DataFrame]:
    """Hub (id, score) and authority scores after ``rounds`` normalised sums each way."""
    hub = cut(edges.select(F.col("src").alias("id")).distinct().withColumn("score", F.lit(1.0)))
    auth = None
    for _ in range(rounds):
        auth = cut(_unit(edges.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))))
        hub = cut(_unit(edges.join(auth.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))))
    return hub, auth


def _unit(scores: DataFrame) -> DataFrame:
    norm = scores.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    return scores.crossJoin(F.broadcast(norm)).select("id", (F.col("score") / F.col("norm")).alias("score"))  # one row


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) after fixed rounds; dangling nodes spread evenly; weights are shares of a node's out-strength."""
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("w").alias("s"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("p")))
    ends = cut(nodes.join(out.select(F.col("src").alias("id")), "id", "left_anti"))  # nodes without a way out, found once
    dangling = ends.limit(1).count() > 0
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        got = share.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("g"))
        new = nodes.join(got, "id", "left")
        if dangling:
            lost = rank.join(ends, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            new = new.crossJoin(F.broadcast(lost))  # one row
        else:
            new = new.withColumn("lost", F.lit(0.0))
        rank = cut(new.select("id", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return rank


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, distinct, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of nodes in at least one. Edges point from lower to higher (degree, id), which bounds each node's wedges."""
    e = cut(undirected(edges))
    d = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    x = e.join(d.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = cut(x.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = o.alias("x").join(o.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedge.join(e, ["a", "b"])
    return closed.select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): the largest k whose k-core holds the node, by rounds of neighbourhood h-indices until nothing changes."""
    e = undirected(edges)
    both = cut(e.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("n"))))
    core = cut(both.groupBy("id").agg(F.count("*").alias("core")))
    before = None
    while True:  # h-indices fall until they are the core numbers
        known = both.join(core.select(F.col("id").alias("n"), F.col("core").alias("c")), "n")
        ranked = known.groupBy("id", "c").agg(F.count("*").alias("k"))  # by value: a hub's rows shrink before the window
        up = ranked.withColumn("at_least", F.sum("k").over(W.partitionBy("id").orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0)))
        core = cut(up.groupBy("id").agg(F.max(F.least("c", "at_least")).alias("core")))
        state = core.agg(F.sum("core")).first()[0]
        if state == before:
            break
        before = state
    return core


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that a node is connected with, directions ignored; nodes with loops only are their own."""
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    e = cut(undirected(edges).select(F.col("b").alias("a"), F.col("a").alias("b")))
    before = None
    while True:  # a logarithmic number of rounds
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low2 = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        new = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = cut(new.select("x.a", "x.b").where("a <> b").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def same_component(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, same) for pairs (a, b)."""
    one = found.select(F.col("id").alias("a"), F.col("component").alias("_x"))
    two = found.select(F.col("id").alias("b"), F.col("component").alias("_y"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce(F.col("_x") == F.col("_y"), F.col("a") == F.col("b")).alias("same"))


def edge_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst, sign): edges of only one graph, +1 for the left one, -1 for the right one."""
    l, r = left.select("src", "dst").distinct(), right.select("src", "dst").distinct()
    return l.subtract(r).withColumn("sign", F.lit(1)).unionByName(r.subtract(l).withColumn("sign", F.lit(-1)))


def overlap(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1, jaccard) of two tables (kind, id), for each kind and for all kinds together."""
    f, t = found.select("kind", "id").distinct().withColumn("f", F.lit(1)), truth.select("kind", "id").distinct().withColumn("t", F.lit(1))
    both = f.join(t, ["kind", "id"], "full").select("kind", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("t", F.lit(0)).alias("t"))
    n = both.rollup("kind").agg(F.sum(F.col("f") * F.col("t")).alias("x"), F.sum("f").alias("nf"), F.sum("t").alias("nt"))
    p, r = F.try_divide("x", "nf"), F.try_divide("x", "nt")
    ratio = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return n.select(F.coalesce("kind", F.lit("all")).alias("kind"), ratio(p).alias("precision"), ratio(r).alias("recall"), ratio(F.try_divide(2 * F.col("x"), F.col("nf") + F.col("nt"))).alias("f1"), ratio(F.try_divide(F.col("x"), F.col("nf") + F.col("nt") - F.col("x"))).alias("jaccard"))


def _blocks(queries: DataFrame, block: int, id_col: str) -> Iterator[DataFrame]:
    n = max(1, -(-queries.count() // block))
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == b)


def _whole(vectors: DataFrame, id_col: str, v: str) -> DataFrame:
    """(id, x): vectors; null for those that are empty or hold a null."""
    x = F.col(v).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(~F.exists(x, lambda e: e.isNull()) & (F.size(x) > 0), x).alias("x"))


def _units(ids: pa.Array, x: pa.ListArray, metric: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors of length 1) by number of components; those without a direction have 0."""
    ids, flat, start = ids.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    n = np.where(x.is_null().to_numpy(zero_copy_only=False), 0, np.diff(start))
    out, none = {}, [ids[n == 0]]
    for d in np.unique(n[n > 0]).tolist():
        own, m = ids[n == d], flat[start[:-1][n == d][:, None] + np.arange(d)]
        if metric == "pearson":
            m = m - m.mean(axis=1, keepdims=True)
        size = np.sqrt((m * m).sum(axis=1))
        none.append(own[size == 0])
        out[d] = own[size != 0], m[size != 0] / size[size != 0][:, None]
    out[0] = np.concatenate(none), np.zeros((sum(map(len, none)), 0))
    return out


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from 0, as in SQL."""
    return x if digits is None else np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def _similar(vectors: DataFrame, own: DataFrame, metric: str, id_col: str, v: str, digits: int | None, least: float | None = None, k: int | None = None) -> DataFrame:
    """Pairs of a block of queries with all others, as products of matrices of a few thousand rows. ``k``: each task keeps a query's
    best, of which the best are left to the caller."""
    asked = _whole(own, id_col, v).toArrow()
    queries = _units(*[pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (asked["id"], asked["x"])], metric)
    slack = 0.0 if digits is None else 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}  # by length of the other vector: place of the query, id, similarity
        low = {d: np.full(len(q), -np.inf) for d, (q, _) in queries.items()}

        def rows(q, i, s) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "similarity": pa.array(s, pa.float64(), mask=np.isneginf(s))})

        for b in batches:
            for d, (ids, m) in _units(b.column("id"), b.column("x"), metric).items():
                for e, (q, u) in queries.items():
                    for at in range(0, len(ids), 512):
                        i = ids[at : at + 512]
                        s = u @ m[at : at + 512].T if d == e and d else np.full((len(q), len(i)), -np.inf)  # no similarity
                        take = i[None, :] != q[:, None]
                        if least is not None:
                            take &= s >= least - slack
                        elif k is not None:
                            take &= s >= low[e][:, None] - slack
                        a, c = np.nonzero(take)
                        part = [a, i[c], _rounded(s[a, c], digits)]
                        if k is None:
                            keep = slice(None) if least is None else part[2] >= least
                            yield rows(q[part[0][keep]], part[1][keep], part[2][keep])
                        elif len(a):
                            x = [np.concatenate(y) for y in zip(best[e], part)] if e in best else part
                            o = np.lexsort((x[1], -x[2], x[0]))
                            x = [y[o] for y in x]
                            first = np.searchsorted(x[0], np.arange(len(q)))
                            x = [y[np.arange(len(o)) - first[x[0]] < k] for y in x]
                            best[e] = x
                            full = np.bincount(x[0], minlength=len(q)) == k
                            low[e][full] = x[2][np.searchsorted(x[0], np.flatnonzero(full), "right") - 1]
        for e, x in best.items():
            yield rows(queries[e][0][x[0]], x[1], x[2])

    return _whole(vectors, id_col, v).mapInArrow(run, "query long, id long, similarity double")


def similarities(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", id_col: str = "id", v: str = "v", block: int = 4096, digits: int | None = None, least: float | None = None) -> DataFrame:
    """(query, id, similarity): cosine or Pearson of a stated set of queries with all others, rounded to ``digits``. Queries meet the
    vectors in blocks of about ``block``, the only rows that reach the driver; ``least``: lesser pairs are dropped where they are
    computed. Vectors without a direction, or of unequal lengths, have no similarity (null)."""
    return fold(DataFrame.unionByName, [_similar(vectors, own, metric, id_col, v, digits, least) for own in _blocks(queries, block, id_col)])


def top_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", v: str = "v", block: int = 4096, digits: int | None = None) -> DataFrame:
    """(query, id, similarity): the k most similar others of every query, block by block of queries as in ``similarities``; ties of
    (rounded) similarities go to the lower id."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return fold(DataFrame.unionByName, [_similar(vectors, own, metric, id_col, v, digits, k=k).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r") for own in _blocks(queries, block, id_col)])


def pairs_above(pairs: DataFrame, least: float, value: str = "similarity") -> DataFrame:
    return pairs.where(F.col(value) >= least)


def role_of(c: Column) -> tuple[Column, Column]:
    """Role letter and number of prefixed node ids like ``a12``."""
    return F.substring(c, 1, 1), F.substring(c, 2, 30).cast("long")
