"""Bursts in event times, and contrast measures of suspicious users on sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of the three rating levels.
RATING_EDGES = (1.0, 2.5, 4.0, 5.01)


def bursts_of(ts: np.ndarray, bins="auto") -> list[tuple[float, float, float, float]]:
    """(left, right, height, slope) of each burst, highest first: from an awakening point (farthest from the chord to the
    peak) to the peak, found on either side of it again."""
    if len(ts) < 2 or ts.min() == ts.max():
        return []
    y, edges = np.histogram(ts, bins=bins)
    x = (edges[:-1] + edges[1:]) / 2
    found: list[tuple[int, int]] = []
    todo = [(0, len(y) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        peak = a + int(np.argmax(y[a : b + 1]))
        if peak > a and y[peak] > 0:
            cx, cy = x[peak] - x[a], float(y[peak] - y[a])
            far = np.abs(cy * (x[a : peak + 1] - x[a]) - cx * (y[a : peak + 1] - y[a]))
            wake = a + int(np.argmax(far))
            wake = wake if y[wake] < y[peak] and wake < peak else a
            if y[peak] > y[wake]:
                found.append((wake, peak))
            todo.append((a, wake))
        todo.append((peak + 1, b))
    out = []
    for wake, peak in found:
        left = wake
        while left > 0 and y[left - 1] < y[left]:
            left -= 1
        out.append((float(edges[left]), float(edges[peak + 1]), float(y[peak]), float((y[peak] - y[wake]) / (x[peak] - x[wake]))))
    return sorted(out, key=lambda r: (-r[2], r[0]))


def drop_of(ts: np.ndarray, end: float, wait: float = 12 * 3600, bins="auto") -> tuple[float, float]:
    """(slope, fall) of the steepest fall after a peak; a peak within ``wait`` of the end of data doesn't count."""
    if len(ts) < 2 or ts.min() == ts.max():
        return 0.0, 0.0
    y, edges = np.histogram(ts, bins=bins)
    y, x = np.append(y, 0), np.append((edges[:-1] + edges[1:]) / 2, edges[-1] + (edges[1] - edges[0]) / 2)
    best, todo = (0.0, 0.0), [(0, len(y) - 1)]
    while todo:
        a, b = todo.pop()
        if b <= a:
            continue
        peak = a + int(np.argmax(y[a : b + 1]))
        if x[peak] + wait <= end and peak < b:
            cx, cy = x[b] - x[peak], float(y[b] - y[peak])
            low = peak + int(np.argmax(np.abs(cy * (x[peak : b + 1] - x[peak]) - cx * (y[peak : b + 1] - y[peak]))))
            low = low if low > peak else b
            fall = float(y[peak] - y[low])
            if fall > best[1]:
                best = (fall / float(x[low] - x[peak]), fall)
            todo.append((low, b))
        todo.append((a, peak - 1))
    return best


def sink_bursts(edges: DataFrame, end: float, wait: float = 12 * 3600, bins="auto") -> DataFrame:
    """(sink, n, t_mean, t_std, bursts array<struct>, slope, fall) of sinks with two times or more.

    ``edges``: (src, dst, ts). A sink's times are first counted by second, so what one task gets for a sink is bounded by
    the seconds that the data span, not by its events.
    """
    per = edges.groupBy(F.col("dst").cast("long").alias("sink"), F.col("ts").cast("double").alias("ts")).agg(F.count("*").alias("c"))
    names = ("sink", "n", "t_mean", "t_std", "bursts", "slope", "fall")

    def sinks(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        none, sink, ts, c = (np.concatenate(x) for x in zip(*parts))
        at = np.concatenate([[0], np.flatnonzero(np.diff(sink) | np.diff(none)) + 1, [len(sink)]])
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            t = np.repeat(ts[a:b], c[a:b])
            if len(t) >= 2:
                found = [dict(zip(("l", "r", "height", "slope"), x)) for x in bursts_of(t, bins)]
                rows.append((None if none[a] else int(sink[a]), len(t), t.mean(), t.std(), found, *drop_of(t, end, wait, bins)))
        return pd.DataFrame({k: [r[i] for r in rows] for i, k in enumerate(names)}).astype({"sink": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sinks come one after the other; the last one of a batch may go on in the next."""
        open_: list[tuple[np.ndarray, ...]] = []
        for pdf in batches:
            if len(pdf):
                x = tuple(pdf[k].to_numpy() for k in ("none", "sink", "ts", "c"))
                same = (x[1] == x[1][-1]) & (x[0] == x[0][-1])
                k = len(same) - int(same[::-1].argmin()) if not same.all() else 0
                if k or open_ and (open_[-1][1][-1], open_[-1][0][-1]) != (x[1][0], x[0][0]):
                    yield sinks([*open_, tuple(y[:k] for y in x)])
                    open_ = []
                open_.append(tuple(y[k:] for y in x))
        if open_:
            yield sinks(open_)

    rows = per.repartition("sink").select(F.col("sink").isNull().cast("int").alias("none"), F.coalesce("sink", F.lit(0)).alias("sink"), "ts", "c").sortWithinPartitions("none", "sink", "ts")
    return rows.mapInPandas(run, "sink long, n long, t_mean double, t_std double, bursts array<struct<l:double,r:double,height:double,slope:double>>, slope double, fall double")


def burst_share(edges: DataFrame, sinks: DataFrame, users: DataFrame, least: float = 0.5, weighted: bool = True) -> DataFrame:
    """(sink, share): part of the burst events that comes from ``users`` (id), bursts weighted by slope times height.

    Bursts lower than ``least`` of the sink's highest are ignored.
    """
    top = F.array_max(F.transform("bursts", lambda b: b["height"]))
    b = sinks.select("sink", F.explode(F.filter("bursts", lambda b: b["height"] >= least * top)).alias("b"))
    hit = edges.select("src", F.col("dst").alias("sink"), F.col("ts").cast("double").alias("ts")).join(b, "sink").where("ts >= b.l and ts <= b.r")
    weight = F.col("b.slope") * F.col("b.height") if weighted else F.lit(1.0)
    marked = hit.join(users.select(F.col("id").alias("src"), F.lit(1.0).alias("_u")), "src", "left")
    return marked.groupBy("sink").agg(F.try_divide(F.sum(F.coalesce("_u", F.lit(0.0)) * weight), F.sum(weight)).alias("share"))


def rating_levels(edges: DataFrame, rate: str = "rate") -> DataFrame:
    """(sink, n, mean, var, low, mid, high) of sinks with two ratings or more."""
    a, b, c, d = RATING_EDGES
    r = F.col(rate)
    g = edges.groupBy(F.col("dst").alias("sink")).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.var_pop(r).alias("var"), F.count_if((r >= a) & (r < b)).alias("low"), F.count_if((r >= b) & (r < c)).alias("mid"), F.count_if((r >= c) & (r < d)).alias("high")
    )
    return g.where("n >= 2")


def rating_divergence(edges: DataFrame, users: DataFrame, rate: str = "rate", neutral: bool = False) -> DataFrame:
    """(sink, divergence): KL of the suspects' rating levels (plus one) against the others', times the balance of their numbers.

    The middle level is dropped unless ``neutral``.
    """
    from .stats import kl_divergence

    a, b, c, d = RATING_EDGES
    r, s = F.col(rate), F.col("_u").isNotNull()
    marked = edges.join(users.select(F.col("id").alias("src"), F.lit(1).alias("_u")), "src", "left")
    levels = [(a, b), (b, c), (c, d)] if neutral else [(a, b), (c, d)]
    count = lambda side, k: F.count_if(side & (r >= levels[k][0]) & (r < levels[k][1]))
    g = marked.groupBy(F.col("dst").alias("sink")).agg(F.count_if(s).alias("ns"), F.count_if(~s).alias("no"), *[count(s, k).alias(f"s{k}") for k in range(len(levels))], *[count(~s, k).alias(f"o{k}") for k in range(len(levels))])
    p, q = [F.col(f"s{k}") + 1.0 for k in range(len(levels))], [F.col(f"o{k}") + 1.0 for k in range(len(levels))]
    x, y = F.col("ns") + 1.0, F.col("no") + 1.0
    return g.where("ns + no >= 2").select("sink", (kl_divergence(p, q) * F.least(x / y, y / x)).alias("divergence"))


def suspect_properties(edges: DataFrame, users: DataFrame, prop: str) -> DataFrame:
    """(sink, props array): property values of suspect users on sinks with two suspect edges or more."""
    own = edges.join(users.select(F.col("id").alias("src")), "src", "left_semi")
    return own.groupBy(F.col("dst").alias("sink")).agg(F.sort_array(F.collect_list(prop)).alias("props")).where(F.size("props") >= 2)


def add_suspects(now: DataFrame, edges: DataFrame, users: DataFrame, prop: str) -> DataFrame:
    """(sink, props array) after more suspects: only their edges are read. Give rows of all sinks, with any number of properties."""
    own = edges.join(users.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("sink")).agg(F.collect_list(prop).alias("_new"))
    both = now.join(own, "sink", "full")
    return both.select("sink", F.sort_array(F.concat(F.coalesce("props", F.array().cast(own.schema["_new"].dataType)), F.coalesce("_new", F.array().cast(own.schema["_new"].dataType)))).alias("props"))


def remove_suspects(now: DataFrame, edges: DataFrame, users: DataFrame, prop: str) -> DataFrame:
    """The same after suspects leave: each of their properties goes once."""
    own = edges.join(users.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("sink"), F.col(prop).alias("v"), F.lit(-1).alias("k"))
    all_ = now.select("sink", F.explode("props").alias("v"), F.lit(1).alias("k")).unionByName(own)
    left = all_.groupBy("sink", "v").agg(F.sum("k").alias("k")).where("k > 0").select("sink", F.explode(F.array_repeat("v", F.col("k").cast("int"))).alias("v"))
    return left.groupBy("sink").agg(F.sort_array(F.collect_list("v")).alias("props"))


def scale_by_max(df: DataFrame, c: str) -> DataFrame:
    top = df.agg(F.max(c).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(c, F.try_divide(F.col(c), F.col("_top"))).drop("_top")  # one row


def zip_properties(ts_edges: DataFrame, rate_edges: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """(src, dst, tbin, rate, w): times and ratings of an edge, taken in pairs, in time bins."""
    both = ts_edges.select("src", "dst", F.col("props").alias("ts")).join(rate_edges.select("src", "dst", F.col("props").alias("rate")), ["src", "dst"])
    rows = both.select("src", "dst", F.explode(F.arrays_zip("ts", "rate")).alias("x")).where("x.ts is not null and x.rate is not null")
    return rows.groupBy("src", "dst", F.floor(F.col("x.ts") / bin_seconds).cast("long").alias("tbin"), F.col("x.rate").cast("double").alias("rate")).agg(F.count("*").cast("double").alias("w"))
