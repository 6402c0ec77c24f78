"""Series models: vocabulary segmentation by dynamic time warping, reconstruction scores, beat detection, metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.encode import prefix_sums


def warp_cost(model: np.ndarray, data: np.ndarray, band: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """(cost, path) of matching two (length, dims) arrays: squared distances, plus std(model) log2(M) for a repeated data
    step and std(data) log2(N) for a repeated model step."""
    m, n = len(model), len(data)
    band = max(band if band is not None else max(m, n), abs(m - n) + 1)
    spread = lambda x: float(x.std(axis=0, ddof=1).sum()) if len(x) > 1 else 0.0
    skip_m, skip_n = spread(model) * math.log2(max(m, 2)), spread(data) * math.log2(max(n, 2))
    d = ((model[:, None, :] - data[None, :, :]) ** 2).sum(axis=2)
    cost = np.full((m + 1, n + 1), np.inf)
    cost[0, 0] = 0
    move = np.zeros((m + 1, n + 1), np.int8)
    for i in range(1, m + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            options = (cost[i - 1, j - 1], cost[i - 1, j] + skip_m, cost[i, j - 1] + skip_n)
            k = int(np.argmin(options))
            move[i, j] = k
            cost[i, j] = options[k] + d[i - 1, j - 1]
    path, i, j = [], m, n
    while i and j:
        path.append((i - 1, j - 1))
        i, j = (i - 1, j - 1) if move[i, j] == 0 else (i - 1, j) if move[i, j] == 1 else (i, j - 1)
    return float(cost[m, n]), path[::-1]


def segment(x: np.ndarray, smin: int, smax: int, most_models: int = 10, new_cost: float = 0.3, band: int | None = None) -> tuple[list[tuple[int, int, int, float]], list[np.ndarray]]:
    """((start, end, model, cost) of consecutive segments, models). A piece that no model matches at less than ``new_cost``
    of its variance becomes a model; a model that matches moves towards the piece."""
    models: list[np.ndarray] = []
    used: list[int] = []
    out, at, n = [], 0, len(x)
    total = float(((x - x.mean(axis=0)) ** 2).sum() / max(n, 1)) or 1.0
    lengths = sorted({smin, smax, *np.linspace(smin, smax, 5).astype(int).tolist()})
    while at < n:
        if n - at < smin:
            if out:
                s, _, k, c = out[-1]
                out[-1] = (s, n, k, c)
                break
            lengths = [n - at]
        best = (np.inf, None, None, None)
        for size in lengths:
            if at + size > n:
                break
            piece = x[at : at + size]
            for k, mod in enumerate(models):
                c, path = warp_cost(mod, piece, band)
                c /= size
                if c < best[0]:
                    best = (c, k, size, path)
        if (best[1] is None or best[0] > new_cost * total) and len(models) < most_models:
            size = next((s for s in (int(np.median(lengths)),) if at + s <= n), n - at)
            models.append(x[at : at + size].copy())
            used.append(1)
            out.append((at, at + size, len(models) - 1, 0.0))
            at += size
            continue
        if best[1] is None:  # less is left than the shortest candidate takes
            best = (np.inf, 0, n - at, [])
        c, k, size, path = best
        mean = {}
        for i, j in path:
            mean.setdefault(i, []).append(x[at + j])
        for i, v in mean.items():
            models[k][i] += (np.mean(v, axis=0) - models[k][i]) / (used[k] + 1)
        used[k] += 1
        out.append((at, at + size, k, float(c)))
        at += size
    return out, models


def beatlex(df: DataFrame, smin: int, smax: int, most_models: int = 10, new_cost: float = 0.3, band: int | None = None) -> DataFrame:
    """(series, start, end, model, cost) of ``df`` (series, pos, v array<double>). Sequential along a series: one task each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, _ = segment(np.stack(pdf["v"].to_numpy()).astype(float), smin, smax, most_models, new_cost, band)
        s, e, k, c = zip(*out) if out else ((), (), (), ())
        return pd.DataFrame({"series": [pdf["series"].iloc[0]] * len(s), "start": s, "end": e, "model": k, "cost": c})

    return df.groupBy("series").applyInPandas(run, "series string, start long, end long, model long, cost double")


def principal_components(df: DataFrame, k: int = 4, v: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of rows with equal-length arrays; the covariance is a grouped sum in Spark, its size is by dimension."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    n = df.select(F.size(v)).first()[0]
    mean = np.array(df.select(Summarizer.mean(array_to_vector(F.col(v).cast("array<double>"))).alias("m")).first()["m"])

    def partial(batches):
        total = np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(n), "row": list(total)})

    rows = df.select(F.col(v).cast("array<double>").alias("v")).mapInPandas(partial, "i long, row array<double>")
    total = rows.select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    cov = np.zeros((n, n))
    for r in total:
        cov[r["i"], r["j"]] = r["c"]
    w, vec = np.linalg.eigh(cov)
    return mean, vec[:, np.argsort(-w)[:k]].T


def reconstruction_scores(df: DataFrame, mean: np.ndarray, comps: np.ndarray, scale: bool = True, v: str = "v", id_col: str = "id") -> DataFrame:
    """(id, score): mean squared error of each row against its projection (a linear reconstructor, not an adversarial network);
    scaled to 0..1 over all rows if ``scale``."""

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float) - mean if len(pdf) else np.zeros((0, len(mean)))
            e = x - (x @ comps.T) @ comps
            yield pd.DataFrame({"id": pdf["id"], "score": (e**2).mean(axis=1)})

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).mapInPandas(run, "id long, score double")
    if not scale:
        return out
    ends = out.agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    return out.crossJoin(F.broadcast(ends)).select("id", F.coalesce(F.try_divide(F.col("score") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)).alias("score"))  # one row


def segment_scores(df: DataFrame) -> DataFrame:
    """(seg, score): mean over steps of the squared errors summed over dimensions, for rows (seg, dim, step, v, fitted)."""
    return df.groupBy("seg", "step").agg(F.sum(F.pow(F.col("v") - F.col("fitted"), 2)).alias("e")).groupBy("seg").agg(F.avg("e").alias("score"))


def evaluate(scored: DataFrame) -> DataFrame:
    """(auc_roc, auc_pr, best_f1, threshold) of rows (label 0/1, score); ranks come from counts by score."""
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    c = prefix_sums(by, [-F.col("score")], {"tp": F.col("p"), "k": F.col("n")})
    t = c.crossJoin(by.agg(F.sum("p").alias("all_p"), F.sum(F.col("n") - F.col("p")).alias("all_n")))  # one row
    fp, neg = F.col("k") - F.col("tp"), F.col("n") - F.col("p")
    roc = F.sum(neg * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_n"))
    pr = F.sum(F.col("p") / F.col("all_p") * (F.col("tp") / F.col("k")))
    f1 = 2 * F.col("tp") / (F.col("k") + F.col("all_p"))
    return t.withColumn("fp", fp).agg(roc.alias("auc_roc"), pr.alias("auc_pr"), F.max(f1).alias("best_f1"), F.max_by("score", F.struct(f1, "score")).alias("threshold"))


def peaks(df: DataFrame, least_gap: int = 1, height: float | None = None) -> DataFrame:
    """(series, pos, v): local maxima of (series, pos, v) not below ``height`` (default: mean + 2 deviations of the series), of
    which those within ``least_gap`` of a higher one are left out."""
    w = W.partitionBy("series").orderBy("pos")
    x = df.withColumn("_l", F.lag("v").over(w)).withColumn("_r", F.lead("v").over(w))
    if height is None:
        x = x.join(df.groupBy("series").agg((F.avg("v") + 2 * F.stddev_pop("v")).alias("_h")), "series")
    else:
        x = x.withColumn("_h", F.lit(height))
    top = x.where("v > _l and v >= _r and v >= _h").select("series", "pos", "v")
    near = W.partitionBy("series").orderBy("pos").rangeBetween(-least_gap, least_gap)
    return top.withColumn("_m", F.max(F.struct("v", F.negative("pos").alias("p"))).over(near)).where("_m.v = v and _m.p = -pos").select("series", "pos", "v")


def beat_segments(df: DataFrame, found: DataFrame, before: int = 120, after: int = 136) -> DataFrame:
    """(series, peak, step, v): the window [peak - before, peak + after) around each peak that has all of it."""
    steps = found.select("series", F.col("pos").alias("peak"), F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("step"))
    cut = steps.join(df, (steps["series"] == df["series"]) & (df["pos"] == F.col("peak") + F.col("step"))).select(steps["series"], "peak", "step", "v")
    whole = cut.groupBy("series", "peak").agg(F.count("*").alias("n")).where(F.col("n") == before + after)
    return cut.join(whole.drop("n"), ["series", "peak"])
