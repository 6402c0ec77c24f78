"""Time windows over event tables, and surge detection on window densities (batch and streaming)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import first_pair
from ..operators.stats import beyond, three_sigma_bound


def sliding(df: DataFrame, time: str, width: int, stride: int) -> DataFrame:
    """Rows with ``win``, once for every window that holds them: window k covers seconds [t0 + k * stride, + width)."""
    s = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000).cast("long")
    t = df.withColumn("_s", s)
    t = t.crossJoin(F.broadcast(t.agg(F.min("_s").alias("_t0"))))  # one row
    off = F.col("_s") - F.col("_t0")
    first = F.greatest(F.lit(0), F.floor((off - width) / stride) + 1)
    return t.withColumn("win", F.explode(F.sequence(first.cast("long"), F.floor(off / stride).cast("long")))).drop("_s", "_t0")


def batches(df: DataFrame, time: str, width: int, stride: int) -> DataFrame:
    """Rows with ``win``, each row once: batch 0 is ``width`` seconds long, later ones ``stride``."""
    s = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000).cast("long")
    t = df.withColumn("_s", s)
    t = t.crossJoin(F.broadcast(t.agg(F.min("_s").alias("_t0"))))  # one row
    off = F.col("_s") - F.col("_t0")
    return t.withColumn("win", F.when(off < width, F.lit(0)).otherwise(F.floor((off - width) / stride) + 1).cast("long")).drop("_s", "_t0")


def window_density(win: DataFrame, user: str, item: str, v: str | None = None) -> DataFrame:
    """(win, density): sum over (users + items), rounded to 2 places."""
    total = F.sum(v) if v else F.count("*")
    return win.groupBy("win").agg(F.round(total / (F.countDistinct(user) + F.countDistinct(item)), 2).alias("density"))


def surges(densities: DataFrame) -> DataFrame:
    """Windows above mean + 3 sample deviations of all windows."""
    return beyond(densities, "density", three_sigma_bound(densities, "density", population=False))


def eigenpulse(win: DataFrame, user: str, item: str, time_bin: str, v: str | None = None, seed: int = 1) -> DataFrame:
    """(win, n_users, n_columns, density) of the dense block of each window: entries of the first singular vectors of the
    user x (item, time) matrix, from a single-pass sketch, of at least 1 / sqrt(side). A task holds one window's non-zero cells."""
    cells = win.groupBy("win", F.col(user).cast("string").alias("u"), F.concat_ws(":", F.col(item).cast("string"), F.col(time_bin).cast("string")).alias("c")).agg((F.sum(v) if v else F.count("*")).cast("double").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "c"])
        us, i = np.unique(pdf["u"].to_numpy(str), return_inverse=True)
        cs, j = np.unique(pdf["c"].to_numpy(str), return_inverse=True)
        v = pdf["v"].to_numpy(float)
        x, _, y = first_pair(i, j, v, (len(us), len(cs)), seed=seed)
        r, c = np.abs(x) >= 1 / np.sqrt(len(us)), np.abs(y) >= 1 / np.sqrt(len(cs))
        n = int(r.sum() + c.sum())
        return pd.DataFrame({"win": [pdf["win"].iloc[0]], "n_users": [int(r.sum())], "n_columns": [int(c.sum())], "density": [round(float(v[r[i] & c[j]].sum()) / n, 2) if n else 0.0]})

    return cells.groupBy("win").applyInPandas(run, "win long, n_users long, n_columns long, density double")


def columns_of(found: DataFrame, key: str = "c") -> DataFrame:
    """Composite columns ``item:time`` as (item, time) again; the other columns stay."""
    parts = F.split(key, ":(?=[^:]*$)")
    return found.select(*[c for c in found.columns if c != key], parts[0].alias("item"), parts[1].alias("time"))


def stream_density(events: DataFrame, time: str, user: str, item: str, width: str, stride: str, late: str = "10 minutes") -> DataFrame:
    """The same densities on a stream: late rows are waited for, user and item counts are approximate as exact distinct
    counts aren't available on streams."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width, stride))
    g = w.agg(F.count("*").alias("n"), F.approx_count_distinct(user).alias("u"), F.approx_count_distinct(item).alias("i"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.round(F.col("n") / (F.col("u") + F.col("i")), 2).alias("density"))
