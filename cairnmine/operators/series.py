"""Multivariate time series as wide tables (series, pos, t, one column a dimension)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import epoch_seconds, number


@dataclass(frozen=True)
class Series:
    """``df`` has pos (from 0), t and the labelled columns; t = start + pos / freq unless given."""

    df: DataFrame
    labels: tuple[str, ...]
    freq: float = 1.0
    start: float = 0.0

    @classmethod
    def of(cls, df: DataFrame, order: str, labels: Sequence[str], freq: float = 1.0, start: float = 0.0, own_time: bool = True) -> Series:
        """Positions by ``order``, which is the time column unless ``own_time`` is false."""
        rows = number(df.select(F.col(order).alias("_o"), *labels), ["_o", *labels], "pos")
        t = F.col("_o").cast("double") if own_time else F.lit(float(start)) + F.col("pos") / freq
        return cls(rows.select("pos", t.alias("t"), *labels), tuple(labels), freq, start)

    def _with(self, df: DataFrame, labels: Sequence[str] | None = None, **changed) -> Series:
        labels = tuple(labels or self.labels)
        return replace(self, df=df.select("pos", "t", *labels), labels=labels, **changed)

    def extract(self, labels: Sequence[str]) -> Series:
        return self._with(self.df, labels)

    def cut(self, start: float | None = None, end: float | None = None, form: str = "point", labels: Sequence[str] | None = None) -> Series:
        """Positions or times from start up to end (exclusive); positions begin anew. Out of range raises."""
        n = self.df.count()
        place = (lambda x: int((x - self.start) * self.freq)) if form == "time" else int
        lo, hi = 0 if start is None else place(start), n if end is None else place(end)
        if not 0 <= lo <= hi <= n:
            raise IndexError(f"{lo}..{hi} is not in 0..{n}")
        part = self.df.where((F.col("pos") >= lo) & (F.col("pos") < hi)).withColumn("pos", F.col("pos") - lo)
        return self._with(part, labels, start=self.start + lo / self.freq)

    def normalize(self, labels: Sequence[str] | None = None) -> Series:
        """Each column to [-1, 1] by its least and largest value; constant columns become null."""
        cols = list(labels or self.labels)
        ends = self.df.agg(*[F.min(c).alias(f"_a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"_b{i}") for i, c in enumerate(cols)])
        df = self.df.crossJoin(F.broadcast(ends))  # one row
        for i, c in enumerate(cols):
            a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
            df = df.withColumn(c, F.try_divide(2 * (F.col(c) - (a + b) / 2), b - a))
        return self._with(df)

    def add_columns(self, **values) -> Series:
        """Constants, columns of this table, or tables (pos, v)."""
        df = self.df
        for name, v in values.items():
            if isinstance(v, DataFrame):
                df = df.join(v.select("pos", F.col("v").alias(name)), "pos", "left")
            else:
                df = df.withColumn(name, F.lit(v))
        return self._with(df, [*self.labels, *values])

    def concat(self, *others: Series) -> Series:
        """Rows of series with equal labels, one after the other; the time axis is made anew."""
        parts, at = [], 0
        for s in (self, *others):
            if s.labels != self.labels:
                raise ValueError("labels differ")
            parts.append(s.df.withColumn("pos", F.col("pos") + at))
            at += s.df.count()
        df = fold(DataFrame.unionByName, parts)
        return self._with(df.withColumn("t", F.lit(float(self.start)) + F.col("pos") / self.freq))

    def combine(self, *others: Series) -> Series:
        """Columns of series of equal frequency side by side; clashing labels get _1, _2, ..."""
        df, labels = self.df, list(self.labels)
        for s in others:
            if s.freq != self.freq:
                raise ValueError("frequencies differ")
            names = {}
            for c in s.labels:
                name, k = c, 0
                while name in labels or name in names.values():
                    k += 1
                    name = f"{c}_{k}"
                names[c] = name
            df = df.join(s.df.select("pos", *[F.col(c).alias(n) for c, n in names.items()]), "pos")
            labels += names.values()
        return self._with(df, labels)

    def resample(self, freq: float) -> Series:
        """Fourier resampling of every column to int(n / old * new) points, one task a column."""
        n, old, start, labels = self.df.count(), self.freq, self.start, self.labels
        m = int(n / old * freq)
        long = self.df.select("pos", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("v")) for c in labels])).alias("x")).select("pos", "x.label", "x.v")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("pos")["v"].to_numpy()
            return pd.DataFrame({"pos": np.arange(m), "label": pdf["label"].iloc[0], "v": fourier_resample(x, m)})

        out = long.groupBy("label").applyInPandas(run, "pos long, label string, v double")
        wide = out.groupBy("pos").pivot("label", list(labels)).agg(F.first("v"))
        return Series(wide.withColumn("t", F.lit(float(start)) + F.col("pos") / freq).select("pos", "t", *labels), labels, freq, start)


def fourier_resample(x: np.ndarray, m: int) -> np.ndarray:
    n = len(x)
    if not n or not m:
        return np.zeros(m)
    y, out = np.fft.rfft(x), np.zeros(m // 2 + 1, complex)
    k = min(n, m)
    out[: k // 2 + 1] = y[: k // 2 + 1]
    if k % 2 == 0 and n != m:
        out[k // 2] *= 2 if m < n else 0.5
    return np.fft.irfft(out, m) * (m / n)


def log_to_series(df: DataFrame, time: str, group: str, value: str | None = None, bins: int = 10, fmt: str | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """(bin, t, one column a group): sums (or counts) in equal time bins, empty bins as zeros. Groups are listed or few."""
    rows = df.select(epoch_seconds(F.col(time), fmt).alias("_s"), F.col(group).cast("string").alias("_g"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("_v"))
    ends = rows.agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.withColumn("bin", F.least(F.coalesce(F.floor(F.try_divide((F.col("_s") - F.col("_a")) * bins, F.col("_b") - F.col("_a"))), F.lit(0)), F.lit(bins - 1)).cast("long"))
    names = list(groups) if groups else [r[0] for r in rows.select("_g").where("_g is not null").distinct().orderBy("_g").collect()]
    wide = rows.groupBy("bin").pivot("_g", names).agg(F.sum("_v"))
    full = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    return full.join(wide, "bin", "left").select("bin", (F.col("_a") + F.col("bin") * width).alias("t"), *[F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(g) for g in names])


def times_by_key(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(key, ts array sorted): keys joined by commas."""
    return df.groupBy(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("key")).agg(F.sort_array(F.collect_list(epoch_seconds(F.col(time)))).alias("ts"))
