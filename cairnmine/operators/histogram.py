"""Histograms of any number of features, two-feature grids on logarithmic edges, and their peaks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import cell_of, degree_edges, equal_edges


def ticks(df: DataFrame, features: Sequence[str], degree: str | None = None, bins: int = 80, base: float = 10.0, log: bool = True) -> dict[str, list[float]]:
    """Edges by feature: degree-like ones from 1 on with logarithmic steps, others equal (of logarithms). Two scalars each reach the driver."""
    ends = df.agg(*[F.min(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"b{i}") for i, f in enumerate(features)]).first()
    out = {}
    for i, f in enumerate(features):
        lo, hi = ends[f"a{i}"], ends[f"b{i}"]
        if lo is None:
            out[f] = [0.0]
        else:
            out[f] = degree_edges(hi, base) if f == degree else equal_edges(float(lo), float(hi), bins, log and lo > 0, base) if hi > lo else [float(lo)]
    return out


def assign(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Rows with ``cell`` (array of cell numbers); rows with a feature that isn't positive are left out."""
    pos = df
    for f in edges:
        pos = pos.where(F.col(f) > 0)
    return pos.withColumn("cell", F.array(*[cell_of(F.col(f), t) for f, t in edges.items()]))


def cells(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cell, n, avg_<feature> ...)."""
    return assigned.groupBy("cell").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"avg_{f}") for f in features])


def log_grid(df: DataFrame, x: str, y: str, grid: int = 20) -> DataFrame:
    """Rows (x, y > 0) with bx, by: cells of ``grid`` logarithmic steps from 1 to the next power of ten, exact at the edges."""
    top = df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.max(x), F.max(y)).first()
    pos = df.where((F.col(x) > 0) & (F.col(y) > 0))
    for c, hi, name in ((x, top[0], "bx"), (y, top[1], "by")):
        high = max(1, math.ceil(math.log10(hi))) if hi and hi > 1 else 1
        edges = [10 ** (high * k / grid) for k in range(grid + 1)]
        arr = F.array(*[F.lit(e) for e in edges])
        pos = pos.withColumn(name, F.greatest(F.lit(0), F.least(F.size(_at_most(arr, F.col(c))) - 1, F.lit(grid - 1))).cast("long"))
    return pos


def _at_most(edges: Column, v: Column) -> Column:
    return F.filter(edges, lambda e: e <= v)


def grid_counts(binned: DataFrame) -> DataFrame:
    """(bx, by, n) of cells with rows."""
    return binned.groupBy("bx", "by").agg(F.count("*").alias("n"))


def peak_near(counts: DataFrame, bx: int, by: int, radius: int) -> DataFrame:
    """(bx, by, n): the fullest cell within ``radius`` of a cell, ties to the lowest."""
    near = counts.where(F.col("bx").between(bx - radius, bx + radius) & F.col("by").between(by - radius, by + radius))
    best = near.agg(F.max_by(F.struct("bx", "by", "n"), F.struct("n", -F.col("bx"), -F.col("by"))).alias("x"))
    return best.where("x is not null").select("x.*")


def points_in(df: DataFrame, x: str, y: str, xs: tuple[float, float], ys: tuple[float, float]) -> DataFrame:
    """Distinct points of a closed rectangle."""
    return df.where(F.col(x).between(*xs) & F.col(y).between(*ys)).select(x, y).distinct()
