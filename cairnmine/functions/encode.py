"""Column encoders: labels to dense ids and back, integer shifts, time bins, score bins, bin edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import cut


def dictionary(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(label, id): ids 0.. by first appearance in ``order``; several columns share one id space, earlier columns first.

    Numbering sorts the distinct labels only, after a grouped minimum.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("label")) for k, c in enumerate(columns)]))
    rows = df.select(F.struct(*order).alias("o"), slots.alias("s")).where("s.label is not null")
    first = rows.groupBy(F.col("s.label").alias("label")).agg(F.min(F.struct("o", "s.k")).alias("at"))
    return number(first, ["at", "label"], "id").select("label", "id")


def prefix_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums (the row included) in a total order: sums inside ranges, plus the totals of the ranges before.

    The ranges are a written table, so that both uses see the same ones; no task holds more than one range, and the totals
    are one row for each range.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({k: (F.col(c) if isinstance(c, str) else c) for k, c in zip(keys, order)} | {f"_v{i}": c for i, c in enumerate(sums.values())})
    ranged = cut(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    upto = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    n = len(sums)
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(n)])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(n)])
    own = ranged.select("*", *[F.sum(f"_v{i}").over(upto).alias(f"_r{i}") for i in range(n)]).join(offsets, "_part")
    return own.select(*df.columns, *[(F.col(f"_r{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(sums)])


def number(df: DataFrame, order: Sequence[str | Column], name: str = "id") -> DataFrame:
    """A gapless number from 0 in a total order."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")}).withColumn(name, (F.col(name) - 1).cast("long"))


def encode(df: DataFrame, dic: DataFrame, column: str, out: str) -> DataFrame:
    return df.join(dic.select(F.col("label").alias("_l"), F.col("id").alias(out)), F.col(column).cast("string") == F.col("_l"), "left").drop("_l")


def decode(df: DataFrame, dic: DataFrame, column: str, out: str) -> DataFrame:
    return df.join(dic.select(F.col("id").alias("_i"), F.col("label").alias(out)), F.col(column) == F.col("_i"), "left").drop("_i")


def shift_ints(df: DataFrame, column: str, out: str) -> DataFrame:
    """Integers that begin at 0; the least value stays in ``<out>_min`` for the way back."""
    low = df.agg(F.min(column).alias(f"{out}_min"))
    return df.crossJoin(F.broadcast(low)).withColumn(out, F.col(column) - F.col(f"{out}_min"))  # one row


def unshift_ints(df: DataFrame, column: str, least: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(column) + F.col(least))


def epoch_seconds(c: Column, fmt: str | None = None) -> Column:
    """Seconds since 1970 (UTC session) of a timestamp of either kind, or of a string in a given format."""
    t = F.to_timestamp(c, fmt) if fmt else c.cast("timestamp")
    return F.floor(F.unix_micros(t) / 1_000_000).cast("long")


def time_bins(df: DataFrame, column: str, out: str, width: int = 86400, fmt: str | None = None) -> DataFrame:
    """Bins of ``width`` seconds from the earliest time; ``<out>_min`` is its second."""
    s = df.withColumn("_s", epoch_seconds(F.col(column), fmt))
    low = s.agg(F.min("_s").alias(f"{out}_min"))
    return s.crossJoin(F.broadcast(low)).withColumn(out, F.floor((F.col("_s") - F.col(f"{out}_min")) / width).cast("long")).drop("_s")


def bin_middle(bin_: Column, least: Column, width: int = 86400) -> Column:
    """The middle of a bin as a timestamp."""
    return F.timestamp_seconds(bin_ * width + least + width // 2)


def score_bin(c: Column, edges: Sequence[float]) -> tuple[Column, Column]:
    """(bin, residual): how many edges are at or below the score, and the score minus its bin's lower edge (the score itself below all)."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    b = F.size(F.filter(arr, lambda e: e <= c))
    return b.cast("long"), c - F.when(b > 0, F.element_at(arr, F.greatest(b, F.lit(1)))).otherwise(0.0)


def score_unbin(b: Column, residual: Column, edges: Sequence[float]) -> Column:
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return residual + F.when(b > 0, F.element_at(arr, F.greatest(b.cast("int"), F.lit(1)))).otherwise(0.0)


def log2_bin(c: Column) -> Column:
    """floor(log2(x + 1)) of whole x >= 0, exactly (the length of the binary form)."""
    return (F.length(F.bin(c.cast("long") + 1)) - 1).cast("long")


def equal_edges(low: float, high: float, n: int, log: bool = False, base: float = 10.0) -> list[float]:
    """n + 1 edges of equal width, of the values or their logarithms."""
    if log:
        a, b = math.log(low, base), math.log(high, base)
        return [base ** (a + (b - a) * k / n) for k in range(n + 1)]
    return [low + (high - low) * k / n for k in range(n + 1)]


def log_edges(high: float, base: float) -> list[float]:
    """Powers of the base from 1 until one reaches ``high``."""
    out = [1.0]
    while out[-1] < high:
        out.append(out[-1] * base)
    return out


def degree_edges(high: int, base: float = 10.0, per_decade: int = 10) -> list[float]:
    """1, 2 ... 10 and then logarithmic steps whose widths never shrink."""
    out, k = [float(x) for x in range(1, 11)], 1
    while out[-1] < high:
        nxt = float(math.ceil(10 * base ** (k / per_decade)))
        k += 1
        if nxt - out[-1] >= out[-1] - out[-2]:
            out.append(nxt)
    return out


def cell_of(c: Column, ticks: Sequence[float]) -> Column:
    """First tick at or above the value; beyond the last tick, the last cell."""
    arr = F.array(*[F.lit(float(t)) for t in ticks])
    return F.least(F.size(F.filter(arr, lambda t: t < c)), F.lit(len(ticks) - 1)).cast("long")
