"""Bounds, tails, divergences and code lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import number, prefix_sums


def iqr_bound(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """(bound): ceil(q75 + k * (q75 - q25)), exact quantiles with linear interpolation."""
    q = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return q.select(F.ceil(F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).cast("double").alias("bound"))


def iqr_bound_existing(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """(bound): the largest value present that is not above the IQR bound."""
    b = iqr_bound(df, c, k)
    return df.join(F.broadcast(b), F.col(c) <= F.col("bound")).agg(F.max(c).cast("double").alias("bound"))  # one row


def three_sigma_bound(df: DataFrame, c: str, population: bool = True) -> DataFrame:
    dev = F.stddev_pop(c) if population else F.stddev_samp(c)
    return df.agg((F.avg(c) + 3 * dev).alias("bound"))


def beyond(df: DataFrame, c: str, bound: DataFrame) -> DataFrame:
    """Rows above a one-row bound."""
    return df.join(F.broadcast(bound), F.col(c) > F.col("bound")).select(*df.columns)


def pareto_tail(df: DataFrame, c: str, top: float = 0.9, p: float = 0.9) -> DataFrame:
    """Rows in the far tail: a Pareto law with scale min(x) and shape n / sum(ln(x / min)) is fitted to the positive values at
    or above the ``top`` quantile; rows whose distribution function is at least ``p`` stay. (Closed-form estimate.)"""
    pos = df.where(F.col(c) > 0)
    q = pos.agg(F.percentile(c, F.lit(top)).alias("q"))
    tail = pos.join(F.broadcast(q), F.col(c) >= F.col("q"))
    fit = tail.agg(F.min(c).cast("double").alias("m"), F.count("*").alias("n"), F.sum(F.ln(c)).alias("l"))
    fit = fit.select("m", F.try_divide(F.col("n"), F.col("l") - F.col("n") * F.ln("m")).alias("a"))
    cdf = 1 - F.pow(F.col("m") / F.col(c), F.col("a"))
    return tail.crossJoin(F.broadcast(fit)).where(F.when(F.col("a").isNull(), F.lit(False)).otherwise(cdf >= p)).select(*df.columns)


def largest_gap_cut(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Rows above the largest fall between neighbours in descending order of score (first such gap)."""
    ranked = number(df.withColumn("_neg", -F.col(score)), ["_neg", tie], "_k").drop("_neg")
    gap = ranked.alias("a").join(ranked.select((F.col("_k") - 1).alias("_k"), F.col(score).alias("_next")), "_k").select("_k", (F.col(score) - F.col("_next")).alias("g"))
    at = gap.agg(F.max_by("_k", F.struct("g", -F.col("_k"))).alias("_at"))
    return ranked.join(F.broadcast(at), F.col("_k") <= F.col("_at")).select(*df.columns)


def average_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """Descending rank, ties at their mean. Ranks come from counts by value, so equal scores are one row."""
    n = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    ranks = prefix_sums(n, [-F.col("_s")], {"_upto": F.col("_n")}).select("_s", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(score).eqNullSafe(F.col("_s"))).drop("_s")


def rank_fusion(df: DataFrame, scores: list[str], k: float = 60.0) -> DataFrame:
    """``fused``: sum of 1 / (k + average rank) over the scores."""
    total = F.lit(0.0)
    for i, s in enumerate(scores):
        df = average_rank(df, s, f"_r{i}")
        total = total + 1 / (k + F.col(f"_r{i}"))
    return df.withColumn("fused", total).drop(*[f"_r{i}" for i in range(len(scores))])


def kl_divergence(p: list[Column], q: list[Column]) -> Column:
    """Of two count vectors, each normalised."""
    sp, sq = sum(p[1:], p[0]), sum(q[1:], q[0])
    terms = [(a / sp) * F.ln((a / sp) / (b / sq)) for a, b in zip(p, q)]
    return sum(terms[1:], terms[0])


def xlogx(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c * F.ln(c))


def universal_length(n: int) -> float:
    """Bits of the universal code of integers: log2(2.865064) + log2 n + log2 log2 n + ..., positive terms; 0 for n <= 0."""
    if n <= 0:
        return 0.0
    total, x = math.log2(2.865064), float(n)
    while (x := math.log2(x)) > 0:
        total += x
    return total


def log_choose(n: int, k: int) -> float:
    """log2 of n over k."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)


def uniform_length(n: int, k: int) -> float:
    """Bits of n binary cells with k ones at their empirical frequency."""
    if n <= 0 or k <= 0 or k >= n:
        return 0.0
    return -(k * math.log2(k / n) + (n - k) * math.log2(1 - k / n))


def elias_bits(z: int) -> str:
    """Elias gamma code of a whole number through 0, -1, 1, -2, ... folding to positive."""
    n = 2 * z + 1 if z >= 0 else -2 * z
    b = bin(n)[2:]
    return "0" * (len(b) - 1) + b


def elias_length(c: Column) -> Column:
    """Length of ``elias_bits`` as a column expression."""
    n = F.when(c >= 0, 2 * c + 1).otherwise(-2 * c).cast("long")
    return (2 * F.length(F.bin(n)) - 1).cast("long")


def elias_decode(bits: str) -> list[int]:
    out, at = [], 0
    while at < len(bits):
        k = bits.index("1", at) - at
        n = int(bits[at + k : at + 2 * k + 1], 2)
        out.append((n - 1) // 2 if n % 2 else -(n // 2))
        at += 2 * k + 1
    return out


def code_length_of_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """(bits): code length of the rounded differences of two count columns."""
    return df.agg(F.sum(elias_length(F.round(F.col(a) - F.col(b)).cast("long"))).alias("bits"))
