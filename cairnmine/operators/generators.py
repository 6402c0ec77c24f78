"""Seeded planted-truth graphs: blocks, camouflage, noise, permutations, ratings and times. Random numbers come from hashes of
ids, so a graph doesn't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import number
from ..functions.tensor import grid


def uniform(seed: int, *cols) -> Column:
    """A number from 0 up to 1 for each combination of column values."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / float(1 << 53)


def _block(spark: SparkSession, a: int, b: int, a0: int, b0: int) -> DataFrame:
    return grid(spark, (a, b)).select((F.col("i0") + a0).alias("src"), (F.col("i1") + b0).alias("dst"))


def even_block(spark: SparkSession, a: int, b: int, p: float, seed: int = 0, a0: int = 0, b0: int = 0) -> DataFrame:
    """(src, dst, w): every cell with probability p."""
    return _block(spark, a, b, a0, b0).where(uniform(seed, "src", "dst") < p).withColumn("w", F.lit(1.0))


def hyperbolic_block(spark: SparkSession, a: int, b: int, alpha: float = -0.5, tau: float = 0.1, a0: int = 0, b0: int = 0) -> DataFrame:
    """Cells with (i + 1)^alpha * (j + 1)^alpha > tau."""
    i, j = F.col("src") - a0 + 1, F.col("dst") - b0 + 1
    return _block(spark, a, b, a0, b0).where(F.pow(i, alpha) * F.pow(j, alpha) > tau).withColumn("w", F.lit(1.0))


def two_blocks(spark: SparkSession, a1: int, b1: int, a2: int, b2: int, alpha: float = -0.5, tau: float = 0.1, p: float = 1.0, seed: int = 0) -> DataFrame:
    """A hyperbolic and an even block on the diagonal."""
    return hyperbolic_block(spark, a1, b1, alpha, tau).unionByName(even_block(spark, a2, b2, p, seed, a1, b1))


def add_noise(edges: DataFrame, a: int, b: int, p: float, seed: int = 1, add: bool = True, a0: int = 0, b0: int = 0) -> DataFrame:
    """Adds each cell of a range with probability p, or removes edges of the range with it."""
    if not add:
        inside = F.col("src").between(a0, a0 + a - 1) & F.col("dst").between(b0, b0 + b - 1)
        return edges.where(~(inside & (uniform(seed, "src", "dst") < p)))
    return edges.unionByName(even_block(edges.sparkSession, a, b, p, seed, a0, b0)).groupBy("src", "dst").agg(F.max("w").alias("w"))


def inject_block(edges: DataFrame, m0: int, n0: int, p: float, camouflage: int = 0, seed: int = 2) -> DataFrame:
    """Plants a block on rows 0..m0-1 and columns 0..n0-1. Camouflage: 1 random other columns as many as inside, 2 twice
    as likely on popular columns, 3 copies of other rows' columns."""
    spark = edges.sparkSession
    out = edges.unionByName(even_block(spark, m0, n0, p, seed))
    cols = edges.where(F.col("dst") >= n0).groupBy("dst").agg(F.count("*").alias("d"))
    rows = spark.range(m0).withColumnRenamed("id", "src")
    n = max(1, cols.count())
    if camouflage in (1, 2):
        share = F.lit(p * n0 / n) if camouflage == 1 else F.least(F.lit(1.0), F.col("d") * (p * n0) / F.lit(float(max(1, edges.count()))))
        extra = rows.crossJoin(cols).where(uniform(seed + 1, "src", "dst") < share)  # planted rows are few
        out = out.unionByName(extra.select("src", "dst", F.lit(1.0).alias("w")))
    elif camouflage == 3:
        other = edges.where((F.col("src") >= m0) & (F.col("dst") >= n0))
        out = out.unionByName(other.withColumn("src", F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(m0))).where(uniform(seed + 2, "src", "dst") < 0.5).select("src", "dst", "w"))
    return out.groupBy("src", "dst").agg(F.max("w").alias("w"))


def shuffle_ids(edges: DataFrame, seed: int = 3) -> DataFrame:
    """A random permutation of rows and of columns."""
    out = edges
    for c, s in (("src", seed), ("dst", seed + 1)):
        ids = edges.select(c).distinct().withColumn("_u", F.xxhash64(c, F.lit(s)))
        new = number(ids, ["_u", c], "_n").select(c, "_n")
        out = out.join(new, c).drop(c).withColumnRenamed("_n", c)
    return out.select("src", "dst", "w")


def with_properties(edges: DataFrame, t0: int, span: int, seed: int = 4) -> DataFrame:
    """Edges with ``rate`` 4 or 4.5 and ``ts`` in a short span: planted ratings and times."""
    return edges.withColumn("rate", F.when(uniform(seed, "src", "dst") < 0.5, 4.0).otherwise(4.5)).withColumn("ts", (F.lit(t0) + F.floor(uniform(seed + 1, "src", "dst") * span)).cast("long"))
