"""Contiguous byte-balanced shards from global prefix sums.

Rows are put in one global order (id, checksum, size) by a range exchange of the small columns; every range partition
gives its totals of bytes and rows, the totals' prefix sums are the partitions' offsets, and a row's place is its
partition's offset plus the running sum inside. Shard borders are the equal targets i * total / shards: a row belongs
to the shard in which its middle byte falls, so shards are contiguous and each size is within one row of the target.
The totals are one row for each partition; they are joined, not collected. All DataFrame functions.

Defined cases: a null text has no bytes (size 8, checksum 0); a null id sorts first; equal rows are interchangeable;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

OVERHEAD = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; law is ``bytes``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size_of(F.col(text_col)).alias("size"), crc_of(F.col(text_col)).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    salt = F.xxhash64(F.monotonically_increasing_id())
    ranged = rows.withColumn("salt", salt).repartitionByRange(*order, "salt").withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"))
    total = totals.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("total"))
    offsets = scratch.write(offsets.join(total), "offsets")
    inside = W.partitionBy("part").orderBy(*order, "salt")
    run = ranged.select("*", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("b1"), F.row_number().over(inside).alias("c1"))
    placed = run.join(offsets, "part").select("doc_id", "size", "text_crc32", "total", (F.col("b0") + F.col("b1")).alias("end"), (F.col("c0") + F.col("c1") - 1).alias("at"))
    middle = F.expr(f"least({shards - 1}, ((2 * end - size) * {shards}) div (2 * total))").cast("int")
    placed = scratch.write(placed.withColumn("shard", middle).select("doc_id", "size", "text_crc32", "shard", "at"), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # as many rows as shards
    scratch.drop(ranged, offsets)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows to ``path`` by shard, in slot order. Rows with equal id, text and size are interchangeable."""
    key = [F.col(id_col).cast("long").alias("doc_id"), crc_of(F.col(text_col)).alias("text_crc32"), size_of(F.col(text_col)).alias("size")]
    nth = lambda order: F.row_number().over(W.partitionBy("doc_id", "text_crc32", "size").orderBy(order))
    place = assign(docs, shards, id_col, text_col).withColumn("nth", nth(F.struct("shard", "slot")))
    rows = docs.select("*", *[k.alias(f"_{i}") for i, k in enumerate(key)])
    rows = rows.withColumn("_3", F.row_number().over(W.partitionBy("_0", "_1", "_2").orderBy(text_col)))
    both = rows.join(place, (F.col("_0").eqNullSafe(F.col("doc_id") if id_col != "doc_id" else place["doc_id"])) & (F.col("_1") == place["text_crc32"]) & (F.col("_2") == place["size"]) & (F.col("_3") == place["nth"]))
    both = both.select(*[rows[c] for c in docs.columns], place["shard"].alias("_shard"), place["slot"].alias("_slot"))
    both.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
