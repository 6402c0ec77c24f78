"""Shared plumbing: table readers, written intermediate tables, components and streaming over sorted partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local session that names none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cairnmine-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Edges of a graph that one task may finish (two longs each).
LOCAL_EDGES = 500_000


class Scratch:
    """Written tables that cut lineage. They are in the shared folder, so a lost executor loses nothing of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/cairnmine/{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes the files of written tables that nothing will read again."""
        jvm = self.spark._jvm
        for df in dfs:
            if path := getattr(df, "_cairn_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than it needs to tell."""
    return df.limit(limit + 1).count() <= limit


def smallest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the least ``h``, a hash that differs between rows. Rows that can't be among them are left out
    before the sort, so that no task gets n rows of every partition."""
    total = rows.count()
    share = min(1.0, 2.0 * n / total + 100.0 / total) if total else 1.0
    few = rows.where(fraction(F.col("h")) < share) if share < 1 else rows
    if share < 1 and few.count() < n:
        few = rows
    return few.orderBy(F.shiftrightunsigned("h", 11), "h").limit(n)


def arrow_rows(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From a partition sorted by ``key``: tables that end where a key ends, so that no key is in two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def per_key(df: DataFrame, key: str, f: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deals rows out by ``key`` (a long), sorts, and streams whole keys through ``f``; many small keys cost one call."""
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(lambda it: f(arrow_rows(it, key)), schema)


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one partition."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    ids, ends = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
    a, b = np.split(ends.reshape(-1), 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) for each id in an edge; component is the least id.

    Alternates large-star and small-star steps (each a grouped minimum and a join), which need a logarithmic number of
    rounds. Every round's edges are a written table; minima are written too, so both join sides are plain shuffles and
    a hub's rows can be split by adaptive execution. Once at most ``LOCAL_EDGES`` distinct edges are left (counted, 8 MB)
    one task finishes them in memory; the result is the same either way.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.write(e, "edges")
    before = None
    while True:
        if e.count() <= LOCAL_EDGES:
            return scratch.write(e.coalesce(1).mapInArrow(_finish, "id long, component long"), "components")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = scratch.write(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low2 = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "low2")
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        new = scratch.write(small.where("a <> b").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e, low, large, low2)
        e = new
        if state == before:
            break
        before = state
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def fraction(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
