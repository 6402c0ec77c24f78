"""Written tables that cut the lineage of iterative plans, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; a local session that names none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cairnmine-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def in_one_task(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df`` with a constant group ``_g``, for what is sequential by definition; refuses more than ``most`` rows (counted)."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} works in one task, on at most {most} rows")
    return df.withColumn("_g", F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a written table: survives lost executors, and plans stay short."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
