"""Writers: tables as Parquet, and the text forms that the readers take back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_lists(df: DataFrame, path: str, key: str = "key", values: str = "values", sep: str = ":", mode: str = "error") -> None:
    """Lines ``key:v1 v2 ...``; empty lists are skipped. A path that ends in .gz is compressed."""
    line = F.concat_ws(sep, F.col(key).cast("string"), F.array_join(F.col(values).cast("array<string>"), " "))
    _text(df.where(F.size(values) > 0).select(line.alias("value")), path, mode)


def save_dict(df: DataFrame, path: str, key: str = "key", value: str = "value", sep: str = ":", mode: str = "error") -> None:
    _text(df.select(F.concat_ws(sep, F.col(key).cast("string"), F.col(value).cast("string")).alias("value")), path, mode)


def save_values(df: DataFrame, path: str, value: str = "value", mode: str = "error") -> None:
    _text(df.select(F.col(value).cast("string").alias("value")), path, mode)


def save_matrix(df: DataFrame, path: str, v: str = "v", sep: str = " ", mode: str = "error") -> None:
    _text(df.select(F.array_join(F.col(v).cast("array<string>"), sep).alias("value")), path, mode)


def save_edges(edges: DataFrame, path: str, weighted: bool = True, one_based: bool = False, sep: str = " ", mode: str = "error") -> None:
    shift = 1 if one_based else 0
    cols = [(F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst")] + ([F.col("w")] if weighted else [])
    edges.select(*cols).write.mode(mode).option("sep", sep).csv(path)


def save_features(df: DataFrame, path: str, columns: list[str], sep: str = ",", header: bool = False, mode: str = "error") -> None:
    """Degree and score rows, or any other columns."""
    df.select(*columns).write.mode(mode).option("sep", sep).option("header", header).csv(path)


def save_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Results of detectors; appended by default."""
    blocks.write.mode(mode).parquet(path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_histogram(cells: DataFrame, shape: tuple[int, ...], ticks: list[list[float]], path: str, cell: str = "cell", n: str = "n", sep: str = ",", mode: str = "error") -> None:
    """Head lines (shape, ticks) and then one line a cell, as ``load_histogram`` reads them."""
    spark = cells.sparkSession
    head = ["# " + sep.join(map(str, shape)), *["# " + sep.join(map(repr, t)) for t in ticks]]
    top = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "o long, value string")
    body = cells.select(F.lit(len(head)).cast("long").alias("o"), F.concat_ws(sep, F.array_join(F.col(cell).cast("array<string>"), sep), F.col(n).cast("string")).alias("value"))
    top.unionByName(body).repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode(mode).text(path)


def save_point_cells(points: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """One line a point, in order of ``id``: its cell. ``points``: (id, cell array)."""
    _text(points.repartitionByRange("id").sortWithinPartitions("id").select(F.array_join(F.col("cell").cast("array<string>"), sep).alias("value")), path, mode)


def save_cell_features(cells: DataFrame, path: str, features: list[str], sep: str = ",", mode: str = "error") -> None:
    """Lines of a cell and its average features."""
    line = F.concat_ws(sep, F.array_join(F.col("cell").cast("array<string>"), sep), *[F.col(f).cast("string") for f in features])
    _text(cells.select(line.alias("value")), path, mode)


def _text(df: DataFrame, path: str, mode: str) -> None:
    w = df.write.mode(mode)
    (w.option("compression", "gzip") if path.endswith(".gz") else w).text(path)
