"""Readers of tables, tensors, edge lists, dictionaries, histograms and streams. Every reader is a lazy DataFrame.

Text is split with column functions, so files of any size are read in parallel; only ``.npy``/``.npz``, ``.zip`` and
``.xz`` files, which Spark can't split, are decoded file by file in Arrow functions.
"""

from __future__ import annotations

import io
import lzma
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import number

#: Column types by name or Python type; whatever else is a string.
TYPES = {int: "long", float: "double", str: "string", "int": "long", "float": "double", "str": "string", np.int64: "long", np.float64: "double"}
COMPRESSED = (".gz", ".bz2", ".zip", ".xz")


def type_of(t) -> str:
    return TYPES.get(t, "string")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def resolve(spark: SparkSession, path: str) -> str:
    """The path itself, or a compressed sibling, or the path with a known extension."""
    for end in ("", *COMPRESSED, ".csv", ".tensor"):
        if _exists(spark, path + end):
            return path + end
    raise FileNotFoundError(path)


def load_table(spark: SparkSession, path: str, columns: Sequence[int] | None = None, types: Sequence | None = None, sep: str = ",", header: bool = False, comment: str = "#", schema: T.StructType | str | None = None) -> DataFrame:
    """Reads by extension: parquet, orc, json, npy/npz, else delimited text (also .gz, .bz2, .zip, .xz; globs and folders).

    Without ``types``, chosen columns are strings and unchosen schemas are inferred. Columns of headerless text are
    named c0, c1, ...; ``columns`` picks positions.
    """
    path = resolve(spark, path)
    for end, kind in ((".parquet", "parquet"), (".orc", "orc"), (".json", "json")):
        if path.endswith(end):
            df = spark.read.format(kind).load(path)
            return df.select(*[df.columns[i] for i in columns]) if columns else df
    if path.endswith((".npy", ".npz")):
        return load_numpy(spark, path)
    r = spark.read.option("sep", sep).option("header", header).option("comment", comment).option("ignoreLeadingWhiteSpace", True)
    lines = None
    if path.endswith((".zip", ".xz")):
        lines = unpack_lines(spark, path).rdd.map(lambda x: x[0])  # the CSV parser takes lines only this way
    if schema is not None:
        df = r.schema(schema).csv(lines if lines is not None else path)
    else:
        df = r.option("inferSchema", columns is None and types is None).csv(lines if lines is not None else path)
    if not header and schema is None:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    if columns is not None:
        df = df.select(*[df.columns[i] for i in columns])
    if types is not None:
        df = df.select(*[F.col(c).cast(type_of(t)).alias(c) for c, t in zip(df.columns, types)])
    return df


def unpack_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of .zip members or .xz files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                if p.endswith(".xz"):
                    texts = [lzma.decompress(data)]
                else:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        texts = [z.read(n) for n in z.namelist()]
                for t in texts:
                    yield pd.DataFrame({"value": t.decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "value string")


def load_numpy(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, pos, v array<double>): rows of .npy arrays, or of each array of .npz files one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(data), allow_pickle=False)
                pos = 0
                for part, a in ((k, x[k]) for k in x.files) if hasattr(x, "files") else (("", x),):
                    a = np.asarray(a, float)
                    a = a.reshape(len(a), -1)
                    yield pd.DataFrame({"file": p, "part": part, "pos": np.arange(pos, pos + len(a)), "v": list(a)})
                    pos += len(a)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, part string, pos long, v array<double>")


def lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(value): trimmed lines without empty and comment lines."""
    df = spark.read.text(resolve(spark, path)).select(F.trim("value").alias("value")).where("value <> ''")
    return df.where(~F.col("value").startswith(comment)) if comment else df


def _place() -> Column:
    """Where a line is, in an order that follows names of files and positions in them, however files are dealt to tasks."""
    return F.struct(F.input_file_name(), F.call_function("input_file_block_start"), F.monotonically_increasing_id())


def _parts(sep: str | None) -> Column:
    """Fields of a line; a separator of None is white space."""
    return F.split("value", r"\s+" if sep is None or sep == " " else _quoted(sep))


def _quoted(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in sep)


def load_edges(spark: SparkSession, path: str, sep: str | None = None, one_based: bool = False, weighted: bool | None = None) -> DataFrame:
    """(src, dst, w) of lines ``u v [w]``; a missing weight is 1; without ``sep`` white space, commas or semicolons."""
    p = F.split("value", r"[\s,;]+") if sep is None else _parts(sep)
    rows = lines(spark, path).select(p.alias("p"))
    shift = 1 if one_based else 0
    w = F.lit(1.0) if weighted is False else F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0))
    return rows.select((F.col("p")[0].cast("long") - shift).alias("src"), (F.col("p")[1].cast("long") - shift).alias("dst"), w.alias("w"))


def n_nodes(edges: DataFrame) -> int:
    """Side of the square matrix that holds the edges."""
    return (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1


def load_adjacency(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(src, dst) of lines ``u v1 v2 ...``."""
    p = lines(spark, path).select(_parts(sep).alias("p"))
    return p.select(F.col("p")[0].cast("long").alias("src"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).cast("array<long>")).alias("dst"))


def adjacency_lists(edges: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Neighbours each way: (src, neighbours) and (dst, neighbours), sorted; distinct unless weighted."""
    collect = F.collect_list if weighted else F.collect_set
    side = lambda a, b: edges.groupBy(a).agg(F.sort_array(collect(b)).alias("neighbours"))
    return side("src", "dst"), side("dst", "src")


def load_dict(spark: SparkSession, path: str, n_keys: int = 1, key_type="int", value_type="float", sep: str = ",") -> DataFrame:
    """(key array, values array) of lines of ``n_keys`` key fields and then values; of equal keys the last line wins."""
    rows = spark.read.text(resolve(spark, path)).select("value", _place().alias("at"))
    rows = rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(F.transform(_parts(sep), lambda x: F.trim(x)).alias("p"), "at")
    cast = lambda c, t: c.cast(f"array<{type_of(t)}>")
    rows = rows.select(cast(F.slice("p", 1, n_keys), key_type).alias("key"), cast(F.slice("p", n_keys + 1, F.size("p")), value_type).alias("values"), "at")
    return rows.groupBy("key").agg(F.max_by("values", "at").alias("values"))


def load_lists(spark: SparkSession, path: str, key_type="str", value_type="str", sep: str = ":") -> DataFrame:
    """(key, values array) of lines ``key:v1 v2 ...``; also ``key:value``."""
    rows = lines(spark, path, None).select(F.split("value", _quoted(sep), 2).alias("p"))
    values = F.filter(F.split(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), r"\s+"), lambda v: v != "")
    return rows.select(F.trim(F.col("p")[0]).cast(type_of(key_type)).alias("key"), values.cast(f"array<{type_of(value_type)}>").alias("values"))


def load_values(spark: SparkSession, path: str, dtype="str") -> DataFrame:
    """(value): one value a line."""
    return lines(spark, path, None).select(F.col("value").cast(type_of(dtype)).alias("value"))


def load_matrix(spark: SparkSession, path: str, sep: str | None = None, dtype="float") -> DataFrame:
    """(pos, v array): rows of a text matrix in order of lines."""
    rows = lines(spark, path).select(_parts(sep).cast(f"array<{type_of(dtype)}>").alias("v"), _place().alias("at"))
    return number(rows, ["at"], "pos").select("pos", "v")


def load_edge_properties(spark: SparkSession, path: str, dtype="int") -> DataFrame:
    """(src, dst, props array) of lines ``u-v:p1 p2 ...``."""
    rows = load_lists(spark, path, "str", dtype)
    ends = F.split("key", "-")
    return rows.select(ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst"), F.col("values").alias("props"))


def load_histogram(spark: SparkSession, path: str, sep: str = ",") -> tuple[tuple[int, ...], list[list[float]], DataFrame]:
    """Shape, tick values of each dimension, and (cell array, n): ``# shape`` and ``# ticks`` lines, then cell rows.

    The head has one line a dimension and one more, so it is read by the driver.
    """
    path = resolve(spark, path)
    head = [r["value"].lstrip("#: ").strip() for r in spark.read.text(path).where(F.col("value").startswith("#")).select("value").collect()]
    shape = tuple(int(x) for x in head[0].replace("shape", "").replace(":", " ").replace(sep, " ").split())
    ticks = [[float(x) for x in h.split(sep)] for h in head[1 : 1 + len(shape)]]
    p = lines(spark, path).select(F.split("value", _quoted(sep)).alias("p"))
    k = len(shape)
    return shape, ticks, p.select(F.slice("p", 1, k).cast("array<long>").alias("cell"), F.col("p")[k].cast("double").alias("n"))


def load_matricized(spark: SparkSession, path: str, sum_out: Sequence[int] = (), sep: str = ",") -> DataFrame:
    """(row, col array, w): a k-mode text tensor as rows times composite columns; ``sum_out`` modes vanish. Last field: weight."""
    p = lines(spark, path).select(_parts(sep).alias("p"))
    k = p.select(F.size("p")).first()[0] - 1
    modes = [i for i in range(1, k) if i not in set(sum_out)]
    col = F.array(*[F.col("p")[i].cast("long") for i in modes])
    return p.select(F.col("p")[0].cast("long").alias("row"), col.alias("col"), F.col("p")[k].cast("double").alias("w")).groupBy("row", "col").agg(F.sum("w").alias("w"))


def load_stages(spark: SparkSession, path: str, stages: dict[str, Sequence[int]], sep: str = "\t") -> DataFrame:
    """(stage, pos, v array<double>): a wide text table without its id column, its rows dealt to named stages by position."""
    rows = lines(spark, path).select(F.split("value", _quoted(sep)).alias("p"), _place().alias("at"))
    rows = number(rows, ["at"], "pos").select("pos", F.slice("p", 2, F.size("p")).cast("array<double>").alias("v"))
    of = spark.createDataFrame([(s, int(i)) for s, xs in stages.items() for i in xs], "stage string, pos long")
    return rows.join(F.broadcast(of), "pos").select("stage", F.col("pos").cast("long").alias("pos"), "v")  # as many rows as named positions


def load_point_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(id, cell array) of lines ``cell_0,...,cell_d``: the cell of each point, points numbered from 0 in order of lines."""
    return load_matrix(spark, path, sep, "int").select(F.col("pos").alias("id"), F.col("v").alias("cell"))


def points_by_cell(points: DataFrame) -> DataFrame:
    """(cell array, ids array): the points of each cell, from (id, cell)."""
    return points.groupBy("cell").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def load_cell_features(spark: SparkSession, path: str, dims: int, sep: str = ",") -> DataFrame:
    """(cell array, features array<double>) of lines ``cell_0,...,cell_d,f_0,f_1,...``."""
    p = lines(spark, path).select(F.split("value", _quoted(sep)).alias("p"))
    return p.select(F.slice("p", 1, dims).cast("array<long>").alias("cell"), F.slice("p", dims + 1, F.size("p")).cast("array<double>").alias("features"))


def sniff_header(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether the first line of a text table names columns: none of its fields is a number."""
    first = spark.read.text(resolve(spark, path)).select("value", _place().alias("at")).where("trim(value) <> '' and not startswith(value, '#')").orderBy("at").limit(1)
    return first.select(F.forall(F.split("value", _quoted(sep)), lambda x: F.trim(x).try_cast("double").isNull()).alias("x")).collect() == [(True,)]


def open_stream(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", fmt: str = "csv", files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over files that arrive in a folder."""
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("sep", sep)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.format(fmt).load(path)
