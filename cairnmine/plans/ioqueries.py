"""Queries that write a table in one of the text or binary forms and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph
from ..sources import readers, writers
from ..tables import cut, folder
from .inputs import events, supplies, table

_S = "s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"


def _path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{folder(spark)}/io/{uuid.uuid4().hex}/{name}"


@query("io_edge_list", f"WITH {_S} SELECT * FROM s")
def _(spark, d):
    path = _path(spark, "graph.edgelist")
    writers.save_edges(supplies(spark, d), path, one_based=True)
    return readers.load_edges(spark, path, one_based=True)


@query("io_edge_list_compressed", f"WITH {_S} SELECT src, dst, 1.0::DOUBLE AS w FROM s")
def _(spark, d):
    """Written by Spark with gzip; found by the name without the extension."""
    path = _path(spark, "graph.tensor")
    supplies(spark, d).select("src", "dst").write.option("compression", "gzip").csv(path + ".gz")
    return readers.load_edges(spark, path, sep=",", weighted=False)


@query("io_tensor_columns", "SELECT l_suppkey AS supp, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def _(spark, d):
    path = _path(spark, "lines.tensor")
    writers.save_features(table(spark, d, "lineitem"), path, ["l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity"])
    return readers.load_table(spark, path, columns=[1, 2, 4], types=[int, int, float]).toDF("supp", "part", "quantity")


@query("io_table_header", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, d):
    path = _path(spark, "part.csv")
    writers.save_features(table(spark, d, "part"), path, ["p_partkey", "p_name", "p_retailprice"], header=True)
    return readers.load_table(spark, path, header=readers.sniff_header(spark, path), types=["int", "str", "float"])


for _kind in ("parquet", "orc", "json"):

    @query(f"io_table_{_kind}", "SELECT c_custkey, c_name, c_acctbal FROM customer")
    def _(spark, d, kind=_kind):
        path = _path(spark, f"customer.{kind}")
        table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.format(kind).save(path)
        return readers.load_table(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query("io_lists", "SELECT user_id AS key, list_sort(list(event_id)) AS values FROM events GROUP BY 1")
def _(spark, d):
    path = _path(spark, "users.dict")
    writers.save_lists(events(spark, d).groupBy(F.col("user_id").alias("key")).agg(F.sort_array(F.collect_list("event_id")).alias("values")), path)
    return readers.load_lists(spark, path, "int", "int")


@query("io_lists_gzip", "SELECT event_type AS key, list_sort(list(DISTINCT user_id)) AS values FROM events GROUP BY 1")
def _(spark, d):
    path = _path(spark, "types.dict.gz")
    writers.save_lists(events(spark, d).groupBy(F.col("event_type").alias("key")).agg(F.sort_array(F.collect_set("user_id")).alias("values")), path)
    return readers.load_lists(spark, path, "str", "int")


@query("io_dict", "SELECT p_partkey AS key, p_size AS value FROM part")
def _(spark, d):
    path = _path(spark, "size.dict")
    writers.save_dict(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value")), path, sep=",")
    return readers.load_dict(spark, path, 1, "int", "int").select(F.col("key")[0].alias("key"), F.col("values")[0].alias("value"))


@query("io_values", "SELECT s_name AS value FROM supplier")
def _(spark, d):
    path = _path(spark, "names.list")
    writers.save_values(table(spark, d, "supplier").select(F.col("s_name").alias("value")), path)
    return readers.load_values(spark, path)


def _five_places(x: F.Column) -> F.Column:
    """Five decimals; a negative value that rounds to nothing keeps its sign, as in SQL."""
    return F.when(x.cast("string").startswith("-"), -F.round(-x, 5)).otherwise(F.round(x, 5))


@query("io_matrix", "SELECT vec_id AS pos, [round(x::DOUBLE, 5) FOR x IN embedding] AS v FROM embeddings")
def _(spark, d):
    """Rows keep their order."""
    path = _path(spark, "vectors.txt")
    rows = table(spark, d, "embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    writers.save_matrix(rows.select(F.transform(F.col("embedding").cast("array<double>"), _five_places).alias("v")), path)
    return readers.load_matrix(spark, path)


@query("io_adjacency", f"WITH {_S} SELECT src, dst FROM s")
def _(spark, d):
    path = _path(spark, "graph.adj")
    out, _ = readers.adjacency_lists(supplies(spark, d))
    writers.save_lists(out, path, "src", "neighbours", sep=" ")
    return readers.load_adjacency(spark, path)


@query("io_adjacency_lists", f"WITH {_S} SELECT 'out' AS way, src AS id, list_sort(list(dst)) AS neighbours FROM s GROUP BY src UNION ALL SELECT 'in', dst, list_sort(list(src)) FROM s GROUP BY dst")
def _(spark, d):
    """An edge list read back as neighbours each way."""
    path = _path(spark, "graph.edgelist")
    writers.save_edges(supplies(spark, d), path, weighted=False)
    out, into = readers.adjacency_lists(readers.load_edges(spark, path))
    named = lambda x, way: x.toDF("id", "neighbours").select(F.lit(way).alias("way"), "id", "neighbours")
    return named(out, "out").unionByName(named(into, "in"))


@query("io_square_matrix", f"WITH {_S} SELECT max(greatest(src, dst)) + 1 AS n, count(*) AS cells, sum(w) AS total FROM s")
def _(spark, d):
    path = _path(spark, "graph.edgelist")
    writers.save_edges(supplies(spark, d), path)
    e = readers.load_edges(spark, path)
    return e.agg(F.lit(readers.n_nodes(e)).cast("long").alias("n"), F.count("*").alias("cells"), F.sum("w").alias("total"))


@query("io_edge_properties", "SELECT l_suppkey AS src, l_partkey AS dst, list_sort(list(l_linenumber::BIGINT)) AS props FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    path = _path(spark, "times.txt")
    e = table(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_suppkey", "l_partkey").alias("key")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("values"))
    writers.save_lists(e, path)
    return readers.load_edge_properties(spark, path)


@query("io_matricized", "SELECT l_suppkey AS row, [l_partkey] AS col, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    path = _path(spark, "tensor.csv")
    writers.save_features(table(spark, d, "lineitem"), path, ["l_suppkey", "l_partkey", "l_linenumber", "l_quantity"])
    return readers.load_matricized(spark, path, sum_out=[2])


@query("io_stages", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS stage, vec_id AS pos, [round(x::DOUBLE, 5) FOR x IN embedding] AS v FROM embeddings")
def _(spark, d):
    path = _path(spark, "genes.tsv")
    rows = table(spark, d, "embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    text = F.concat_ws("\t", F.col("vec_id").cast("string"), F.array_join(F.transform(F.col("embedding").cast("array<double>"), _five_places).cast("array<string>"), "\t"))
    rows.select(text.alias("value")).write.text(path)
    n = rows.count()  # the caller names positions
    return readers.load_stages(spark, path, {"even": range(0, n, 2), "odd": range(1, n, 2)})


_CELLS = "c AS (SELECT p_size::BIGINT AS a, CAST(floor(p_retailprice / 100) AS BIGINT) AS b, count(*)::DOUBLE AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2)"


def _cells(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("long"), F.floor(F.col("p_retailprice") / 100).cast("long")).alias("cell"), "p_retailprice")
    return p


@query("io_histogram", f"WITH {_CELLS} SELECT a, b, n FROM c")
def _(spark, d):
    path = _path(spark, "hist.txt")
    ticks = [[float(i) for i in range(52)], [100.0 * i for i in range(30)]]
    writers.save_histogram(_cells(spark, d).groupBy("cell").agg(F.count("*").alias("n")), (52, 30), ticks, path)
    shape, got, cells = readers.load_histogram(spark, path)
    assert shape == (52, 30) and got == ticks
    return cells.select(F.col("cell")[0].alias("a"), F.col("cell")[1].alias("b"), "n")


@query("io_point_cells", "SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS id, [p_size::BIGINT, CAST(floor(p_retailprice / 100) AS BIGINT)] AS cell FROM part")
def _(spark, d):
    path = _path(spark, "points.txt")
    writers.save_point_cells(_cells(spark, d), path)
    return readers.load_point_cells(spark, path)


@query("io_points_by_cell", "SELECT [p_size::BIGINT, CAST(floor(p_retailprice / 100) AS BIGINT)] AS cell, list_sort(list(p_partkey - (SELECT min(p_partkey) FROM part))) AS ids FROM part GROUP BY 1")
def _(spark, d):
    path = _path(spark, "points.txt")
    writers.save_point_cells(_cells(spark, d), path)
    return readers.points_by_cell(readers.load_point_cells(spark, path))


@query("io_cell_features", f"WITH {_CELLS} SELECT [a, b] AS cell, [n, price] AS features FROM c")
def _(spark, d):
    path = _path(spark, "cells.txt")
    writers.save_cell_features(_cells(spark, d).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price")), path, ["n", "price"])
    return readers.load_cell_features(spark, path, 2)


@query("io_blocks", "SELECT 'row' AS kind, c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'col', p_partkey FROM part WHERE p_size > 40")
def _(spark, d):
    """Two results appended to one place."""
    path = _path(spark, "blocks")
    writers.save_blocks(table(spark, d, "customer").where("c_acctbal > 5000").select(F.lit("row").alias("kind"), F.col("c_custkey").alias("id")), path)
    writers.save_blocks(table(spark, d, "part").where("p_size > 40").select(F.lit("col").alias("kind"), F.col("p_partkey").alias("id")), path)
    return writers.load_blocks(spark, path)


@query("io_stream", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    """A folder of text read as a stream, all that is there, and written as a table."""
    path, out = _path(spark, "in"), _path(spark, "out")
    writers.save_features(events(spark, d), path, ["event_id", "user_id", "value"])
    rows = readers.open_stream(spark, path, "event_id long, user_id long, value double")
    rows.writeStream.option("checkpointLocation", _path(spark, "state")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out)


@query("io_features", "WITH o AS (SELECT l_suppkey AS id, count(DISTINCT l_partkey)::DOUBLE AS degree, sum(l_quantity) AS score FROM lineitem GROUP BY 1) SELECT * FROM o")
def _(spark, d):
    path = _path(spark, "features.csv")
    e = cut(supplies(spark, d))
    both = graph.degree(e, "src", weighted=False).join(graph.degree(e, "src").withColumnRenamed("degree", "score"), "id")
    writers.save_features(both, path, ["id", "degree", "score"])
    return readers.load_table(spark, path, types=["int", "float", "float"]).toDF("id", "degree", "score")
