import gzip
import lzma
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmine import catalog
from cairnmine.functions import encode
from cairnmine.operators import bursts, series
from cairnmine.sources import readers, writers

TEXT = "# head\n0 1 2.5\n3 4\n# more\n2 2 1\n"


def edges(df):
    return sorted(map(tuple, df.collect()))


def test_edge_lists_in_every_compression(spark, tmp_path):
    (tmp_path / "a.edgelist").write_text(TEXT)
    with gzip.open(tmp_path / "b.edgelist.gz", "wt") as f:
        f.write(TEXT)
    want = [(0, 1, 2.5), (2, 2, 1.0), (3, 4, 1.0)]
    assert edges(readers.load_edges(spark, str(tmp_path / "a.edgelist"))) == want
    assert edges(readers.load_edges(spark, str(tmp_path / "b.edgelist"))) == want  # the compressed sibling
    assert edges(readers.load_edges(spark, str(tmp_path / "a.edgelist"), one_based=True, weighted=False)) == [(-1, 0, 1.0), (1, 1, 1.0), (2, 3, 1.0)]
    assert readers.n_nodes(readers.load_edges(spark, str(tmp_path / "a.edgelist"))) == 5


def test_tables(spark, tmp_path):
    (tmp_path / "x1.csv").write_text("1,a,2.5\n2,b,3.5\n")
    (tmp_path / "x2.csv").write_text("3,c,4.5\n")
    df = readers.load_table(spark, str(tmp_path / "x*.csv"), columns=[0, 2], types=[int, float])
    assert df.dtypes == [("c0", "bigint"), ("c2", "double")] and sorted(map(tuple, df.collect())) == [(1, 2.5), (2, 3.5), (3, 4.5)]
    with lzma.open(tmp_path / "y.csv.xz", "wt") as f:
        f.write("7,z\n")
    with zipfile.ZipFile(tmp_path / "z.csv.zip", "w") as z:
        z.writestr("m.csv", "8,q\n")
    assert readers.load_table(spark, str(tmp_path / "y.csv.xz"), types=[int, str]).first() == (7, "z")
    assert readers.load_table(spark, str(tmp_path / "z.csv.zip"), types=[int, str]).first() == (8, "q")
    np.savez(tmp_path / "n.npz", a=np.arange(4).reshape(2, 2), b=np.ones((1, 2)))
    assert sorted((r.pos, list(r.v)) for r in readers.load_table(spark, str(tmp_path / "n.npz")).collect()) == [(0, [0, 1]), (1, [2, 3]), (2, [1, 1])]
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, str(tmp_path / "missing"))


def test_text_round_trips(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    lists = spark.createDataFrame([("u", [1, 2]), ("v", []), ("w", [3])], "key string, values array<int>")
    writers.save_lists(lists, p("lists.gz"))
    assert sorted((r.key, list(r["values"])) for r in readers.load_lists(spark, p("lists.gz"), "str", "int").collect()) == [("u", [1, 2]), ("w", [3])]
    (tmp_path / "d.txt").write_text("1,5\n2,6\n1,7\n")
    assert sorted((list(r.key), list(r["values"])) for r in readers.load_dict(spark, p("d.txt")).collect()) == [([1], [7.0]), ([2], [6.0])]
    writers.save_values(spark.createDataFrame([(3,), (4,)], "value int"), p("values"))
    assert sorted(r.value for r in readers.load_values(spark, p("values"), "int").collect()) == [3, 4]
    m = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>").coalesce(1)
    writers.save_matrix(m, p("matrix"))
    assert [list(r.v) for r in readers.load_matrix(spark, p("matrix")).orderBy("pos").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "adj.txt").write_text("0 1 2\n5 6\n")
    assert edges(readers.load_adjacency(spark, p("adj.txt"))) == [(0, 1), (0, 2), (5, 6)]
    (tmp_path / "props.txt").write_text("0-1:5 6\n2-3:7\n")
    assert sorted((r.src, r.dst, list(r.props)) for r in readers.load_edge_properties(spark, p("props.txt")).collect()) == [(0, 1, [5, 6]), (2, 3, [7])]
    e = spark.createDataFrame([(0, 1, 2.0)], "src long, dst long, w double")
    writers.save_edges(e, p("edges"), one_based=True)
    assert edges(readers.load_edges(spark, p("edges"), one_based=True)) == [(0, 1, 2.0)]
    cells = spark.createDataFrame([([0, 1], 3.0), ([2, 2], 4.0)], "cell array<long>, n double")
    writers.save_histogram(cells, (3, 3), [[0.0, 1.0, 2.0], [0.5, 1.5, 2.5]], p("hist"))
    shape, ticks, back = readers.load_histogram(spark, p("hist"))
    assert shape == (3, 3) and ticks[1] == [0.5, 1.5, 2.5] and sorted((list(r.cell), r.n) for r in back.collect()) == [([0, 1], 3.0), ([2, 2], 4.0)]
    (tmp_path / "t.tensor").write_text("1,2,3,4\n1,2,9,1\n2,2,3,1\n")
    assert sorted((r.row, list(r.col), r.w) for r in readers.load_matricized(spark, p("t.tensor"), sum_out=[2]).collect()) == [(1, [2], 5.0), (2, [2], 1.0)]
    (tmp_path / "genes.tsv").write_text("g1\t1\t2\ng2\t3\t4\ng3\t5\t6\n")
    assert sorted((r.stage, list(r.v)) for r in readers.load_stages(spark, p("genes.tsv"), {"a": [0, 2], "b": [1]}).collect()) == [("a", [1, 2]), ("a", [5, 6]), ("b", [3, 4])]
    writers.save_blocks(e, p("blocks"))
    writers.save_blocks(e, p("blocks"))
    assert writers.load_blocks(spark, p("blocks")).count() == 2


def test_headers_are_found(spark, tmp_path):
    for name, text, want in (("a", "id,price\n1,2.5\n", True), ("b", "1,2.5\n3,4\n", False), ("c", "# note\n\nname,1\n", False)):
        (tmp_path / name).write_text(text)
        assert readers.sniff_header(spark, str(tmp_path / name)) == want


def test_stream_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1 2\n3 4\n")
    q = readers.open_stream(spark, str(tmp_path / "in"), "a int, b int", sep=" ").writeStream.format("memory").queryName("rows_in").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rows_in").count() == 2


def test_bin_edges():
    assert encode.equal_edges(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert encode.log_edges(100, 10) == [1, 10, 100]
    d = encode.degree_edges(5000)
    assert d[:10] == [float(x) for x in range(1, 11)] and d[-1] >= 5000 and all(b - a >= y - x for x, y, a, b in zip(d, d[1:], d[1:], d[2:]))


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert [(r.x, r.id) for r in encode.number(df, ["x"]).orderBy("x").collect()] == [(k, k) for k in range(1000)]


def test_series_ranges(spark):
    df = spark.createDataFrame([(float(k), float(k % 5)) for k in range(20)], "t double, v double")
    s = series.Series.of(df, "t", ["v"], freq=2.0)
    with pytest.raises(IndexError):
        s.cut(5, 50)
    assert s.cut(2, 5, form="time").df.count() == 6
    x = np.cos(np.arange(32) / 32 * 2 * np.pi * 3)
    np.testing.assert_allclose(series.fourier_resample(x, 64)[::2], x, atol=1e-12)
    np.testing.assert_allclose(series.fourier_resample(series.fourier_resample(x, 64), 32), x, atol=1e-12)


def test_bursts():
    quiet, loud = np.linspace(0, 1000, 50), np.linspace(500, 510, 300)
    found = bursts.bursts_of(np.concatenate([quiet, loud]), 50)
    assert found and found[0][0] <= 500 <= found[0][1] and found[0][2] >= 100
    slope, fall = bursts.drop_of(np.concatenate([quiet, loud]), 1e9, 0, 50)
    assert fall > 100 and slope > 0
    assert bursts.bursts_of(np.array([5.0, 5.0])) == [] and bursts.drop_of(np.array([1.0]), 2.0) == (0.0, 0.0)


def test_zip_properties(spark):
    t = spark.createDataFrame([(0, 1, [10, 4000])], "src long, dst long, props array<long>")
    r = spark.createDataFrame([(0, 1, [5, 4])], "src long, dst long, props array<long>")
    assert sorted(tuple(x) for x in bursts.zip_properties(t, r).collect()) == [(0, 1, 0, 5.0, 1.0), (0, 1, 1, 4.0, 1.0)]


@pytest.mark.parametrize("name", ["io_matrix", "io_stages"])
def test_values_that_round_to_nothing_keep_their_sign_as_in_sql(spark, tmp_path, name):
    rows = [(0, [-0.000002, 0.000002, -0.0, 0.0, -1.5]), (1, [0.123456, -0.123456, -0.000005, 0.25, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(catalog.oracle_sql()[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(repr(list(r["v"])) for r in got) == sorted(repr(r[-1]) for r in want)


def test_bursts_of_sinks_across_batches(spark):
    """Sinks that fill several batches, share one or have one time only, and rows without a sink."""
    rng = np.random.RandomState(3)
    times = {s: sorted(rng.randint(0, 10_000, n).tolist()) for s, n in ((5, 40), (6, 1), (7, 2), (None, 9), (0, 25), (8, 3), (9, 7))}
    e = spark.createDataFrame([(1, s, t) for s, x in times.items() for t in x], "src long, dst long, ts long").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r.sink: r for r in bursts.sink_bursts(e, 1e12).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == set(times) - {6}
    for s, r in got.items():
        x = np.array(times[s], float)
        assert r.n == len(x) and abs(r.t_mean - x.mean()) < 1e-6 and (r.slope, r.fall) == bursts.drop_of(x, 1e12)
        assert [tuple(b) for b in r.bursts] == bursts.bursts_of(x)
