"""Queries of the relational idioms: scans, encoders, graph aggregates, inter-arrival statistics, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query
from ..functions import encode
from ..operators import graph, histogram, iat, series, stats
from .inputs import cents, coupled, events, flow, month, purchases, supplies, table, trade

_CP = "cp AS (SELECT o_custkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_SP = "sp AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
_SEC = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"
_IAT = f"""e AS (SELECT user_id AS usr, {_SEC} AS s FROM events),
d AS (SELECT usr, row_number() OVER (PARTITION BY usr ORDER BY s) - 1 AS k, s - lag(s) OVER (PARTITION BY usr ORDER BY s) AS iat FROM e),
diffs AS (SELECT usr, k, iat FROM d WHERE iat IS NOT NULL),
raw_pairs AS (SELECT usr, k, iat AS a, lead(iat) OVER (PARTITION BY usr ORDER BY k) AS b FROM diffs),
pairs AS (SELECT usr, k, length(bin(a + 1)) - 1 AS iat1, length(bin(b + 1)) - 1 AS iat2 FROM raw_pairs WHERE b IS NOT NULL),
pc AS (SELECT iat1, iat2, count(*) AS n FROM pairs GROUP BY ALL),
top AS (SELECT iat1, iat2, n FROM pc ORDER BY n DESC, iat1, iat2 LIMIT 1),
freq AS (SELECT usr, count(*) AS n FROM pairs JOIN top USING (iat1, iat2) GROUP BY usr)"""


# ---- scans and encoders ------------------------------------------------------------------------------------------

@query("scan_project_cast", "SELECT CAST(l_orderkey AS VARCHAR) AS c0, CAST(l_quantity AS DOUBLE) AS c1, CAST(l_linenumber AS BIGINT) AS c2 FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("c0"), F.col("l_quantity").cast("double").alias("c1"), F.col("l_linenumber").cast("long").alias("c2"))


@query("label_encode", """WITH f AS (SELECT source AS label, min(doc_id) AS f_at FROM documents GROUP BY source)
SELECT label, row_number() OVER (ORDER BY f_at, label) - 1 AS id FROM f""")
def _(spark, d):
    return encode.dictionary(table(spark, d, "documents"), ["source"], ["doc_id"])


@query("label_round_trip", "SELECT doc_id, source AS label FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    dic = encode.dictionary(docs, ["source"], ["doc_id"])
    return encode.decode(encode.encode(docs, dic, "source", "id"), dic, "id", "label").select("doc_id", "label")


@query("shared_label_space", """WITH f AS (SELECT event_type AS label, min(event_id) AS f_at, 0 AS k FROM events GROUP BY 1 UNION ALL SELECT CAST(user_id AS VARCHAR), min(event_id), 1 FROM events GROUP BY 1),
g AS (SELECT label, min((f_at, k)) AS o FROM f GROUP BY label) SELECT label, row_number() OVER (ORDER BY o, label) - 1 AS id FROM g""")
def _(spark, d):
    return encode.dictionary(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"], ["event_id"])


@query("int_shift", "SELECT o_orderkey, o_custkey - (SELECT min(o_custkey) FROM orders) AS c0, (SELECT min(o_custkey) FROM orders) AS c0_min FROM orders")
def _(spark, d):
    return encode.shift_ints(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "c0").select("o_orderkey", "c0", "c0_min")


@query("int_unshift", "SELECT o_orderkey, o_custkey AS back FROM orders")
def _(spark, d):
    s = encode.shift_ints(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "c0")
    return encode.unshift_ints(s, "c0", "c0_min", "back").select("o_orderkey", "back")


@query("dense_int_encode", """WITH f AS (SELECT l_suppkey AS v, min(l_orderkey * 1000 + l_linenumber) AS f_at FROM lineitem GROUP BY 1)
SELECT CAST(v AS VARCHAR) AS label, row_number() OVER (ORDER BY f_at, CAST(v AS VARCHAR)) - 1 AS id FROM f""")
def _(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("at"), "l_suppkey")
    return encode.dictionary(l, ["l_suppkey"], ["at"])


@query("time_bin", f"WITH e AS (SELECT event_id, {_SEC} AS s FROM events) SELECT event_id, (s - (SELECT min(s) FROM e)) // 86400 AS tbin, (SELECT min(s) FROM e) AS tbin_min FROM e")
def _(spark, d):
    return encode.time_bins(events(spark, d).select("event_id", "ts"), "ts", "tbin").select("event_id", "tbin", "tbin_min")


@query("time_bin_middle", f"""WITH e AS (SELECT {_SEC} AS s FROM events), m AS (SELECT min(s) AS lo FROM e)
SELECT DISTINCT (s - lo) // 3600 AS tbin, strftime(make_timestamp(((s - lo) // 3600 * 3600 + lo + 1800) * 1000000), '%Y-%m-%d %H:%M:%S') AS middle FROM e, m""")
def _(spark, d):
    b = encode.time_bins(events(spark, d).select("ts"), "ts", "tbin", 3600).select("tbin", "tbin_min").distinct()
    return b.select("tbin", F.date_format(encode.bin_middle(F.col("tbin"), F.col("tbin_min"), 3600), "yyyy-MM-dd HH:mm:ss").alias("middle"))


_EDGES = [1.0, 10.0, 20.0, 35.0, 50.0]
_EDGE_SQL = "[1.0, 10.0, 20.0, 35.0, 50.0]::DOUBLE[]"


@query("score_bin", f"WITH b AS (SELECT l_orderkey, l_quantity, len([e FOR e IN {_EDGE_SQL} IF e <= l_quantity]) AS b FROM lineitem) SELECT l_orderkey, CAST(b AS BIGINT) AS b, l_quantity - CASE WHEN b > 0 THEN ({_EDGE_SQL})[b] ELSE 0 END AS residual FROM b")
def _(spark, d):
    b, r = encode.score_bin(F.col("l_quantity"), _EDGES)
    return table(spark, d, "lineitem").select("l_orderkey", b.alias("b"), r.alias("residual"))


@query("score_unbin", "SELECT l_orderkey, l_quantity AS back FROM lineitem")
def _(spark, d):
    b, r = encode.score_bin(F.col("l_quantity"), _EDGES)
    return table(spark, d, "lineitem").select("l_orderkey", encode.score_unbin(b, r, _EDGES).alias("back"))


@query("log_bin_histogram", "SELECT length(bin(CAST(floor(o_totalprice) AS BIGINT) + 1)) - 1 AS b, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(encode.log2_bin(F.floor("o_totalprice")).alias("b")).agg(F.count("*").alias("n"))


# ---- tensors and graphs ------------------------------------------------------------------------------------------

@query("tensor_collapse", "SELECT l_suppkey AS i0, l_partkey AS i1, sum(l_quantity) AS v FROM lineitem GROUP BY ALL")
def _(spark, d):
    from ..functions.tensor import Tensor

    t = Tensor.from_columns(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey", "l_linenumber"], "l_quantity")
    return t.sum(axis=2).df


@query("edge_list", f"WITH {_CP} SELECT * FROM cp WHERE w <> 0")
def _(spark, d):
    return purchases(spark, d)


@query("edge_list_unweighted", f"WITH {_CP} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM cp WHERE w > 0")
def _(spark, d):
    return graph.edges_of(purchases(spark, d), "src", "dst", "w", weighted=False)


@query("edge_list_symmetric", f"WITH {_SP}, b AS (SELECT src, dst, w FROM sp UNION ALL SELECT dst, src, w FROM sp) SELECT src, dst, max(w) AS w FROM b GROUP BY ALL")
def _(spark, d):
    return graph.edges_of(supplies(spark, d), "src", "dst", "w", bipartite=False)


@query("property_tensor", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS prop, sum(l_quantity) AS w FROM lineitem GROUP BY ALL")
def _(spark, d):
    l = table(spark, d, "lineitem").withColumn("m", month("l_shipdate"))
    return graph.property_edges(l, "l_suppkey", "l_partkey", "m", "l_quantity")


@query("out_degree", f"WITH {_CP} SELECT c_custkey AS id, coalesce(sum(w), 0) AS degree FROM customer LEFT JOIN cp ON src = c_custkey GROUP BY 1")
def _(spark, d):
    return graph.degree(purchases(spark, d), "src", ids=table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("in_degree", f"WITH {_CP} SELECT dst AS id, sum(w) AS degree FROM cp GROUP BY 1")
def _(spark, d):
    return graph.degree(purchases(spark, d), "dst")


@query("degree_dist", f"""WITH {_CP}, g AS (SELECT src, count(*) AS degree FROM cp GROUP BY 1), c AS (SELECT degree, count(*) AS n FROM g GROUP BY 1)
SELECT r AS degree, coalesce(n, 0) AS n FROM range((SELECT max(degree) + 1 FROM c)) t(r) LEFT JOIN c ON r = degree""")
def _(spark, d):
    return graph.degree_distribution(purchases(spark, d))


@query("out_in_degree", f"""WITH {_SP}, o AS (SELECT src AS id, count(*) AS o FROM sp GROUP BY 1), i AS (SELECT dst AS id, count(*) AS i FROM sp GROUP BY 1)
SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM o FULL JOIN i USING (id)""")
def _(spark, d):
    return graph.out_in_degree(supplies(spark, d))


_BLOCK_R, _BLOCK_C = "c_mktsegment = 'BUILDING'", "p_size <= 10"


def _block(spark, d):
    r = table(spark, d, "customer").where(_BLOCK_R).select(F.col("c_custkey").alias("id"))
    return r, table(spark, d, "part").where(_BLOCK_C).select(F.col("p_partkey").alias("id"))


_IN = f"src IN (SELECT c_custkey FROM customer WHERE {_BLOCK_R})"
_IC = f"dst IN (SELECT p_partkey FROM part WHERE {_BLOCK_C})"


@query("subgraph_edges", f"WITH {_CP} SELECT src, dst, w FROM cp WHERE {_IN} AND {_IC}")
def _(spark, d):
    return graph.inside(purchases(spark, d), *_block(spark, d)).select("src", "dst", "w")


@query("subgraph_rebased", f"WITH {_CP} SELECT list_position([5, 3, 8, 1, 40], src) - 1 AS src, list_position([7, 2, 9, 30, 100, 4], dst) - 1 AS dst, w FROM cp WHERE src IN (5, 3, 8, 1, 40) AND dst IN (7, 2, 9, 30, 100, 4)")
def _(spark, d):
    return graph.subgraph(purchases(spark, d), [5, 3, 8, 1, 40], [7, 2, 9, 30, 100, 4])


@query("block_sum", f"WITH {_CP} SELECT count(*) AS n, coalesce(sum(w), 0) AS w FROM cp WHERE {_IN} AND {_IC}")
def _(spark, d):
    return graph.block_edges(purchases(spark, d), *_block(spark, d))


@query("block_density", f"""WITH {_CP}, b AS (SELECT * FROM cp WHERE {_IN} AND {_IC})
SELECT round(sum(w) / (count(DISTINCT src) + count(DISTINCT dst)), 2) AS density FROM b""")
def _(spark, d):
    b = graph.inside(purchases(spark, d), *_block(spark, d))
    return b.agg(F.round(F.sum("w") / (F.countDistinct("src") + F.countDistinct("dst")), 2).alias("density"))


@query("block_anti_join_and", f"WITH {_CP} SELECT src, dst, w FROM cp WHERE NOT ({_IN} AND {_IC})")
def _(spark, d):
    return graph.without_inside(purchases(spark, d), *_block(spark, d))


@query("block_anti_join_or", f"WITH {_CP} SELECT src, dst, w FROM cp WHERE NOT ({_IN} OR {_IC})")
def _(spark, d):
    return graph.without_touching(purchases(spark, d), *_block(spark, d))


@query("subset_above_degree", f"""WITH {_CP}, r AS (SELECT src FROM cp GROUP BY 1 HAVING sum(w) > 1000), c AS (SELECT dst FROM cp GROUP BY 1 HAVING sum(w) > 700)
SELECT src, dst, w FROM cp WHERE src IN (FROM r) AND dst IN (FROM c)""")
def _(spark, d):
    return graph.above_degree(purchases(spark, d), 1000, 700).select("src", "dst", "w")


@query("idf_weighted_edges", f"WITH {_CP}, c AS (SELECT dst, sum(w) AS s FROM cp GROUP BY 1) SELECT src, dst, w, round(1 / ln(s + 5), 9) AS cw FROM cp JOIN c USING (dst)")
def _(spark, d):
    return graph.column_weights(purchases(spark, d)).withColumn("cw", F.round("cw", 9))


@query("sqrt_weighted_edges", f"WITH {_CP}, c AS (SELECT dst, sum(w) AS s FROM cp GROUP BY 1) SELECT src, dst, w, round(1 / sqrt(s + 5), 9) AS cw FROM cp JOIN c USING (dst)")
def _(spark, d):
    return graph.column_weights(purchases(spark, d), "sqrt").withColumn("cw", F.round("cw", 9))


@query("avg_density", f"WITH {_CP} SELECT sum(w) / (count(DISTINCT src) + count(DISTINCT dst)) AS density FROM cp")
def _(spark, d):
    return purchases(spark, d).agg((F.sum("w") / (F.countDistinct("src") + F.countDistinct("dst"))).alias("density"))


@query("neighbor_associativity", f"WITH {_CP}, g AS (SELECT dst, count(*) AS g FROM cp GROUP BY 1) SELECT src AS id, CAST(floor(avg(g)) AS BIGINT) AS avg_degree FROM cp JOIN g USING (dst) GROUP BY 1")
def _(spark, d):
    return graph.neighbour_degree(purchases(spark, d))


@query("edge_set_difference", """WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A')
SELECT src, dst, 1 AS sign FROM (FROM a EXCEPT FROM b) UNION ALL SELECT src, dst, -1 FROM (FROM b EXCEPT FROM a)""")
def _(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    return graph.edge_difference(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"))


@query("prf_jaccard", f"""WITH f AS (SELECT 'row' AS kind, c_custkey AS id FROM customer WHERE {_BLOCK_R} UNION ALL SELECT 'col', p_partkey FROM part WHERE {_BLOCK_C}),
t AS (SELECT 'row' AS kind, c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'col', p_partkey FROM part WHERE p_size >= 5),
j AS (SELECT coalesce(f.kind, t.kind) AS kind, (f.id IS NOT NULL)::INT AS f, (t.id IS NOT NULL)::INT AS t FROM f FULL JOIN t ON f.kind = t.kind AND f.id = t.id),
g AS (SELECT coalesce(kind, 'all') AS kind, sum(f * t)::DOUBLE AS x, sum(f)::DOUBLE AS nf, sum(t)::DOUBLE AS nt FROM j GROUP BY ROLLUP (kind))
SELECT kind, x / nf AS precision, x / nt AS recall, 2 * x / (nf + nt) AS f1, x / (nf + nt - x) AS jaccard FROM g""")
def _(spark, d):
    r, c = _block(spark, d)
    found = r.select(F.lit("row").alias("kind"), "id").unionByName(c.select(F.lit("col").alias("kind"), "id"))
    truth = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("row").alias("kind"), F.col("c_custkey").alias("id"))
    truth = truth.unionByName(table(spark, d, "part").where("p_size >= 5").select(F.lit("col").alias("kind"), F.col("p_partkey").alias("id")))
    return graph.overlap(found, truth)


@query("cosine_topk", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS k FROM s) SELECT query, id, similarity FROM r WHERE k <= 5""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.top_neighbours(v, v.where("id % 20 = 0"), 5, digits=6)


@query("pearson_pairs", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT vec_id, [x - list_avg(e) FOR x IN e] AS e FROM v),
s AS (SELECT q.vec_id AS query, c.vec_id AS id, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM c q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query, id, similarity FROM s WHERE similarity >= 0.2""")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.similarities(v, v.where("id % 20 = 0"), "pearson", digits=6, least=0.2)


# ---- series and grouped times ------------------------------------------------------------------------------------

@query("log_to_series_pivot", f"""WITH e AS (SELECT {_SEC} AS s, event_type, value FROM events), m AS (SELECT min(s) AS a, max(s) AS b FROM e),
x AS (SELECT least((s - a) * 24 // (b - a), 23) AS bin, event_type AS g FROM e, m)
SELECT r AS bin, a + r * ((b - a) / 24.0::DOUBLE) AS t, count(*) FILTER (g = 'click')::DOUBLE AS click, count(*) FILTER (g = 'error')::DOUBLE AS error, count(*) FILTER (g = 'purchase')::DOUBLE AS purchase, count(*) FILTER (g = 'signup')::DOUBLE AS signup, count(*) FILTER (g = 'view')::DOUBLE AS view
FROM range(24) z(r) CROSS JOIN m LEFT JOIN x ON bin = r GROUP BY r, a, b""")
def _(spark, d):
    return series.log_to_series(events(spark, d), "ts", "event_type", bins=24, groups=["click", "error", "purchase", "signup", "view"])


@query("group_to_ts_list", f"SELECT event_type || ',' || user_id AS key, list_sort(list({_SEC})) AS ts FROM events GROUP BY 1")
def _(spark, d):
    return series.times_by_key(events(spark, d), ["event_type", "user_id"], "ts")


def _daily(spark, d):
    e = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").cast("double").alias("views"), F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"))
    return series.Series.of(e, "day", ["views", "clicks"], own_time=False)


_DAILY = "daily AS (SELECT row_number() OVER (ORDER BY ts::DATE) - 1 AS pos, count(*) FILTER (event_type = 'view')::DOUBLE AS views, count(*) FILTER (event_type = 'click')::DOUBLE AS clicks FROM events GROUP BY ts::DATE)"


@query("series_normalize", f"WITH {_DAILY}, m AS (SELECT min(views) a, max(views) b, min(clicks) c, max(clicks) d FROM daily) SELECT pos, pos::DOUBLE AS t, 2 * (views - (a + b) / 2) / (b - a) AS views, 2 * (clicks - (c + d) / 2) / (d - c) AS clicks FROM daily, m")
def _(spark, d):
    return _daily(spark, d).normalize().df


@query("series_cut", f"WITH {_DAILY} SELECT pos - 5 AS pos, pos::DOUBLE AS t, views, clicks FROM daily WHERE pos >= 5 AND pos < 20")
def _(spark, d):
    return _daily(spark, d).cut(5, 20).df


@query("series_concat", f"WITH {_DAILY}, n AS (SELECT count(*) AS n FROM daily) SELECT pos, pos::DOUBLE AS t, views, clicks FROM daily UNION ALL SELECT pos + n, (pos + n)::DOUBLE, views, clicks FROM daily, n")
def _(spark, d):
    s = _daily(spark, d)
    return s.concat(s).df


@query("series_combine", f"WITH {_DAILY} SELECT pos, pos::DOUBLE AS t, views, clicks, views AS views_1, clicks AS clicks_1 FROM daily")
def _(spark, d):
    s = _daily(spark, d)
    return s.combine(s).df


@query("series_add_extract", f"WITH {_DAILY} SELECT pos, pos::DOUBLE AS t, clicks, 7.0::DOUBLE AS seven FROM daily")
def _(spark, d):
    return _daily(spark, d).add_columns(seven=7.0).extract(["clicks", "seven"]).df


@query("series_resample", f"""WITH {_DAILY}, n AS (SELECT count(*) AS n FROM daily), j AS (SELECT range AS j FROM range((SELECT 2 * n FROM n))), k AS (SELECT range AS k FROM range((SELECT (n - 1) // 2 + 1 FROM n))),
w AS (SELECT j, pos, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * cos(2 * pi() * k * (j / (2.0::DOUBLE * n) - pos / n::DOUBLE)) END) + max(CASE WHEN n % 2 = 0 THEN cos(pi() * n * (j / (2.0::DOUBLE * n) - pos / n::DOUBLE)) ELSE 0 END) AS w FROM j, k, daily, n GROUP BY ALL)
SELECT j AS pos, j / 2.0::DOUBLE AS t, round(sum(views * w) / max(n), 6) + 0 AS views, round(sum(clicks * w) / max(n), 6) + 0 AS clicks FROM w JOIN daily USING (pos), n GROUP BY j""")
def _(spark, d):
    return _daily(spark, d).resample(2.0).df.select("pos", "t", (F.round("views", 6) + 0).alias("views"), (F.round("clicks", 6) + 0).alias("clicks"))


# ---- inter-arrival times -----------------------------------------------------------------------------------------

def _diffs(spark, d):
    return iat.differences(events(spark, d), "user_id", "ts")


def _freq(spark, d):
    p = iat.pairs(_diffs(spark, d), bin_=True)
    return iat.user_frequency(p, iat.peak_cell(p))


@query("iat_diff", f"WITH {_IAT} SELECT usr AS \"user\", k - 0 AS k, iat FROM diffs")
def _(spark, d):
    return _diffs(spark, d)


@query("iat_lists", f"WITH {_IAT} SELECT usr AS \"user\", list(iat ORDER BY k) AS iat FROM diffs GROUP BY 1")
def _(spark, d):
    return iat.lists(_diffs(spark, d))


@query("iat_count_prob", f"WITH {_IAT} SELECT iat, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM diffs) AS p FROM diffs GROUP BY 1")
def _(spark, d):
    return iat.counts(_diffs(spark, d))


@query("iat_density_curve", f"WITH {_IAT}, own AS (SELECT iat FROM diffs WHERE usr % 10 = 0) SELECT iat, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM own) AS p FROM own GROUP BY 1")
def _(spark, d):
    """The curve of chosen users."""
    return iat.density_curve(_diffs(spark, d), events(spark, d).where("user_id % 10 = 0").select(F.col("user_id").alias("user")))


@query("iat_pair_count", f"WITH {_IAT} SELECT iat1, iat2, n FROM pc")
def _(spark, d):
    return iat.pair_counts(iat.pairs(_diffs(spark, d), bin_=True))


@query("iat_pair_users", f"WITH {_IAT} SELECT iat1, iat2, list_sort(list(usr)) AS users FROM pairs GROUP BY ALL")
def _(spark, d):
    return iat.users_of_pairs(iat.pairs(_diffs(spark, d), bin_=True))


@query("iat_user_pairs", f"WITH {_IAT} SELECT usr AS \"user\", list(iat1 * 100 + iat2 ORDER BY k) AS codes FROM pairs GROUP BY 1")
def _(spark, d):
    p = iat.pairs_of_users(iat.pairs(_diffs(spark, d), bin_=True))
    return p.select("user", F.transform("pairs", lambda x: x["iat1"] * 100 + x["iat2"]).alias("codes"))


@query("rect_peak_cell", f"WITH {_IAT} SELECT iat1, iat2, n FROM top")
def _(spark, d):
    return iat.peak_cell(iat.pairs(_diffs(spark, d), bin_=True))


@query("iat_user_freq", f"WITH {_IAT} SELECT usr AS \"user\", n FROM freq")
def _(spark, d):
    return _freq(spark, d)


@query("iat_pair_holders", f"WITH {_IAT} SELECT DISTINCT usr AS \"user\" FROM pairs JOIN top USING (iat1, iat2)")
def _(spark, d):
    p = iat.pairs(_diffs(spark, d), bin_=True)
    return iat.having_pairs(p, iat.peak_cell(p))


@query("iqr_bound", f"WITH {_IAT} SELECT ceil(quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))) AS bound FROM freq")
def _(spark, d):
    return stats.iqr_bound(_freq(spark, d), "n")


@query("iqr_bound_existing", f"WITH {_IAT}, b AS (SELECT ceil(quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))) AS bound FROM freq) SELECT max(n)::DOUBLE AS bound FROM freq, b WHERE n <= b.bound")
def _(spark, d):
    return stats.iqr_bound_existing(_freq(spark, d), "n")


@query("three_sigma_bound", f"WITH {_IAT} SELECT round(avg(n) + 3 * stddev_pop(n), 6) AS bound FROM freq")
def _(spark, d):
    return stats.three_sigma_bound(_freq(spark, d), "n").withColumn("bound", F.round("bound", 6))


@query("iat_suspicious_iqr", f"WITH {_IAT}, b AS (SELECT ceil(quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))) AS bound FROM freq) SELECT usr AS \"user\", n FROM freq, b WHERE n > b.bound")
def _(spark, d):
    return iat.suspicious(_freq(spark, d))


@query("iat_suspicious_3sigma", f"WITH {_IAT}, b AS (SELECT avg(n) + 3 * stddev_pop(n) AS bound FROM freq) SELECT usr AS \"user\", n FROM freq, b WHERE n > b.bound")
def _(spark, d):
    return iat.suspicious(_freq(spark, d), "3sigma")


@query("topk_users", f"WITH {_IAT} SELECT usr AS \"user\", n FROM freq ORDER BY n DESC, usr LIMIT 10")
def _(spark, d):
    return iat.top_users(_freq(spark, d), 10)


# ---- rank, gap, tails, histograms --------------------------------------------------------------------------------

_OD = f"{_CP}, od AS (SELECT src AS id, sum(w) AS s, count(*) AS c FROM cp GROUP BY 1)"


def _scores(spark, d):
    return purchases(spark, d).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s"), F.count("*").alias("c"))


@query("rank_fusion", f"""WITH {_OD}, r AS (SELECT id, rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY c DESC) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b FROM od)
SELECT id, round(1 / (60 + a::DOUBLE) + 1 / (60 + b::DOUBLE), 9) AS fused FROM r""")
def _(spark, d):
    return stats.rank_fusion(_scores(spark, d), ["s", "c"]).select("id", F.round("fused", 9).alias("fused"))


@query("largest_gap_cut", f"""WITH {_OD}, r AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS k, s - lead(s) OVER (ORDER BY s DESC, id) AS g FROM od)
SELECT id, s FROM r WHERE k <= (SELECT k FROM r WHERE g IS NOT NULL ORDER BY g DESC, k LIMIT 1)""")
def _(spark, d):
    return stats.largest_gap_cut(_scores(spark, d).select("id", "s"), "s", "id")


@query("pareto_tail", f"""WITH {_OD}, q AS (SELECT quantile_cont(s, 0.9) AS q FROM od WHERE s > 0), t AS (SELECT id, s FROM od, q WHERE s >= q.q), f AS (SELECT min(s) AS m, count(*) / (sum(ln(s)) - count(*) * ln(min(s))) AS a FROM t)
SELECT id, s FROM t, f WHERE 1 - pow(m / s, a) >= 0.9""")
def _(spark, d):
    return stats.pareto_tail(_scores(spark, d).select("id", "s"), "s")


@query("log_grid_counts", """WITH x AS (SELECT src AS id, sum(w) AS s, count(*)::DOUBLE AS c FROM (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) GROUP BY 1),
m AS (SELECT greatest(1, ceil(log10(max(s)))) AS hs, greatest(1, ceil(log10(max(c)))) AS hc FROM x),
b AS (SELECT greatest(0, least(len([k FOR k IN range(21) IF pow(10, hs * k / 20) <= s]) - 1, 19)) AS cx, greatest(0, least(len([k FOR k IN range(21) IF pow(10, hc * k / 20) <= c]) - 1, 19)) AS cy FROM x, m)
SELECT cx, cy, count(*) AS n FROM b GROUP BY ALL""")
def _(spark, d):
    x = supplies(spark, d).groupBy("src").agg(F.sum("w").alias("s"), F.count("*").cast("double").alias("c"))
    return histogram.grid_counts(histogram.log_grid(x, "s", "c")).withColumnsRenamed({"bx": "cx", "by": "cy"})


@query("feature_histogram")
def _(spark, d):
    x = _scores(spark, d)
    edges = histogram.ticks(x, ["c", "s"], degree="c")
    return histogram.cells(histogram.assign(x, edges), ["c", "s"])


@query("rating_levels", """SELECT l_partkey AS sink, count(*) AS n, CAST(round(avg(r) * count(*)) AS BIGINT) AS total, CAST(round(var_pop(r) * count(*) * count(*)) AS BIGINT) AS spread, count(*) FILTER (r < 2.5) AS low, count(*) FILTER (r >= 2.5 AND r < 4) AS mid, count(*) FILTER (r >= 4) AS high
FROM (SELECT l_partkey, 1 + l_linenumber % 5 AS r FROM lineitem) GROUP BY 1 HAVING count(*) >= 2""")
def _(spark, d):
    from ..operators import bursts

    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("dst"), (1 + F.col("l_linenumber") % 5).alias("rate"))
    return bursts.rating_levels(e).select("sink", "n", F.round(F.col("mean") * F.col("n")).cast("long").alias("total"), F.round(F.col("var") * F.col("n") * F.col("n")).cast("long").alias("spread"), "low", "mid", "high")


@query("rating_kl", """WITH e AS (SELECT l_partkey AS sink, l_suppkey % 10 = 0 AS u, 1 + l_linenumber % 5 AS r FROM lineitem),
g AS (SELECT sink, count(*) FILTER (u) + 1.0::DOUBLE AS x, count(*) FILTER (NOT u) + 1.0::DOUBLE AS y, count(*) FILTER (u AND r < 2.5) + 1.0::DOUBLE AS s0, count(*) FILTER (u AND r >= 4) + 1.0::DOUBLE AS s1, count(*) FILTER (NOT u AND r < 2.5) + 1.0::DOUBLE AS o0, count(*) FILTER (NOT u AND r >= 4) + 1.0::DOUBLE AS o1, count(*) AS n FROM e GROUP BY 1)
SELECT sink, round((s0 / (s0 + s1) * ln((s0 / (s0 + s1)) / (o0 / (o0 + o1))) + s1 / (s0 + s1) * ln((s1 / (s0 + s1)) / (o1 / (o0 + o1)))) * least(x / y, y / x), 9) + 0 AS divergence FROM g WHERE n >= 2""")
def _(spark, d):
    from ..operators import bursts

    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (1 + F.col("l_linenumber") % 5).alias("rate"))
    users = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"))
    return bursts.rating_divergence(e, users).withColumn("divergence", F.round("divergence", 9) + 0)


@query("susp_ratio_exp_q", f"""WITH {_CP}, f AS (SELECT dst, sum(w) AS fu, coalesce(sum(w) FILTER (src % 7 = 0), 0) AS fa FROM cp GROUP BY 1) SELECT dst AS id, round(pow(32, fa / fu - 1), 9) AS p FROM f""")
def _(spark, d):
    from .holoscope import suspiciousness

    e = purchases(spark, d)
    users = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"))
    return suspiciousness(e, users).select("id", F.round("p", 9).alias("p"))


@query("flow_initial_score", """WITH l AS (SELECT l_orderkey, l_partkey AS m, l_suppkey AS a, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem), i AS (SELECT m, sum(x) AS i FROM l GROUP BY 1), o AS (SELECT m, sum(x) AS o FROM l JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
b AS (SELECT m, coalesce(i, 0)::DOUBLE AS i, coalesce(o, 0)::DOUBLE AS o FROM i FULL JOIN o USING (m))
SELECT m AS id, i AS inflow, o AS outflow, least(i, o) - 4 * abs(i - o) AS score FROM b""")
def _(spark, d):
    from .flow import middle_scores

    return middle_scores(flow(spark, d), alpha=4.0)


@query("cube_initial_score", """WITH l AS (SELECT l_orderkey, l_partkey AS mid, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS tbin, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem), i AS (SELECT mid, tbin, sum(x) AS i FROM l GROUP BY ALL), o AS (SELECT mid, tbin, sum(x) AS o FROM l JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT mid, tbin, least(coalesce(i, 0), coalesce(o, 0))::DOUBLE AS f, greatest(coalesce(i, 0), coalesce(o, 0))::DOUBLE AS q FROM i FULL JOIN o USING (mid, tbin)""")
def _(spark, d):
    from .flow import cube_strengths

    return cube_strengths(*coupled(spark, d)).select("mid", "tbin", "f", "q")


@query("money_per_month", "SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS tbin, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(month("l_shipdate").alias("tbin")).agg(F.sum(cents("l_extendedprice")).alias("cents"))


@query("components", """WITH RECURSIVE x AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000000 AS p FROM lineitem), e AS (SELECT s AS a, p AS b FROM x UNION ALL SELECT p, s FROM x),
r(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.id JOIN recurring.r o ON o.id = e.b WHERE r.component < o.component GROUP BY e.b)
SELECT id, component FROM r""")
def _(spark, d):
    return graph.components(trade(spark, d))


def _knows(spark, d):
    """Users who follow each other in time on one event type: a small graph of one node set."""
    e = events(spark, d).select("event_id", "event_type", "user_id")
    w = W.partitionBy("event_type").orderBy("event_id")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null and src <> dst").withColumn("w", F.lit(1.0))


_KN = """kn AS (SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM kn)"""


@query("triangles", f"""WITH {_KN}, t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM un x JOIN un y ON x.b = y.a JOIN un z ON z.a = x.a AND z.b = y.b)
SELECT id, count(*) AS triangles FROM (SELECT unnest([i, j, k]) AS id FROM t) GROUP BY id""")
def _(spark, d):
    return graph.triangles(_knows(spark, d))


@query("pagerank", f"""WITH RECURSIVE {_KN}, g AS (SELECT src, dst, count(*)::DOUBLE AS w FROM kn GROUP BY ALL), s AS (SELECT src, sum(w) AS s FROM g GROUP BY 1), p AS (SELECT src, dst, w / s AS p FROM g JOIN s USING (src)),
n AS (SELECT DISTINCT unnest([src, dst]) AS id FROM kn), c AS (SELECT count(*)::DOUBLE AS c FROM n),
r0 AS (SELECT id, 1 / c AS r FROM n, c),
r1 AS (SELECT n.id, 0.15 / c + 0.85 * (coalesce((SELECT sum(p.p * r0.r) FROM p JOIN r0 ON r0.id = p.src WHERE p.dst = n.id), 0) + coalesce((SELECT sum(r) FROM r0 WHERE id NOT IN (SELECT src FROM s)), 0) / c) AS r FROM n, c),
r2 AS (SELECT n.id, 0.15 / c + 0.85 * (coalesce((SELECT sum(p.p * r1.r) FROM p JOIN r1 ON r1.id = p.src WHERE p.dst = n.id), 0) + coalesce((SELECT sum(r) FROM r1 WHERE id NOT IN (SELECT src FROM s)), 0) / c) AS r FROM n, c),
r3 AS (SELECT n.id, 0.15 / c + 0.85 * (coalesce((SELECT sum(p.p * r2.r) FROM p JOIN r2 ON r2.id = p.src WHERE p.dst = n.id), 0) + coalesce((SELECT sum(r) FROM r2 WHERE id NOT IN (SELECT src FROM s)), 0) / c) AS r FROM n, c)
SELECT id, round(r, 9) AS rank FROM r3""")
def _(spark, d):
    g = _knows(spark, d).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return graph.pagerank(g, rounds=3).select("id", F.round("rank", 9).alias("rank"))


@query("core_numbers", f"""WITH RECURSIVE {_KN}, b AS MATERIALIZED (SELECT a AS id, b AS n FROM un UNION ALL SELECT b, a FROM un),
r(id, core) USING KEY (id) AS (SELECT id, count(*) FROM b GROUP BY id UNION
  SELECT h.id, h.core FROM (SELECT id, max(least(c, k)) AS core FROM (SELECT b.id, x.core AS c, row_number() OVER (PARTITION BY b.id ORDER BY x.core DESC) AS k FROM b JOIN recurring.r x ON x.id = b.n) GROUP BY id) h JOIN recurring.r o ON o.id = h.id
  WHERE h.core < o.core AND EXISTS (SELECT 1 FROM r))
SELECT id, core FROM r""")
def _(spark, d):
    return graph.core_numbers(_knows(spark, d))


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS score FROM sp)"]
    for i in range(1, rounds + 1):
        for new, old, give, take in ((f"a{i}", f"h{i - 1}", "src", "dst"), (f"h{i}", f"a{i}", "dst", "src")):
            steps.append(f"{new} AS (SELECT id, s / sqrt(sum(s * s) OVER ()) AS score FROM (SELECT {take} AS id, sum(w * score) AS s FROM sp JOIN {old} ON {old}.id = {give} GROUP BY 1))")
    return f"WITH {_SP}, {', '.join(steps)} SELECT 'hub' AS side, id, round(score, 6) AS score FROM h{rounds} UNION ALL SELECT 'authority', id, round(score, 6) FROM a{rounds}"


@query("hits_scores", _hits_sql(5))
def _(spark, d):
    hub, auth = graph.hits(supplies(spark, d), 5)
    return hub.select(F.lit("hub").alias("side"), "id", F.round("score", 6).alias("score")).unionByName(auth.select(F.lit("authority").alias("side"), "id", F.round("score", 6).alias("score")))
