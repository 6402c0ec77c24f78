"""Queries of the models over the driver's tables. Sequential or seeded algorithms have no SQL twin; tests hold them against
models in plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import bursts, graph
from ..streaming import monlad, windows
from . import eaglemine, flow, holoscope, peel, summarize, timeseries
from .inputs import coupled, events, purchases, supplies, table, trade
from .inputs import flow as flow_edges

_SEC = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"


@query("fraudar_block")
def _(spark, d):
    return peel.fraudar(purchases(spark, d), k=2)


@query("fraudar_block_batch")
def _(spark, d):
    return peel.fraudar(supplies(spark, d), k=1, mode="batch")


@query("sqrt_weighted_block")
def _(spark, d):
    return peel.fraudar(supplies(spark, d), weights="sqrt")


@query("average_degree_block")
def _(spark, d):
    return peel.fraudar(supplies(spark, d), weights="even")


@query("symmetric_block")
def _(spark, d):
    return peel.symmetric(trade(spark, d))


@query("specgreedy_block")
def _(spark, d):
    return peel.specgreedy(supplies(spark, d), k=2).withColumn("density", F.round("density", 6))


@query("specgreedy_undirected_block")
def _(spark, d):
    return peel.specgreedy_undirected(trade(spark, d)).withColumn("density", F.round("density", 6))


@query("holoscope_tensor_block")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("w"))
    return holoscope.holoscope(supplies(spark, d), n_vectors=2, tensor=(t, ["month"])).withColumn("score", F.round("score", 6)).withColumn("objective", F.round("objective", 6))


@query("suspects_added", """SELECT l_partkey AS sink, list_sort(list(l_linenumber)) AS props FROM lineitem WHERE l_suppkey % 10 IN (0, 3) GROUP BY 1""")
def _(spark, d):
    """Suspects in two steps."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    some = lambda k: table(spark, d, "supplier").where(f"s_suppkey % 10 = {k}").select(F.col("s_suppkey").alias("id"))
    none = spark.createDataFrame([], "sink long, props array<int>")
    return bursts.add_suspects(bursts.add_suspects(none, e, some(0), "l_linenumber"), e, some(3), "l_linenumber")


@query("suspects_removed", "SELECT l_partkey AS sink, list_sort(list(l_linenumber)) AS props FROM lineitem WHERE l_suppkey % 10 = 3 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    some = lambda c: table(spark, d, "supplier").where(c).select(F.col("s_suppkey").alias("id"))
    all_ = bursts.add_suspects(spark.createDataFrame([], "sink long, props array<int>"), e, some("s_suppkey % 10 in (0, 3)"), "l_linenumber")
    return bursts.remove_suspects(all_, e, some("s_suppkey % 10 = 0"), "l_linenumber")


@query("eigenspokes")
def _(spark, d):
    return peel.eigenspokes(supplies(spark, d), 3).withColumn("score", F.round("score", 6))


@query("spectral_block")
def _(spark, d):
    return peel.spectral_block(supplies(spark, d)).withColumn("score", F.round("score", 6))


@query("holoscope_block")
def _(spark, d):
    return holoscope.holoscope(supplies(spark, d), n_vectors=3).withColumn("score", F.round("score", 6)).withColumn("objective", F.round("objective", 6))


@query("holoscope_signals_block")
def _(spark, d):
    e = table(spark, d, "lineitem")
    rate = 1 + F.col("l_linenumber") % 5
    signals = e.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count_if(F.month("l_shipdate") == 6).alias("bursts"), F.count_if(rate < 2.5).alias("low"), F.count_if(rate >= 4).alias("high"))
    return holoscope.holoscope(supplies(spark, d), n_vectors=2, signals=signals, level=3).withColumn("score", F.round("score", 6)).withColumn("objective", F.round("objective", 6))


@query("flowscope_block")
def _(spark, d):
    return flow.flowscope(flow_edges(spark, d)).withColumn("objective", F.round("objective", 3))


@query("cubeflow_block")
def _(spark, d):
    return flow.cubeflow(*coupled(spark, d)).withColumn("objective", F.round("objective", 3))


@query("cubeflow_plus")
def _(spark, d):
    return flow.cubeflow_plus(*coupled(spark, d)).withColumn("score", F.round("score", 3))


_MONTH, _CENTS = "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT)", "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query("cube_component_score", f"""WITH RECURSIVE a AS (SELECT l_suppkey AS acct, l_partkey AS mid, {_MONTH} AS tbin, sum({_CENTS}) AS amount FROM lineitem GROUP BY ALL),
c AS (SELECT o_custkey AS acct, l_partkey AS mid, {_MONTH} AS tbin, sum({_CENTS}) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
x AS (SELECT acct * 4 AS x, mid * 4 + 1 AS y FROM a UNION SELECT mid * 4 + 1, acct * 4 + 2 FROM c), e AS (SELECT x, y FROM x UNION ALL SELECT y, x FROM x),
r(id, component) USING KEY (id) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, min(r.component) FROM r JOIN e ON e.x = r.id JOIN recurring.r o ON o.id = e.y WHERE r.component < o.component GROUP BY e.y),
i AS (SELECT mid, tbin, sum(amount)::DOUBLE AS i FROM a GROUP BY ALL), o AS (SELECT mid, tbin, sum(amount)::DOUBLE AS o FROM c GROUP BY ALL),
m AS (SELECT coalesce(i.mid, o.mid) AS mid, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM i FULL JOIN o ON i.mid = o.mid AND i.tbin = o.tbin),
g AS (SELECT component, sum(least(i, o) - 0.8::DOUBLE * greatest(i, o)) AS g, count(*) AS k FROM m JOIN r ON r.id = mid * 4 + 1 GROUP BY 1),
n AS (SELECT component, count(*) FILTER (id % 4 = 0) AS n_a, count(*) FILTER (id % 4 = 1) AS n_m, count(*) FILTER (id % 4 = 2) AS n_c FROM r GROUP BY 1)
SELECT component, n_a, n_m, n_c, round(g / (n_a + k + n_c), 3) AS score FROM n JOIN g USING (component)""")
def _(spark, d):
    return flow.component_scores(*coupled(spark, d)).withColumn("score", F.round("score", 3))


_DENS = f"""e AS (SELECT {_SEC} AS s, user_id, event_type FROM events), m AS (SELECT min(s) AS t0 FROM e),
w AS (SELECT unnest(range(greatest(0, CAST(floor((s - t0 - 86400) / 43200.0) AS BIGINT) + 1), (s - t0) // 43200 + 1)) AS win, user_id, event_type FROM e, m),
den AS (SELECT win, round(count(*)::DOUBLE / (count(DISTINCT user_id) + count(DISTINCT event_type)), 2) AS density FROM w GROUP BY win)"""


def _dens(spark, d):
    w = windows.sliding(events(spark, d), "ts", 86400, 43200)
    return windows.window_density(w, "user_id", "event_type")


@query("sliding_window_density", f"WITH {_DENS} SELECT win, density FROM den")
def _(spark, d):
    return _dens(spark, d)


@query("surge_windows", f"WITH {_DENS} SELECT win, density FROM den WHERE density > (SELECT avg(density) + 3 * stddev_samp(density) FROM den)")
def _(spark, d):
    return windows.surges(_dens(spark, d))


@query("disjoint_batches", f"""WITH e AS (SELECT {_SEC} AS s FROM events), m AS (SELECT min(s) AS t0 FROM e)
SELECT CASE WHEN s - t0 < 86400 THEN 0 ELSE (s - t0 - 86400) // 43200 + 1 END AS win, count(*) AS n FROM e, m GROUP BY 1""")
def _(spark, d):
    return windows.batches(events(spark, d), "ts", 86400, 43200).groupBy("win").agg(F.count("*").alias("n"))


@query("eigenpulse")
def _(spark, d):
    w = windows.sliding(events(spark, d), "ts", 3 * 86400, 86400).withColumn("h", F.hour("ts"))
    return windows.eigenpulse(w, "user_id", "event_type", "h")


def _moves(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("acct"), F.when(F.col("event_type") == "purchase", "debit").when(F.col("event_type").isin("signup", "view"), "credit").alias("type"), F.col("value").alias("amount"))
    return monlad.from_types(e, "debit", "credit")


@query("monlad_counts")
def _(spark, d):
    return monlad.counts(_moves(spark, d), 50, 50, 100).withColumn("balance", F.round("balance", 4))


@query("monlad_anomalies")
def _(spark, d):
    return monlad.anomalies(monlad.counts(_moves(spark, d), 50, 50, 100), 0.8, 0.5)


@query("account_moves", "SELECT user_id AS acct, event_id AS seq, 0 AS side, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS sign, value AS amount, CAST(NULL AS BIGINT) AS other FROM events WHERE event_type IN ('purchase', 'signup', 'view')")
def _(spark, d):
    return _moves(spark, d)


@query("dpgs_summary")
def _(spark, d):
    e = trade(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return summarize.dpgs(both)[0]


@query("kgrass_summary")
def _(spark, d):
    return summarize.kgrass(trade(spark, d), 12)[0]


@query("beatlex_segments")
def _(spark, d):
    e = events(spark, d)
    hours = e.groupBy("event_type", F.floor(F.unix_micros("ts") / 3_600_000_000).cast("long").alias("pos")).agg(F.count("*").cast("double").alias("n"))
    return timeseries.beatlex(hours.select(F.col("event_type").alias("series"), "pos", F.array("n").alias("v")), 12, 36)


@query("eaglemine_labels")
def _(spark, d):
    return eaglemine.eaglemine(eaglemine.features(purchases(spark, d)), bins=20).select("id", F.array_join(F.col("cell").cast("array<string>"), ",").alias("cell"), "label", F.round("p", 6).alias("p"))


@query("eaglemine_truncated_labels")
def _(spark, d):
    found = eaglemine.eaglemine(eaglemine.features(purchases(spark, d)), bins=20, law="truncated")
    return found.select("id", F.array_join(F.col("cell").cast("array<string>"), ",").alias("cell"), "label", F.round("p", 6).alias("p"), F.round("bits", 3).alias("bits"))


@query("rpeak_segments")
def _(spark, d):
    e = events(spark, d).groupBy(F.floor(F.unix_micros("ts") / 3_600_000_000).cast("long").alias("pos")).agg(F.count("*").cast("double").alias("v"))
    x = e.select(F.lit("all").alias("series"), "pos", "v")
    return timeseries.beat_segments(x, timeseries.peaks(x, 6), 6, 6)


@query("beat_reconstruction_scores")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    mean, comps = timeseries.principal_components(v, 8)
    return timeseries.reconstruction_scores(v, mean, comps).withColumn("score", F.round("score", 6))


@query("detector_metrics", """WITH x AS (SELECT toxic AS label, length(text) % 97 AS score FROM labels JOIN documents USING (doc_id)), b AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM x GROUP BY 1), t AS (SELECT sum(p) AS tp, sum(n - p) AS tn FROM b),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS up, sum(n) OVER (ORDER BY score DESC) AS k FROM b)
SELECT round(sum((n - p) * (up - p / 2)) / max(tp * tn), 9) AS auc_roc, round(sum(p / tp * up / k), 9) AS auc_pr, round(max(2 * up / (k + tp)), 9) AS best_f1 FROM c, t""")
def _(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("label"), (F.length("text") % 97).alias("score"))
    return timeseries.evaluate(x).select(F.round("auc_roc", 9).alias("auc_roc"), F.round("auc_pr", 9).alias("auc_pr"), F.round("best_f1", 9).alias("best_f1"))


def _timed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000).cast("long").alias("ts"))


@query("sink_bursts")
def _(spark, d):
    out = bursts.sink_bursts(_timed(spark, d), 1e12)
    return out.select("sink", "n", F.round("t_mean", 3).alias("t_mean"), F.size("bursts").alias("n_bursts"), F.round("fall", 6).alias("fall"))


@query("burst_share")
def _(spark, d):
    e = _timed(spark, d)
    users = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"))
    return bursts.burst_share(e, bursts.sink_bursts(e, 1e12), users).withColumn("share", F.round("share", 6))


@query("suspect_properties", "SELECT l_partkey AS sink, list_sort(list(l_linenumber)) AS props FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    users = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"))
    return bursts.suspect_properties(e, users, "l_linenumber")


@query("graph_inside_strengths", "SELECT l_suppkey AS id, sum(l_quantity) AS degree FROM lineitem GROUP BY 1")
def _(spark, d):
    return graph.degree(supplies(spark, d), "src")
