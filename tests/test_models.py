"""Detectors, summaries and series models against plain Python and planted truth."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnmine.functions import linalg
from cairnmine.operators import generators, graph, stats
from cairnmine.plans import eaglemine, flow, holoscope, laws, peel, summarize, tasks, timeseries
from cairnmine.streaming import monlad, windows


def planted(spark, seed=0):
    noise = generators.even_block(spark, 120, 120, 0.03, seed)
    return generators.inject_block(noise, 12, 12, 0.9, 1, seed + 5).select("src", "dst", "w")


def plain_peel(edges):
    rows, cols = sorted({s for s, _, _ in edges}), sorted({d for _, d, _ in edges})
    nodes = [("r", x) for x in rows] + [("c", x) for x in cols]
    alive, best = list(nodes), (-1.0, None)
    while alive:
        inner = [(s, d, w) for s, d, w in edges if ("r", s) in alive and ("c", d) in alive]
        g = sum(w for *_, w in inner) / len(alive)
        if g > best[0] + 1e-9:
            best = (g, set(alive))
        deg = {n: sum(w for s, d, w in inner if (n[0] == "r" and s == n[1]) or (n[0] == "c" and d == n[1])) for n in alive}
        alive.remove(min(alive, key=lambda n: (deg[n], nodes.index(n))))
    return best


def test_exact_peel_against_plain_python():
    rng = random.Random(1)
    for _ in range(15):
        e = {(rng.randrange(8), rng.randrange(8)): float(rng.randint(1, 4)) for _ in range(25)}
        e = sorted((s, d, w) for (s, d), w in e.items())
        r, c, g = peel.peel_arrays(*[np.array(x) for x in zip(*e)])
        want = plain_peel(e)
        assert abs(g - want[0]) < 1e-9 and {("r", x) for x in r} | {("c", x) for x in c} == want[1]


def test_planted_block_is_found(spark):
    e = planted(spark)
    for found in (peel.fraudar(e, mode="exact"), peel.specgreedy(e)):
        rows = {r.id for r in found.where("kind = 'row'").collect()}
        assert len(rows & set(range(12))) >= 11 and len(rows) <= 40
    exact = peel.exact(e).first().density
    assert peel.batch(e, eps=0.5).first().density >= exact / 3 - 1e-9
    two = peel.fraudar(e, k=2, mode="exact")
    assert {r.block for r in two.select("block").distinct().collect()} == {0, 1}


def test_holoscope_finds_planted_users(spark):
    e = planted(spark, 3)
    users = {r.id for r in holoscope.holoscope(e, n_vectors=4).where("kind = 'row'").collect()}
    assert len(users & set(range(12))) >= 10
    a = spark.createDataFrame([(i,) for i in range(12)], "id long")
    assert holoscope.objective(e, a).first().objective > holoscope.objective(e, a.select((F.col("id") + 50).alias("id"))).first().objective


def test_singular_values(spark):
    rng = np.random.RandomState(0)
    a = rng.normal(size=(30, 20)) * (rng.uniform(size=(30, 20)) < 0.4)
    a[:6, :5] += 3
    i, j = np.nonzero(a)
    e = spark.createDataFrame(pd.DataFrame({"src": i, "dst": j, "w": a[i, j]}))
    sigma, left, right = linalg.singular(e, 2, rounds=12)
    u, s, vt = np.linalg.svd(a)
    np.testing.assert_allclose(sigma, s[:2], rtol=1e-3)
    x = np.zeros(30)
    for r in left.collect():
        x[r.id] = r.x0
    assert abs(abs(x @ u[:, 0]) - 1) < 1e-4
    g, h = linalg.sketch(a, np.eye(20))
    q, b = linalg.from_sketch(g, h, np.eye(20))
    np.testing.assert_allclose(q @ b, a, atol=1e-8)
    i, j = np.nonzero(a)
    assert abs(linalg.first_pair(i, j, a[i, j], a.shape, l=20)[1] - s[0]) < 1e-6
    sliding = linalg.SlidingSketch(a.shape[1], 2, l=20)
    for chunk in (a * 5, a[:7], a[7:]):
        sliding.push(chunk)
    u, top, v = sliding.first_pair()
    assert abs(top - s[0]) < 1e-6 and abs(abs(u @ a @ v) - s[0]) < 1e-6


def plain_flow(edges, a, alpha, end):
    nodes = {(l, s) for l, s, _, _ in edges} | {(l + 1, d) for l, _, d, _ in edges}
    alive, best = set(nodes), (-math.inf, None)
    layers = 2

    def score(n, live):
        i = sum(w for l, s, d, w in live if (l + 1, d) == n)
        o = sum(w for l, s, d, w in live if (l, s) == n)
        return end * (i + o) if n[0] in (0, layers) else a * min(i, o) - alpha * max(i, o)

    while alive:
        live = [(l, s, d, w) for l, s, d, w in edges if (l, s) in alive and (l + 1, d) in alive]
        p = {n: score(n, live) for n in alive}
        if len(alive) < len(nodes) and {n[0] for n in alive} == {0, 1, 2}:
            g = sum(v for n, v in p.items() if n[0] == 1) / len(alive)
            if g >= best[0]:
                best = (g, set(alive))
        alive.remove(min(alive, key=lambda n: (p[n], {0: 0, 2: 1, 1: 2}[n[0]], n[1])))
    return best


@pytest.mark.parametrize("a,alpha,end", [(5.0, 4.0, 5.0), (1.0, 0.8, 1.0)])
def test_flow_peel_against_plain_python(a, alpha, end):
    rng = random.Random(2)
    for _ in range(15):
        e = {(l, rng.randrange(5), rng.randrange(5)): float(rng.randint(1, 9)) for l in (0, 1) for _ in range(9)}
        e = sorted((l, s, d, w) for (l, s, d), w in e.items())
        sets, g = flow.peel_layers(e, 2, a, alpha, end)
        want = plain_flow(e, a, alpha, end)
        assert abs(g - want[0]) < 1e-9 and set().union(*sets) == want[1]


def test_flow_blocks(spark):
    rng = random.Random(0)
    rows = [(0, i, m, 100.0) for i in range(3) for m in range(3)] + [(1, m, c, 100.0) for m in range(3) for c in range(3)]
    rows += [(l, rng.randrange(10, 60), rng.randrange(10, 60), float(rng.randint(1, 9))) for l in (0, 1) for _ in range(150)]
    e = spark.createDataFrame(rows, "layer int, src long, dst long, w double")
    found = flow.flowscope(e, k=2)
    assert {(r.layer, r.id) for r in found.where("block = 0").collect()} == {(l, i) for l in range(3) for i in range(3)}
    a = e.where("layer = 0").select(F.col("src").alias("acct"), F.col("dst").alias("mid"), F.lit(1).cast("long").alias("tbin"), F.col("w").alias("amount"))
    c = e.where("layer = 1").select(F.col("dst").alias("acct"), F.col("src").alias("mid"), F.lit(1).cast("long").alias("tbin"), F.col("w").alias("amount"))
    cube = flow.cubeflow(a, c)
    assert {r.mid for r in cube.where("side = 'm'").collect()} == {0, 1, 2} and {r.acct for r in cube.where("side = 'a'").collect()} == {0, 1, 2}
    for delete in (0, 1, 2):
        assert flow.cubeflow(a, c, k=2, delete=delete).where("block = 1 and side = 'm' and mid < 3").count() == 0
    plus = flow.cubeflow_plus(a, c).collect()
    assert plus[0].n_a == 3 and plus[0].n_m == 3 and plus[0].n_c == 3


def plain_zero_out(transfers, up, down, eps):
    """Balances, then the source's check, then the destination's."""
    acc, to = {}, {}
    for src, dst, x in transfers:
        for n in (src, dst):
            acc.setdefault(n, {"bal": 0.0, "lo": 0.0, "hi": 0.0, "way": "", "tmp": 0, "n": 0, "nin": 0})
        acc[src]["bal"] -= x
        acc[dst]["bal"] += x
        for n, credit in ((src, False), (dst, True)):
            s = acc[n]
            old = s["way"]
            if credit and s["bal"] - s["lo"] > up:
                s["way"] = "up"
                s["tmp"] += 1
            if not credit and s["hi"] - s["bal"] > down and s["bal"] <= s["lo"] + eps:
                s["way"] = "down"
            s["hi"], s["lo"] = max(s["hi"], s["bal"]), min(s["lo"], s["bal"])
            if old == "up" and s["way"] == "down":
                s["lo"] = s["bal"]
                s["n"] += 1
                s["nin"] += s["tmp"]
                a, b = to.get(dst, (0, 0))
                to[dst] = (a + 1, b + s["tmp"])
                s["tmp"] = 0
            if old == "down" and s["way"] == "up":
                s["hi"] = s["bal"]
    return {k: (s["n"], s["nin"], *to.get(k, (0, 0))) for k, s in acc.items()}


def test_zero_out_batch_and_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, rng.randrange(5), rng.randrange(5), float(rng.randint(1, 40))) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, src long, dst long, amount double")
    moves = monlad.from_transfers(df)
    batch = {r.acct: (r["count"], r.count_in, r.count_to, r.count_in_to) for r in monlad.counts(moves, 30, 30, 20).collect()}
    assert batch == plain_zero_out([r[1:] for r in rows], 30, 30, 20) and sum(n for n, *_ in batch.values()) > 0
    for k in range(4):
        moves.where(F.floor(F.col("seq") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def keep(out, _):
        last.update({r.acct: (r["count"], r.count_in) for r in out.collect()})

    q = monlad.stream_counts(stream, 30, 30, 20).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert last == {k: v[:2] for k, v in batch.items()}


def test_windows(spark):
    df = spark.createDataFrame([(f"2024-01-01 00:00:{s:02d}",) for s in (0, 3, 5, 9, 12, 14, 17)], "ts string").select(F.to_timestamp("ts").alias("ts"))
    s = sorted((r.win, r.ts.second) for r in windows.sliding(df, "ts", 10, 5).collect())
    assert s == sorted((k, x) for x in (0, 3, 5, 9, 12, 14, 17) for k in range(10) if 5 * k <= x < 5 * k + 10)
    assert sorted((r.win, r.ts.second) for r in windows.batches(df, "ts", 10, 5).collect()) == [(0, 0), (0, 3), (0, 5), (0, 9), (1, 12), (1, 14), (2, 17)]


def test_stream_density(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 3, "a") for m in range(40)]
    df = spark.createDataFrame(rows, "ts string, u int, i string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.stream_density(stream, "ts", "u", "i", "10 minutes", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("dens").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.density for r in spark.sql("select density from dens").collect()) == [2.5] * 4


def test_summaries_keep_weight(spark):
    e = planted(spark, 9).where("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct()
    member, sup = summarize.dpgs(both, rounds=2, bands=20)
    assert sup.agg(F.sum("w")).first()[0] == both.agg(F.sum("w")).first()[0]
    assert member.count() == both.select("src").distinct().count()
    small = both.where("src < 15 and dst < 15")
    for strategy in ("greedy", "linear_check", "sample_pairs"):
        m, s = summarize.kgrass(small, 4, strategy)
        assert m.select("super").distinct().count() == 4 and s.agg(F.sum("w")).first()[0] == small.count()
    alone, _ = summarize.kgrass(small, 1000)
    assert summarize.summary_error(small, alone).first().error == 0
    assert summarize.summary_error(small, m).first().error >= 0


def test_graph_operators_against_plain_python(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(90)}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    tri = {n: sum(1 for x in v for y in v if x < y and y in adj[x]) for n, v in adj.items()}
    assert {r.id: r.triangles for r in graph.triangles(e).collect()} == {n: t for n, t in tri.items() if t}
    core, live, k = {}, {n: set(v) for n, v in adj.items()}, 0
    while live:
        k = max(k, min(map(len, live.values())))
        n = min(live, key=lambda x: len(live[x]))
        core[n] = k
        for x in live.pop(n):
            live[x].discard(n)
    assert {r.id: r.core for r in graph.core_numbers(e).collect()} == core
    comp = {r.id: r.component for r in graph.components(e).collect()}
    assert all(comp[a] == comp[b] for a, b in pairs) and all(c <= n for n, c in comp.items())
    same = graph.same_component(graph.components(e), spark.createDataFrame([(0, 0), (1, 2)], "a long, b long")).collect()
    assert len(same) == 2
    rank = graph.pagerank(e, rounds=30)
    assert abs(rank.agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_code_lengths():
    assert [stats.elias_decode(stats.elias_bits(z)) for z in range(-9, 10)] == [[z] for z in range(-9, 10)]
    assert stats.universal_length(1) == pytest.approx(math.log2(2.865064))
    assert stats.log_choose(10, 3) == pytest.approx(math.log2(120)) and stats.uniform_length(10, 5) == pytest.approx(10)


def test_code_length_column(spark):
    df = spark.createDataFrame([(float(z), 0.0) for z in range(-9, 10)], "a double, b double")
    assert stats.code_length_of_differences(df, "a", "b").first().bits == sum(len(stats.elias_bits(z)) for z in range(-9, 10))


def test_micro_clusters(spark):
    rng = np.random.RandomState(0)
    pts = np.concatenate([rng.normal((10, 10), 1.2, (4000, 2)), rng.normal((25, 24), 1.0, (1500, 2))])
    cells = pd.DataFrame(np.floor(pts).astype(int), columns=["a", "b"]).value_counts().reset_index(name="n")
    df = spark.createDataFrame([([int(a), int(b)], int(n), 1.0) for a, b, n in cells.itertuples(index=False)], "cell array<long>, n long, weight double")
    rows = eaglemine.cluster_cells(df).collect()
    label = {tuple(r.cell): r.label for r in rows}
    assert label[(10, 10)] >= 0 and label[(25, 24)] >= 0 and label[(10, 10)] != label[(25, 24)]
    assert len(rows) == len(cells)
    tree = eaglemine.level_tree({(x, y): 5 - max(abs(x - 5), abs(y - 5)) for x in range(11) for y in range(11)}, step=1.0)
    back = eaglemine.tree_from_rows(eaglemine.tree_rows(tree))
    assert [b.cells for b in back] == [t.cells for t in tree]


def test_goodness_of_fit():
    rng = np.random.RandomState(3)
    x = rng.normal(size=300)
    x = x[x > -1]
    assert laws.truncated_p(x, 0, 1, -1) > 0.02 and laws.truncated_p(np.exp(x * 2), 0, 1, -1) < 0.02
    for statistic in (laws.quadratic_ad, laws.supremum_ad, lambda z, h: laws.supremum_ad(z, h, "less", True)):
        assert laws.truncated_p(x, 0, 1, -1, statistic) > 0.02 and laws.truncated_p(x * 2, 0, 1, -2, statistic) < 0.05
    assert eaglemine.weighted_ad(x, np.ones(len(x))) > 0
    assert eaglemine.chi2_tail(5.991, 2) == pytest.approx(0.05, abs=1e-3) and eaglemine.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-3)


def test_box_probabilities():
    cov = np.array([[2.0, 0.7], [0.7, 1.0]])
    grid = np.array([(a, b) for a in range(-12, 12) for b in range(-10, 10)], float)
    p = laws.rectangle(grid, grid + 1, [0.3, -0.2], cov)
    assert p.sum() == pytest.approx(1, abs=1e-6)
    x = np.random.RandomState(1).multivariate_normal([0.3, -0.2], cov, 200_000)
    inside = ((x >= [0, -1]) & (x < [1, 0])).all(axis=1).mean()
    assert laws.rectangle([[0, -1]], [[1, 0]], [0.3, -0.2], cov)[0] == pytest.approx(inside, abs=0.004)
    assert laws.rectangle([[-np.inf, 0, 0]], [[np.inf, np.inf, np.inf]], np.zeros(3), np.eye(3))[0] == pytest.approx(0.25, abs=1e-6)


def test_truncated_and_mixed_fits():
    rng = np.random.RandomState(5)
    counted = lambda x: (lambda t: (np.array(list(t.index), float), t.to_numpy(float)))(pd.DataFrame(np.floor(x).astype(int)).value_counts())
    x = rng.multivariate_normal([1.0, 4.0], [[6.0, 1.0], [1.0, 2.0]], 30_000)
    left, n = counted(x[(x >= 0).all(axis=1)])
    found = laws.fit_truncated(left, n)
    assert np.allclose(found.means[0], [1.0, 4.0], atol=0.8) and np.allclose(np.diag(found.covs[0]), [6.0, 2.0], rtol=0.35)
    assert found.loss(left, n) < laws.fit_normal(left, n).loss(left, n) and len(found.parameters()) == 5
    two = np.concatenate([rng.normal((6, 6), 1.5, (6000, 2)), rng.normal((16, 12), 1.0, (2000, 2))])
    left, n = counted(two[(two >= 0).all(axis=1)])
    for low in (None, 0.0):
        mixed = laws.fit_mixture(left, n, 2, low)
        order = np.argsort(mixed.means[:, 0])
        assert np.allclose(mixed.means[order], [[6, 6], [16, 12]], atol=0.3) and np.allclose(mixed.weights[order], [0.75, 0.25], atol=0.03)
        assert laws.is_truncated(left, n, mixed, alpha=0.01)
    tail = counted(np.exp(rng.normal(size=(5000, 2))) * 2)
    assert not laws.is_truncated(*tail, laws.fit_truncated(*tail), alpha=0.01)
    own = mixed.probability(left, left + 1)
    one = laws.description_length(n, np.zeros(len(n), int), own, [mixed], (20, 20))
    assert one < laws.description_length(n, np.full(len(n), -1), own, [], (20, 20))


def test_islands_merge_by_loss_and_have_a_heavy_path():
    cells = {(a, b): int(1 + 400 * np.exp(-((a - 8) ** 2 + (b - 8) ** 2) / 8)) for a in range(17) for b in range(17)}
    half = [eaglemine.Island(frozenset(c for c in cells if (c[0] < 8) == side), 1.0) for side in (True, False)]
    far = eaglemine.Island(frozenset((a + 60, b) for a in range(4) for b in range(4)), 1.0)
    n = cells | {c: 50 for c in far.cells}
    merged = eaglemine.merge_by_loss([*half, far], n)
    assert sorted(len(i.cells) for i, _ in merged) == [16, 289]
    tree = eaglemine.level_tree({c: math.log2(1 + v) for c, v in n.items()}, step=1.0)
    path = eaglemine.heavy_path(tree, n)
    assert (8, 8) in path[-1].cells and all(b.cells < a.cells for a, b in zip(path, path[1:]))
    assert len(eaglemine.describe(tree, n)) >= len(path)


def test_segments_of_two_patterns(spark):
    t = np.arange(20)
    a, b = np.sin(t / 20 * 2 * np.pi), (t > 10) * 3.0
    x = np.concatenate([a, a, b, b, a, b])
    segs, models = timeseries.segment(x[:, None], 18, 22, most_models=4)
    assert segs[0][0] == 0 and segs[-1][1] == len(x) and all(p[1] == q[0] for p, q in zip(segs, segs[1:])) and len(models) <= 4
    df = spark.createDataFrame([("s", i, [float(v)]) for i, v in enumerate(x)], "series string, pos long, v array<double>")
    assert [(r.start, r.end) for r in timeseries.beatlex(df, 18, 22, 4).orderBy("start").collect()] == [(s, e) for s, e, *_ in segs]
    assert timeseries.warp_cost(a[:, None], a[:, None])[0] == 0


def test_peaks_and_beats(spark):
    x = np.zeros(400)
    x[[50, 150, 250, 350]] = 10
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, pos long, v double")
    found = timeseries.peaks(df, 5)
    assert sorted(r.pos for r in found.collect()) == [50, 150, 250, 350]
    seg = timeseries.beat_segments(df, found, 60, 40)
    assert {r.peak for r in seg.collect()} == {150, 250, 350} and seg.count() == 300


def test_reconstruction_and_metrics(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 10))
    x[:10] += rng.normal(size=(10, 10)) * 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    mean, comps = timeseries.principal_components(df, 3)
    s = timeseries.reconstruction_scores(df, mean, comps).withColumn("label", (F.col("id") < 10).cast("int"))
    m = timeseries.evaluate(s).first()
    assert m.auc_roc > 0.95 and 0 < m.best_f1 <= 1


def split_one_by_one(acct, mid, most):
    """Components by search; each too large one loses its middle of largest degree."""
    left, gone = list(zip(acct.tolist(), mid.tolist())), set()
    degree = {m: sum(x == m for x in mid.tolist()) for m in set(mid.tolist())}
    while True:
        graph_ = {}
        for a, m in left:
            graph_.setdefault(("a", a), set()).add(("m", m))
            graph_.setdefault(("m", m), set()).add(("a", a))
        seen, large = set(), []
        for x in graph_:
            if x not in seen:
                todo, part = [x], set()
                while todo:
                    y = todo.pop()
                    if y not in part:
                        part.add(y)
                        todo += graph_[y]
                seen |= part
                if len(part) > most:
                    large.append(part)
        if not large:
            return gone
        drop = {max((m for k, m in part if k == "m"), key=lambda m: (degree[m], -m)) for part in large}
        gone |= drop
        left = [(a, m) for a, m in left if m not in drop]


def test_splitting_takes_middles_as_step_by_step():
    rng = np.random.RandomState(8)
    for most in (3, 6, 12, 100):
        pairs = np.unique(np.stack([rng.randint(0, 25, 60), rng.randint(0, 20, 60)], axis=1), axis=0)
        assert set(flow.split_middles(pairs[:, 0], pairs[:, 1], most).tolist()) == split_one_by_one(pairs[:, 0], pairs[:, 1], most)


def test_limits_of_one_task_are_checked(spark, monkeypatch):
    e = planted(spark, 2)
    for module in (peel, flow, summarize):
        monkeypatch.setattr(module, "MOST_EXACT", 10)
    for run in (lambda: peel.fraudar(e), lambda: peel.symmetric(e), lambda: summarize.kgrass(e, 4), lambda: flow.flowscope(e.withColumn("layer", F.lit(0)))):
        with pytest.raises(ValueError):
            run()
    assert peel.fraudar(e, mode="batch").count() > 0
    with pytest.raises(ValueError):
        peel.fraudar(e, mode="auto")


def test_undirected_block_and_tensor_candidates(spark):
    e = planted(spark, 3).select("src", (F.col("dst") + 1000).alias("dst"), "w")
    found = {r.id for r in peel.specgreedy_undirected(e, 3).collect()}
    assert len(found & (set(range(12)) | set(range(1000, 1012)))) >= 20
    t = e.withColumn("tbin", F.when((F.col("src") < 12) & (F.col("dst") < 1012), 0).otherwise(F.col("src") % 7))
    users = {r.id for r in holoscope.holoscope(e, n_vectors=2, tensor=(t, ["tbin"])).where("kind = 'row'").collect()}
    assert len(users & set(range(12))) >= 10


def test_fit_and_predict(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    model = tasks.reconstruction(k=2)
    with pytest.raises(ValueError):
        model.predict(v)
    assert model.fit(v).predict(v).count() == 40


def test_tasks(spark):
    e = planted(spark, 2)
    assert tasks.Task("anomaly_detection", "fraudar", e).run(k=1, mode="exact").count() > 0
    with pytest.raises(NotImplementedError):
        tasks.Task("forecast", "fraudar", e)
    chain = tasks.PipeLine([(lambda df, least: df.where(F.col("w") >= least), {"least": 1.0}), ("fraudar", {"mode": "exact"})])
    assert chain.run(e).count() > 0
    tasks.register("own", lambda df: df, "forecast")
    assert tasks.models("forecast") == ("own",)


def test_whole_tables_are_summarised(spark, sf):
    """Every supplier, part and customer with a line item is in the results of kgrass_summary and cube_component_score."""
    from cairnmine import catalog
    from cairnmine.llm.common import table

    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    n_s, n_p = l.select("l_suppkey").distinct().count(), l.select("l_partkey").distinct().count()
    n_c = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("o_custkey").distinct().count()
    member = catalog.queries()["kgrass_summary"](spark, sf).collect()
    assert len(member) == n_s + n_p and len({r["super"] for r in member}) == 12
    found = catalog.queries()["cube_component_score"](spark, sf).collect()
    assert [sum(r[c] for r in found) for c in ("n_a", "n_m", "n_c")] == [n_s, n_p, n_c]


@pytest.mark.parametrize("way", ["exact", "symmetric", "flow"])
def test_exact_peeling_takes_more_than_two_million_edges(spark, way):
    """A complete graph between 1,001 and 2,000 nodes is its own densest part."""
    e = spark.range(2_002_000).select((F.col("id") % 1001).alias("src"), (F.floor(F.col("id") / 1001) + 5000).alias("dst"), F.lit(2.0).alias("w"))
    if way == "flow":
        both = e.select(F.lit(0).alias("layer"), "src", "dst", "w").unionByName(e.select(F.lit(1).alias("layer"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2.0).alias("w")).where("dst < 3"))
        found = flow.flowscope(both)
        assert {r.layer for r in found.select("layer").distinct().collect()} == {0, 1, 2}
    else:
        found = (peel.exact if way == "exact" else peel.symmetric)(e)
        assert found.count() == 3001 and abs(found.first().density - 2 * 2_002_000 / 3001) < 1e-9


def test_flow_peel_of_wide_nodes_against_plain_python(monkeypatch):
    """The same with all edges of a node taken at once, as those of nodes with many are."""
    from cairnmine.plans import removal

    monkeypatch.setattr(removal, "FEW", 0)
    test_flow_peel_against_plain_python(1.0, 0.8, 1.0)


def test_neighbours_tie_by_rounded_similarity_as_in_sql(spark, tmp_path):
    """Similarities that differ beyond the sixth place only: SQL ranks what is rounded, then ids."""
    import duckdb

    from cairnmine import catalog

    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 0.1 + (9 - i) * 1e-8]) for i in range(1, 9)] + [(9, [-1.0, 0.5]), (20, [0.5, 0.25])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("cosine_topk", "pearson_pairs"):
        want = duckdb.sql(catalog.oracle_sql()[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
        got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
        assert len(want) and sorted(got) == sorted(want)


def test_similarities_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (0, [5.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = graph.similarities(v, v.where("id = 1"), digits=6).collect()
    assert sorted((r.id, r.similarity) for r in got if r.similarity is not None) == [(0, round(14 / (26**0.5 * 20**0.5), 6)), (0, 1.0)]
    assert sorted(r.id for r in got if r.similarity is None) == [2, 3, 4, 5]
    top = graph.top_neighbours(v, v.where("id = 1"), 3, digits=6).collect()
    assert [r.id for r in top] == [0, 0, 2] and top[2].similarity is None


def test_chunks_of_a_group_do_not_depend_on_other_groups(spark, monkeypatch):
    monkeypatch.setattr(summarize, "CHUNK", 8)
    alike = lambda n, m, at: [(at + i, at + 1000 + j, 1.0) for i in range(n) for j in range(m)]
    both = lambda rows: spark.createDataFrame(rows + [(d, s, w) for s, d, w in rows], "src long, dst long, w double")
    small, large = alike(4, 6, 0), alike(20, 30, 10_000)
    alone = {r.id: r["super"] for r in summarize.dpgs(both(small), rounds=1)[0].collect()}
    beside = {r.id: r["super"] for r in summarize.dpgs(both(small + large), rounds=1)[0].collect()}
    assert len(set(alone.values())) < len(alone) and alone == {i: s for i, s in beside.items() if i < 10_000}
    assert all(list(beside.values()).count(s) <= 8 for s in set(beside.values()))
