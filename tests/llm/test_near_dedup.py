import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairnmine.llm import common, near_dedup
from cairnmine.llm import text as tx


def brute(rows, size):
    """Components by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_groups=12, size=12):
    rng = random.Random(seed)
    out, i = [], 0
    common_words = [f"c{k}" for k in range(12)]
    for g in range(n_groups):
        base = [rng.choice(common_words) if rng.random() < 0.3 else f"g{g}w{k}" for k in range(rng.randint(20, 80))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 99999)}"
            out.append((i, " ".join(t)))
            i += 1
    return out


def check(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=size).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, size).items()}


def test_against_brute_force(spark):
    check(spark, corpus(1), 2)
    check(spark, corpus(2), 5)


def test_branching_and_buckets(spark, monkeypatch):
    """Tiny limits, so that nodes branch, dense ones are bucketed, and large blobs go through blocks and star rounds."""
    for name, v in (("LEAF", 4), ("BUCKET", 6), ("HUBS", 2)):
        monkeypatch.setattr(near_dedup, name, v)
    monkeypatch.setattr(common, "LOCAL_EDGES", 3)
    check(spark, corpus(3, 6, 30), 2)


def test_one_word_away_from_the_threshold(spark):
    a = [f"w{i}" for i in range(82)]
    for k in range(20):
        b = a[: 81 - k] + [f"z{i}" for i in range(k + 1)]
        rows = [(1, " ".join(a)), (2, " ".join(b))]
        want = brute(rows, 2)[2][1]
        s = list(tx.shingle_sets(pa.array([r[1] for r in rows]), 2))
        assert near_dedup._near(s[0], s[1]) == (want == 1)


def test_nasty_rows(spark, nasty, nothing):
    rows = near_dedup.near_duplicates(nasty, shingle=2).collect()
    assert len(rows) == nasty.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1 and got[1].kept and not got[2].kept
    for i in (4, 5, 6):
        assert got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept
    assert got[7].n_shingles == 1 and got[8].component_id == 7 and got[10].component_id == 9
    assert got[None].kept is False and sum(r.doc_id == 11 for r in rows) == 2
    assert got[14].component_id == 14
    assert near_dedup.near_duplicates(nothing, shingle=2).count() == 0


def test_one_id_with_two_texts(spark):
    base = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(3)]
    rows = [(1, base[0]), (5, base[0] + " more"), (5, base[1]), (7, base[1] + " more"), (9, base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit(0)).withColumn("kept", F.lit(1))  # clashing names
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True)]


def templated(n, shared=140, own=60, seed=2):
    """Pairs of near copies that share a template."""
    rng = random.Random(seed)
    template, docs = [f"t{i}" for i in range(shared)], []
    for i in range(n):
        words = template + [f"p{i // 2}x{rng.randrange(10**6) if j == 0 else j}" for j in range(own)]
        docs.append((i, " ".join(words)))
    return docs


def test_templates_join_no_blobs(spark):
    docs = templated(1200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 5).collect()}
    assert got == {i: i // 2 * 2 for i in range(1200)}
    sketches = [near_dedup.minwise(s) for s in tx.shingle_sets(pa.array([t for _, t in docs[:400:2]]), 5, tx.NOT_SPACE)]
    sk = np.stack([x[1] for x in sketches]).view(np.uint64)
    far = near_dedup.unequal(sk[:, None, :], sk[None, :, :])[np.triu_indices(200, 1)]
    assert (far > near_dedup.most_unequal(np.array(190))).all()  # so that blobs are pairs and work grows with the rows


def near_templates(n, shared=160, own=40, seed=2):
    """Pairs barely above the threshold among texts of one template, which are below it."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [f"t{k}" for k in range(shared)] + [f"p{i // 2}x{k}" for k in range(own)]
        for k in range(5, own, 9):
            words[shared + k] = f"z{rng.randrange(10**9)}" if i % 2 else words[shared + k]
        docs.append((i, " ".join(words)))
    return docs


def test_dense_nodes_lose_no_pair(spark, monkeypatch):
    """All sets choose the same ways, so every node is dense; a pair's sets meet in few buckets of it or in none."""
    for name, v in (("LEAF", 4), ("HUBS", 2), ("BLOCK", 40)):
        monkeypatch.setattr(near_dedup, name, v, raising=False)
    rng = np.random.RandomState(9)
    bases = [rng.randint(1, 2**62, size=200, dtype=np.int64).astype(np.uint64) for _ in range(150)]
    sets = [np.sort(x) for base in bases for x in (base, np.r_[base[:190], base[:10] + np.uint64(1)])]
    sig = minwise_of(sets[0])[0]
    reps = spark.createDataFrame([(i, len(s), bytearray(sig), bytearray(minwise_of(s)[1])) for i, s in enumerate(sets)], "rep long, n long, sig binary, sk binary")
    scratch = common.Scratch(spark)
    found = common.components(scratch, near_dedup._candidates(scratch, reps)).collect()
    assert {r.id: r.component for r in found} == {i: i // 2 * 2 for i in range(300)}


def minwise_of(s):
    return tuple(x.tobytes() for x in near_dedup.minwise(s))


def test_sketches_pass_what_is_near():
    rng = np.random.RandomState(4)
    for n in (10, 40, 200, 1000):
        wrong = 0
        for _ in range(200):
            both = rng.randint(1, 2**62, size=int(np.ceil(n * 0.89)) , dtype=np.int64).astype(np.uint64)
            x, y = (np.unique(np.r_[both, rng.randint(1, 2**62, size=n - len(both), dtype=np.int64).astype(np.uint64)]) for _ in range(2))
            same = len(np.intersect1d(x, y))
            if 100 * same >= 80 * (len(x) + len(y) - same):
                (_, a), (_, b) = near_dedup.minwise(x), near_dedup.minwise(y)
                wrong += near_dedup.unequal(a.view(np.uint64), b.view(np.uint64)) > near_dedup.most_unequal(np.array(n))
        assert wrong == 0


def test_components_by_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long")
    stars = {r.id: r.component for r in common.components(common.Scratch(spark), df).collect()}
    monkeypatch.setattr(common, "LOCAL_EDGES", 10**6)
    local = {r.id: r.component for r in common.components(common.Scratch(spark), df).collect()}
    assert stars == local and all(stars[k] == 1000 for k in range(1000, 1041))


def test_word_hashes_follow_words():
    texts = ["Ab  cd\tAB", "", None, "ab", "x" * 5000 + " ab"]
    data, off = tx.string_buffers(pa.array(texts))
    h, first = tx.words(data, off)
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2]
    assert h[0] == h[2] == h[3] == h[5] and h[1] != h[0]
    sliced = pa.array(["zz", *texts]).slice(1)
    h2, first2 = tx.words(*tx.string_buffers(sliced))
    assert (h == h2).all() and (first == first2).all()
