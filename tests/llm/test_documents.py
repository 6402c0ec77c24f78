"""Sharding, packing, top-k search, decontamination, toxicity, language ID, pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnmine.llm import decontaminate, language_id, packing, queries, sharding, topk_search, toxicity
from cairnmine.llm.common import table


def n_bytes(t):
    return len((t or "").encode())


def test_shards(spark, nasty, nothing):
    rows = sharding.assign(nasty, 4).collect()
    texts = defaultdict(list)
    for r in nasty.collect():
        texts[r.doc_id].append(r.text)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        assert (r.size, r.text_crc32) in [(n_bytes(t) + 8, zlib.crc32((t or "").encode())) for t in texts[r.doc_id]] and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert ids == sorted(ids)
    assert sharding.assign(nothing, 4).count() == 0


def test_shards_are_balanced(spark, sf):
    rows = sharding.assign(table(spark, sf, "documents"), 24).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert set(size) == set(range(24)) and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows)


def test_write_shards(spark, nasty, tmp_path):
    sharding.write_shards(nasty, str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == nasty.count()


def test_every_piece_goes_to_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(20):
        n = 300
        size = sorted((rng.choice([rng.randint(0, 100), 30, 50]) for _ in range(n)), reverse=True)
        src, clu = [rng.choice([-1, 0, 0, 0, rng.randint(1, 90)]) for _ in range(n)], [rng.choice([-1, -1, rng.randint(0, 70)]) for _ in range(n)]
        left, marks = [], []
        for k, s, a, c in zip(packing.pack_group(np.array(size), np.array(src), np.array(clu), 100).tolist(), size, src, clu):
            fits = [x for x, (ms, mc) in zip(left, marks) if x >= s and not (a >= 0 and a in ms) and not (c >= 0 and c in mc)]
            if k == len(left):
                assert not fits
                left.append(100)
                marks.append((set(), set()))
            else:
                assert left[k] == min(fits) and a not in marks[k][0] - {-1} and c not in marks[k][1] - {-1}
            left[k] -= s
            marks[k][0].add(a)
            marks[k][1].add(c)


def check_packed(rows, docs, capacity):
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r.bin].append(r)
    source, text = {d.doc_id: d.source for d in docs}, {d.doc_id: d.text for d in docs}
    for own in by_bin.values():
        assert sum(r.size for r in own) <= capacity
        s = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        t = [text[r.doc_id] for r in own if text[r.doc_id]]
        assert len(s) == len(set(s)) and len(t) == len(set(t))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.size))
    times = Counter(d.doc_id for d in docs)
    for d in docs:
        assert sum(n for _, n in pieces[d.doc_id]) == n_bytes(d.text) * times[d.doc_id]


def test_pack_nasty(spark, nasty, nothing):
    check_packed(packing.pack(nasty, capacity=1000).collect(), nasty.collect(), 1000)
    assert packing.pack(nothing).count() == 0


def test_pack_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs = table(spark, sf, "documents")
    check_packed(packing.pack(docs).collect(), docs.collect(), packing.CAPACITY)


def plain_top(rows, every, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def test_top_k(spark):
    rng = np.random.RandomState(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, None), (500, [1.0, None]), (600, [float("nan")] * 12), (700, [float("inf")] * 12), (800, []), (900, []), (901, []), (1000, [2.0, 3.0]), (1001, rows[5][1]), (1002, rows[5][1]), (1100, [1e15] * 12 + []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(4)
    narrow = df.where("vec_id <> 1100 or vec_id is null")
    for block in (10_000, 2):
        got = {tuple(r) for r in topk_search.top_k(narrow, k=7, every=100, block=block).collect()}
        assert got == plain_top([r for r in rows if r[0] != 1100], 100, 7)
    assert topk_search.top_k(df.where("false")).count() == 0


def test_top_k_prunes_with_bounds():
    """Segment bounds never lie below the score."""
    rng = np.random.RandomState(1)
    q, x = np.floor(rng.normal(size=(30, 64)) * 1024), np.floor(rng.normal(size=(200, 64)) * 1024)
    for s in (1, 4, 16, 64):
        assert (topk_search._stats(q, s) @ topk_search._stats(x, s).T >= q @ x.T - 1e-3).all()


def clustered(n, dims=64, clusters=20, spread=0.05, seed=3):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[np.arange(n) % clusters] + spread * rng.normal(size=(n, dims))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def test_top_k_computes_few_pairs_of_clustered_vectors(spark):
    rows = clustered(6000)
    df, computed = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2), spark.sparkContext.accumulator(0)
    got = {tuple(r) for r in topk_search.top_k(df, k=5, every=25, computed=computed).collect()}
    share = computed.value / (6000 * 240)
    print(f"pairs computed: {share:.3f}")
    assert got == plain_top(rows, 25, 5) and 0 < share < 0.25


def plain_contained(docs, items):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        if not k:
            continue
        s = runs(w, k)
        for d, x in docs:
            n = len(s & runs(words(x), k))
            if 100 * n >= 80 * len(s):
                out.add((d, i, len(s), n))
    return out


def test_contained_items(spark, nasty, nothing, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(30)] + [(50, None), (51, ""), (52, "...")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 300))]
        if d % 2:
            t = items[rng.randrange(30)][1].split()
            t = t[: max(1, int(len(t) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in t]
        docs.append((d, " ".join(w)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_contained(docs, items)
    for block in (4_000_000, 150):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert {tuple(r)[:4] for r in decontaminate.contained_items(df, b).collect()} == want
        kept = {r.doc_id for r in decontaminate.decontaminate(df, b).collect()}
        assert kept == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontaminate.contained_items(nasty, b.where("false")).count() == 0
    assert decontaminate.decontaminate(nasty, b.where("false")).count() == nasty.count()
    assert decontaminate.decontaminate(nothing, b).count() == 0


def labelled(spark, n=900, seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["xylotrap", "zwumbat", "qorrible", "vexogant"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) * y):
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, y))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, flipped)).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # held-out labels change nothing


def test_toxicity_nasty(spark, nasty, nothing):
    docs, labels = labelled(spark, 200)
    model = toxicity.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)))
    rows = toxicity.score(nasty, model).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(nasty, model).columns == nasty.columns
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(nasty, None).collect()} == {0.0}


def test_toxicity_trains_on_whole_texts(spark):
    """The toxic words come after 20,000 characters; a prefix of the texts has none of them."""
    rng = random.Random(5)
    usual, bad = [f"word{i}" for i in range(400)], [f"slur{i}x" for i in range(12)]
    texts = []
    for i in range(240):
        words = rng.choices(usual, k=3500)
        texts.append((i, " ".join(words + (rng.choices(bad, k=60) if i % 2 else rng.choices(usual, k=60)))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.learn(docs.unionByName(docs.where("doc_id < 9")), labels)  # a repeated row trains once
    assert b"slur3x" in model.toxic and b"slur3x" not in model.ordinary and model.toxic == toxicity.learn(docs, labels).toxic
    rows = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(rows) > 40 and all(r.predicted == r.doc_id % 2 for r in rows)


def test_toxicity_windows_cover_the_text():
    text = b" ".join(b"w%d" % i for i in range(500))
    got = list(toxicity.windows(text))
    half = next(k for k, w in enumerate(got) if k and w[:1] != b" " and not text.startswith(w))
    assert b"".join(w if k == 0 else w[1:] for k, w in enumerate(got[:half])) == text


def test_language_of_documents(spark, sf, nasty, nothing):
    docs = table(spark, sf, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(language_id.of_documents(docs)).collect()
    assert np.mean([r.lang == truth[r.id] for r in rows]) > 0.98 and np.mean([r.accepted for r in rows]) > 0.98
    assert np.mean([r.text_lang == truth[r.id] for r in rows]) > 0.95
    known = language_id.learn(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text", F.col("lang").alias("declared")))
    odd = {r.id: r for r in language_id.identify(language_id.of_documents(nasty), known).collect()}
    assert len(odd) == len({r.doc_id for r in nasty.collect()}) and not odd[4].accepted and not odd[5].accepted
    assert language_id.identify(language_id.of_documents(nothing)).count() == 0
    kept = language_id.keep(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_languages_of_small_share(spark):
    """66 languages with 6 rows of 1,396 each are all part of the model, next to one that has 1,000 rows."""
    rng = random.Random(9)
    names = ["en", *(f"x{a}{b}" for a in "abcdef" for b in "abcdefghijk")]
    words = {l: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40)] for l in names}
    own = [l for l in names for _ in range(1000 if l == "en" else 6)]
    rows = [(i, " ".join(rng.choices(words[l], k=120)), l, f"h{i % 7}", None) for i, l in enumerate(own)]
    rows += [(-1 - i, " ".join(rng.choices(words[l], k=120)), None, None, None) for i, l in enumerate(names)]  # not trained
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang == l and got[i].accepted for i, l in [*enumerate(own), *((-1 - i, l) for i, l in enumerate(names))])


def test_language_trains_on_whole_texts(spark):
    """What tells the languages apart comes after 20,000 characters of the same words."""
    same, words = "lorem ipsum dolor " * 1200, {"en": "the and of with that this from", "de": "der und die mit das den von"}
    rows = [(i, same + " ".join(random.Random(i).choices(words[l].split(), k=900)), l, None, None) for i, l in enumerate(["en", "de"] * 10)]
    rows += [(100 + i, " ".join(random.Random(i).choices(words[l].split(), k=90)), None, None, None) for i, l in enumerate(["en", "de"])]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r.text_lang for r in language_id.identify(df).collect()}
    assert (got[100], got[101]) == ("en", "de")


def test_evidence_decides_where_text_is_silent(spark):
    """A short text is settled by declared language, then by its host, then by its suffix."""
    words = {"en": "the and of with that this from", "de": "der und die mit das den von"}
    rows = [(i, " ".join(random.Random(i).choices(words[l].split(), k=60)), l, f"h{l}", l) for i, l in enumerate(["en", "de"] * 60)]
    rows += [(1000, "xyz", "de", None, None), (1001, "xyz", None, "hde", None), (1002, "xyz", None, None, "de"), (1003, "xyz", None, "hen", "de")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r.lang for r in language_id.identify(df).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1003)] == ["de", "de", "de", "en"]


def plain_language(model, rows):
    """(lang, posterior) of rows (text, declared, host, suffix), one by one."""
    names, k = model.languages, len(model.languages)
    found = []
    for t, *_ in rows:
        b = [x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()]
        b = [x if x >= 128 or 97 <= x <= 122 else 32 for x in b]
        b = [x for i, x in enumerate(b) if not i or x != 32 or b[i - 1] != 32]
        codes = [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2**32) >> 17 for i in range(len(b) - 2)]
        ll = [sum(float(model.table[c, j]) for c in codes) / max(1, len(codes)) for j in range(k)]
        found.append((len(codes), ll, int(np.argmax(ll)) if codes else -1))
    label = [f[2] for f in found]
    say = [d if d in names else None if d is None else "?" for _, d, *_ in rows]
    out = []
    for i, (_, _, host, suffix) in enumerate(rows):
        total = [label.count(j) for j in range(k)]
        p = [(t + 1) / (sum(total) + k) for t in total]
        for at, strength in ((3, language_id.SUFFIX_STRENGTH), (2, language_id.HOST_STRENGTH)):
            same = [label[o] for o in range(len(rows)) if o != i and rows[i][at] is not None and rows[o][at] == rows[i][at] and label[o] >= 0]
            p = [(same.count(j) + strength * p[j]) / (len(same) + strength) for j in range(k)]
        n, ll, _ = found[i]
        log = [np.log(p[j]) + language_id.TEXT_WEIGHT * min(n, language_id.MOST_TRIGRAMS) * ll[j] for j in range(k)]
        if say[i] is not None:
            for j in range(k):
                own = sum(s == say[i] and x == j for s, x in zip(say, label))
                log[j] += np.log((own + language_id.ALPHA) / (sum(s is not None and x == j for s, x in zip(say, label)) + language_id.ALPHA * (k + 1)))
        best = int(np.argmax(log))
        out.append((names[best], 1 / sum(np.exp(x - log[best]) for x in log)))
    return out


def test_language_posteriors_against_plain_python(spark):
    rng = random.Random(9)
    words = {"aa": ["abak", "odal", "mur", "tel"], "bb": ["fyrx", "qwol", "zzud", "hex"], "cc": ["nimi", "lolo", "pupe", "ryry"]}
    rows = []
    for i in range(120):
        own = rng.choice("abc") * 2
        text = " ".join(rng.choices(words[own], k=rng.choice([1, 2, 5, 30])))
        rows.append((None if i % 31 == 0 else text, rng.choice([own, own, own, "bb", "xx", None]), rng.choice(["h1", f"h{own}", None]), rng.choice(["s1", f"s{own}", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, host string, suffix string")
    hashed = df.withColumn("h", F.xxhash64("text"))
    model = language_id.learn(hashed)
    got = {r.id: (r.lang, r.posterior) for r in language_id.identify(df, model).collect()}
    want = plain_language(model, rows)
    assert len(got) == len(rows)
    for i, (lang, posterior) in enumerate(want):
        assert got[i][1] == pytest.approx(posterior, rel=1e-6) and (got[i][0] == lang or posterior < 0.5001)


def test_pipeline_near_dedup_and_decontaminate_against_brute_force(spark, sf):
    from test_near_dedup import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    group = brute(texts, 5)
    assert sorted(r.doc_id for r in stages["near_dedup"](spark, docs, sf).collect()) == sorted(i for i, _ in texts if group[i][1] == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in plain_contained(texts, items)}
    assert leaked and {r.doc_id for r in stages["decontaminate"](spark, docs, sf).collect()} == {i for i, _ in texts} - leaked


def test_pipeline_near_dedup_loses_no_pair_of_a_dense_node(spark, sf, monkeypatch):
    from test_near_dedup import near_templates

    for name, v in (("LEAF", 4), ("HUBS", 2), ("DEEPEST", 1)):
        monkeypatch.setattr(corpus_pipeline.duplicates, name, v)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in near_templates(300)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == list(range(0, 300, 2))


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontaminate", "pack"]
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.exceptAll(docs.select(*corpus_pipeline.COLUMNS)).count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0.5 * docs.count() and "bin" in out.columns


def test_pipeline_keeps_one_of_each_group(spark, nasty, sf):
    rows = corpus_pipeline.near_dedup(spark, nasty, sf).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(11) == 1 and 2 not in ids and 10 not in ids and {1, 4, 5, 6, 7, 9, 12, 13, 14} <= set(ids)


def test_queries_are_registered():
    names = queries.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == [n for n in sorted((n for n in names if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)", n)[1]))]
    assert sum(n.startswith("op") for n in names) == 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op7_shard", "op6_pack"])
def test_same_result_twice(spark, sf, name):
    f = queries.queries()[name]
    assert sorted(map(str, f(spark, sf).collect())) == sorted(map(str, f(spark, sf).collect()))
