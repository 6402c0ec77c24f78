"""Language identification by Bayesian evidence fusion.

Evidence for language l of a row, as summands of a log posterior:

- text: log-likelihood of its byte trigrams under a smoothed model of l, as a mean per trigram times an effective count
  (trigrams are far from independent: ``TEXT_WEIGHT`` each, at most ``MOST_TRIGRAMS`` of them);
- declared language (markup or metadata): log P(declared | l), from how often rows whose text looks like l declare it;
- host prior: P(l | host), smoothed towards P(l | address suffix), smoothed towards P(l), from grouped counts of what
  the texts of all rows look like, each row without itself.

A row is rejected if it has no trigram, if no language has posterior ``LEAST_POSTERIOR``, if its language is not wanted,
or if a text of 200 trigrams or more is far less likely under its best language than any usual text, both of all languages
and of that one (``FAR`` deviations: not a language of the model at all).

Training: every language that at least ``LEAST_ROWS`` rows of the corpus declare is part of the model, however small its share.
Trigram counts come from at most ``SAMPLE`` texts of each language, those with the smallest hashes (equal texts count once a
language). Only rows are left out: chosen texts train whole, as they are scored, and executors count them. Priors and confusion
counts come from all rows. What reaches the driver is by language: trigram counts, (L+1) x L confusion counts, L totals and a
number for each chosen text.

Scale: the text pass shuffles nothing and leaves a narrow table; counts are grouped with partial aggregation; that
narrow table is joined with the host table, whose skew adaptive execution can split. Texts are never shuffled unless the
rejected rows are too many for a broadcast, in ``keep``.

Defined cases: null or empty texts (or fewer than three bytes) are rejected, their language is what the other evidence says;
null hosts and suffixes share the global prior; unknown declared languages are one class of their own, null ones no
evidence; ties go to the language first in alphabetical order; repeated rows each get a row; without any training rows
all languages are null and every row is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .common import Scratch, fraction
from .url_filter import host_and_path

BUCKETS, SAMPLE, LEAST_ROWS, MOST_BROADCAST = 1 << 15, 1000, 5, 1_000_000
TEXT_WEIGHT, MOST_TRIGRAMS, HOST_STRENGTH, SUFFIX_STRENGTH, ALPHA = 0.25, 400, 5.0, 20.0, 0.5
LEAST_POSTERIOR, FAR = 0.6, 40.0


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram inside a row (A-Z as a-z, any other ASCII non-letter as a space, no run of spaces), and its row."""
    raw = tx.LOWER[data[off[0] : off[-1]]]
    raw = np.where(tx.ALNUM[raw] & ((raw < 48) | (raw > 57)), raw, np.uint8(32))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (row[1:] != row[:-1])
    raw, row = raw[keep].astype(np.uint32), row[keep]
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    ok = row[:-2] == row[2:]
    return ((code[ok] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), row[:-2][ok]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, L) log-probabilities
    least: np.ndarray  # (L,) mean log-likelihood below which a text is far from all usual ones

    def likelihoods(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, mean log-likelihoods) of each row."""
        data, off = tx.string_buffers(col)
        n, ll = np.zeros(len(off) - 1, np.int64), np.zeros((len(off) - 1, len(self.languages)))
        for a, b in tx.chunks(off):
            code, row = _trigrams(data, off[a : b + 1])
            if len(code):
                first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1]
                n[a + row[first]] = np.diff(np.r_[first, len(code)])
                ll[a + row[first]] = np.add.reduceat(self.table[code], first, axis=0, dtype=np.float64)
        return n, ll / np.maximum(n, 1)[:, None]


def _count(languages: list[str]):
    at = {v: i for i, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.string_buffers(b.column("text"))
            of = np.array([at[v] for v in b.column("declared").to_pylist()], np.int64)
            for i, j in tx.chunks(off):
                code, row = _trigrams(data, off[i : j + 1])
                cell, n = np.unique(of[i:j][row] * BUCKETS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return run


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ll = shared.value.likelihoods(b.column("text"))
            long = n >= 200
            yield pa.RecordBatch.from_arrays([b.column("declared").filter(pa.array(long)), pa.array(ll[long].max(axis=1))], ["declared", "best"])

    return run


def _limit(best: np.ndarray, least: int) -> float:
    middle, deviation = 0.0, 1.0
    if len(best) >= least:
        middle = float(np.median(best))
        deviation = float(max(0.05, 1.4826 * np.median(np.abs(best - middle))))
    return middle - FAR * deviation


def learn(rows: DataFrame) -> Model | None:
    """A model from rows (id, h, text, declared); h: hash of the text."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    known = rows.where("declared is not null and length(text) >= 3 and id is not null")
    narrow = scratch.write(known.groupBy("declared", "h").agg(F.min("id").alias("id"), F.count("*").alias("c")), "narrow")  # equal texts once a language
    said = scratch.write(narrow.groupBy("declared").agg(F.sum("c").alias("rows"), F.count("*").alias("texts")).where(F.col("rows") >= LEAST_ROWS), "declared")
    languages = sorted(r["declared"] for r in said.collect())
    if not languages:
        return None
    few = narrow.join(F.broadcast(said), "declared").where(fraction(F.col("h")) < (2.0 * SAMPLE + 100.0) / F.col("texts"))  # the rest can't be chosen
    first = F.row_number().over(W.partitionBy("declared").orderBy(F.shiftrightunsigned("h", 11), "h"))
    chosen = scratch.write(few.withColumn("k", first).where(F.col("k") <= SAMPLE).select("id", "h", "declared"), "chosen")
    n = chosen.count()
    texts = known.join(F.broadcast(chosen) if n <= MOST_BROADCAST else chosen, ["id", "h", "declared"]).select("h", "declared", "text")  # whole; at most the sample's rows
    sample = scratch.write(texts, "sample")
    if sample.count() > n:  # repeated rows
        sample = scratch.write(sample.dropDuplicates(["declared", "h"]), "sample")
    found = sample.mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(len(languages) * BUCKETS, 0.05)
    counts[found.column("cell").to_numpy()] += found.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS).T
    model = Model(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=0)), np.float32), np.zeros(0))
    usual = sample.mapInArrow(_best(spark.sparkContext.broadcast(model)), "declared string, best double").toArrow()
    own, best = np.array(usual.column("declared").to_pylist(), object), usual.column("best").to_numpy()
    model.least = np.array([min(_limit(best, 20), _limit(best[own == v], LEAST_ROWS)) if (own == v).sum() >= LEAST_ROWS else _limit(best, 20) for v in languages])
    return model


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n, ll = model.likelihoods(b.column("text"))
            flat = pa.array(ll.reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * ll.shape[1], pa.int32()), flat)
            label = np.where(n > 0, ll.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "h", "declared", "host", "suffix")], pa.array(n), lists, pa.array(label, pa.int32())], ["id", "h", "declared", "host", "suffix", "n", "ll", "label"])

    return run


def primary_tag(tag: Column) -> Column:
    """``en-GB`` and ``EN`` are ``en``; what is no tag is null."""
    found = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:$|[-_])", 1)
    return F.when(found != "", found)


def identify(rows: DataFrame, model: Model | None = None, wanted: list[str] | None = None) -> DataFrame:
    """(id, h, lang, posterior, text_lang, accepted) for rows (id, text, declared, host, suffix); h: hash of the text."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text", primary_tag(F.col("declared")).alias("declared"), F.col("host").cast("string").alias("host"), F.col("suffix").cast("string").alias("suffix"))
    model = model or learn(rows)
    if model is None:
        return rows.select("id", "h", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    names, k = model.languages, len(model.languages)
    scratch = Scratch(spark)
    narrow = rows.mapInArrow(_measure(spark.sparkContext.broadcast(model)), "id long, h long, declared string, host string, suffix string, n long, ll array<double>, label int")
    narrow = scratch.write(narrow, "narrow")

    declared = F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("?")).alias("declared")
    seen = {(r["declared"], r["label"]): r["c"] for r in narrow.where("label >= 0").groupBy(declared, "label").agg(F.count("*").alias("c")).collect()}
    totals = [sum(c for (_, own), c in seen.items() if own == i) for i in range(k)]
    classes = [*names, "?"]
    said = {d: [np.log((seen.get((d, i), 0) + ALPHA) / (sum(seen.get((c, i), 0) for c in classes) + ALPHA * len(classes))) for i in range(k)] for d in classes}

    tally = narrow.where("label >= 0").groupBy("host", "suffix", "label").agg(F.count("*").alias("c"))
    counted = lambda key: tally.where(F.col(key).isNotNull()).groupBy(key, "label").agg(F.sum("c").alias("c")).groupBy(key).agg(F.collect_list(F.struct("label", "c")).alias(f"{key}s"))
    by_host, by_suffix = scratch.write(counted("host"), "hosts"), scratch.write(counted("suffix").withColumnRenamed("suffixs", "suffixes"), "suffixes")
    full = narrow.join(by_host, "host", "left").join(by_suffix, "suffix", "left").select("id", "h", "declared", "n", "ll", "label", "hosts", "suffixes")
    fused = _fuse(model, np.array([said[c] for c in classes]), np.array(totals, float), wanted or names)
    return full.mapInArrow(fused, "id long, h long, lang string, posterior double, text_lang string, accepted boolean")


def _counts(col: pa.Array, label: np.ndarray, k: int) -> np.ndarray:
    """Counts by language without the row's own, from lists of (label, count); nulls are zeros."""
    out = np.zeros((len(col), k))
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        lists = col.drop_null()
        at, c = lists.flatten().flatten()
        out[np.repeat(there, lists.value_lengths().to_numpy()), at.to_numpy()] = c.to_numpy()
        own = there[label[there] >= 0]
        out[own, label[own]] -= 1
    return out


def _fuse(model: Model, said: np.ndarray, totals: np.ndarray, wanted: list[str]):
    names, k = model.languages, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overall = (totals + 1) / (totals.sum() + k)
        for b in batches:
            if not b.num_rows:
                continue
            n, label = b.column("n").to_numpy(), b.column("label").to_numpy()
            ll = b.column("ll").flatten().to_numpy().reshape(-1, k)
            suffix, host = _counts(b.column("suffixes"), label, k), _counts(b.column("hosts"), label, k)
            p = (suffix + SUFFIX_STRENGTH * overall) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_STRENGTH)
            p = (host + HOST_STRENGTH * p) / (host.sum(axis=1, keepdims=True) + HOST_STRENGTH)
            log = np.log(p) + TEXT_WEIGHT * np.minimum(n, MOST_TRIGRAMS)[:, None] * ll
            for i, d in enumerate(b.column("declared").to_pylist()):
                if d is not None:
                    log[i] += said[names.index(d) if d in names else k]
            best = log.argmax(axis=1)
            posterior = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            far = (n >= 200) & (ll.max(axis=1) < model.least[ll.argmax(axis=1)])
            ok = (n > 0) & (posterior >= LEAST_POSTERIOR) & ~far & np.isin(np.array(names)[best], wanted)
            of = lambda at: pa.array([names[i] if i >= 0 else None for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), of(best), pa.array(posterior), of(label), pa.array(ok)], ["id", "h", "lang", "posterior", "text_lang", "accepted"])

    return run


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows for ``identify``: the metadata's language is the declared one, the source the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages: the language that the markup declares, the URL's host and its last label, and the page's main text."""
    from .html_extract import extract  # only needed here

    html = F.col("html")
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)
    rows = pages.select("page_id", F.to_json(F.struct(tag.alias("d"), host_and_path(F.col("url"))[0].alias("h"))).alias("url"), "html")
    said = T.StructType([T.StructField("d", T.StringType()), T.StructField("h", T.StringType())])
    out = extract(rows).withColumn("x", F.from_json("url", said))
    host = F.when(F.col("x.h") != "", F.col("x.h"))
    return out.select(F.col("page_id").alias("id"), "text", F.col("x.d").alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.:]+)(?::\d+)?$", 1).alias("suffix"))


def keep(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that are accepted."""
    out = Scratch(docs.sparkSession).write(identify(of_documents(docs), wanted=wanted).where(~F.col("accepted")).select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct(), "rejected")
    return docs.join(out, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
