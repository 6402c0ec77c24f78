"""The queries opN_<name> and ``pipeline``, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, html_extract, language_id, near_dedup, packing, sharding, sql, topk_search, toxicity, url_filter, warc
from .common import table

#: The rules of the URL query, and hosts whose pages its list blocks.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LISTED = [("casino-win.example.org", ""), ("spam-farm.example.org", "")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents on 2-word shingles at Jaccard similarity 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by boundary chains."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item of whose 5-word shingles a document contains 0.8 or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; its metadata's language and its source are declared language and host."""
    found = language_id.identify(language_id.of_documents(table(spark, sf_dir, "documents")))
    return found.select(found["id"].alias("doc_id"), "lang", "posterior", "text_lang", "accepted")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages, with the markup's language, the address suffix and the host."""
    found = language_id.identify(language_id.of_pages(table(spark, sf_dir, "pages")))
    return found.select(found["id"].alias("page_id"), "lang", "posterior", "text_lang", "accepted")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into bins of 8192 bytes, one piece of a source and of a copy class in each."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every vector whose id is divisible by 100."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(LISTED, "host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


_OPS = [op1_near_dedup, op2_warc, op3_toxicity, op4_decontaminate, op5_language_id, op6_pack, op7_shard, op8_html_extract, op9_topk, op10_url_filter, page_language]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*_OPS, pipeline]}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
