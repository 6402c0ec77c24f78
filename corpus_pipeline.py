"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmine.llm import decontaminate as decontamination
from cairnmine.llm import language_id as languages
from cairnmine.llm import near_dedup as duplicates
from cairnmine.llm import packing, toxicity
from cairnmine.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the corpus; ``lang`` stays as declared."""
    return languages.keep(docs).select(*COLUMNS)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below the threshold; labels are of the documents that got here."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (5-word shingles, similarity 0.8) the document with the least id.

    Rows that repeat an id and text are one document: one of them stays.
    """
    found = duplicates.near_duplicates(docs, shingle=5)
    drop = Scratch(spark).write(found.where("not kept and component_id is not null").select(F.col("doc_id").alias("_id")).distinct(), "drop")
    left = docs.join(drop, F.col("doc_id") == F.col("_id"), "left_anti")
    return left.dropDuplicates(["doc_id", "text"]).select(*COLUMNS) if has_repeats(docs) else left.select(*COLUMNS)


def has_repeats(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into bins of 8192 bytes."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", filter_toxic), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Trained scores are not expressible in SQL; tests hold each stage against a brute-force version or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
