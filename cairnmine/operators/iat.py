"""Inter-arrival times: differences, counts, pair statistics, suspicious users. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.encode import epoch_seconds, log2_bin
from .stats import beyond, iqr_bound, three_sigma_bound


def differences(events: DataFrame, user: str, time: str) -> DataFrame:
    """(user, k, iat): whole seconds between a user's consecutive events; users with one event have none."""
    w = W.partitionBy("user").orderBy("s")
    rows = events.select(F.col(user).alias("user"), epoch_seconds(F.col(time)).alias("s"))
    rows = rows.withColumn("iat", F.col("s") - F.lag("s").over(w)).withColumn("k", (F.row_number().over(w) - 1).cast("long"))
    return rows.where("iat is not null").select("user", "k", "iat")


def lists(diffs: DataFrame) -> DataFrame:
    """(user, iat array) in order."""
    return diffs.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "iat"))), lambda x: x["iat"]).alias("iat"))


def counts(diffs: DataFrame) -> DataFrame:
    """(iat, n, p): how often each value occurs, and its share."""
    n = diffs.groupBy("iat").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(diffs.agg(F.count("*").alias("_t")))).select("iat", "n", (F.col("n") / F.col("_t")).alias("p"))  # one row


def density_curve(diffs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(iat, n, p) of the users (user), or of all: the points of a curve."""
    return counts(diffs if users is None else diffs.join(users.select("user").distinct(), "user", "left_semi"))


def pairs(diffs: DataFrame, bin_: bool = False) -> DataFrame:
    """(user, k, iat1, iat2): consecutive differences, optionally in binary-logarithm bins."""
    w = W.partitionBy("user").orderBy("k")
    rows = diffs.withColumn("iat2", F.lead("iat").over(w)).where("iat2 is not null")
    f = log2_bin if bin_ else (lambda c: c)
    return rows.select("user", "k", f(F.col("iat")).alias("iat1"), f(F.col("iat2")).alias("iat2"))


def pair_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("iat1", "iat2").agg(F.count("*").alias("n"))


def users_of_pairs(p: DataFrame) -> DataFrame:
    """(iat1, iat2, users array): users in order of id, once for each occurrence."""
    return p.groupBy("iat1", "iat2").agg(F.sort_array(F.collect_list("user")).alias("users"))


def pairs_of_users(p: DataFrame) -> DataFrame:
    return p.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "iat1", "iat2"))), lambda x: F.struct(x["iat1"].alias("iat1"), x["iat2"].alias("iat2"))).alias("pairs"))


def having_pairs(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct users with any of the wanted pairs (iat1, iat2)."""
    return p.join(wanted.select("iat1", "iat2").distinct(), ["iat1", "iat2"], "left_semi").select("user").distinct()


def user_frequency(p: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user, n): occurrences of wanted pairs; unknown pairs count for nobody."""
    return p.join(wanted.select("iat1", "iat2").distinct(), ["iat1", "iat2"], "left_semi").groupBy("user").agg(F.count("*").alias("n"))


def suspicious(freq: DataFrame, kind: str = "iqr") -> DataFrame:
    """Users whose frequency is above the IQR or the three-sigma bound."""
    return beyond(freq, "n", iqr_bound(freq, "n") if kind == "iqr" else three_sigma_bound(freq, "n"))


def top_users(freq: DataFrame, k: int = -1) -> DataFrame:
    """Most frequent users first; k = -1: all."""
    out = freq.orderBy(F.desc("n"), "user")
    return out if k < 0 else out.limit(k)


def peak_cell(p: DataFrame) -> DataFrame:
    """(iat1, iat2, n): the most frequent pair, ties to the smaller."""
    best = pair_counts(p).agg(F.max_by(F.struct("iat1", "iat2", "n"), F.struct("n", -F.col("iat1"), -F.col("iat2"))).alias("x"))
    return best.where("x is not null").select("x.*")


