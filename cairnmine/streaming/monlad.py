"""Zero-out counts of accounts: how often a balance that had risen by more than ``up`` falls back to about its minimum.

Each account is a small state machine over its debits and credits in order. In a batch, accounts are grouped and sorted; on
a stream the same step runs in ``applyInPandasWithState``. A transfer is a debit of its source and then a credit of its
destination (a self-transfer nets to nothing before either check). When a source completes a fall, that counts for the
transfer's destination too; those are emitted as rows and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import iqr_bound, pareto_tail
from ..tables import cut


@dataclass
class Account:
    balance: float = 0.0
    low: float = 0.0
    high: float = 0.0
    direction: int = 0  # 1 after a rise, -1 after a fall, 0 before either
    pending: int = 0
    count: int = 0
    count_in: int = 0

    def step(self, sign: int, amount: float, up: float, down: float, eps: float) -> int | None:
        """One move; the inflows that led up to it if it completes a fall, else None."""
        self.balance += sign * amount
        before, b = self.direction, self.balance
        if sign > 0 and b - self.low > up:
            self.direction = 1
            self.pending += 1
        elif sign < 0 and self.high - b > down and b <= self.low + eps:
            self.direction = -1
        self.low, self.high = min(self.low, b), max(self.high, b)
        if (before, self.direction) == (-1, 1):
            self.high = b
        if (before, self.direction) != (1, -1):
            return None
        self.low = b
        done, self.pending = self.pending, 0
        self.count += 1
        self.count_in += done
        return done


STATE = "balance double, low double, high double, direction int, pending long, count long, count_in long"
FALLS = "falls array<struct<other:long,n:long>>"
RESULT = f"acct long, balance double, count long, count_in long, {FALLS}"


def from_transfers(df: DataFrame) -> DataFrame:
    """(acct, seq, side, sign, amount, other) of transfers (seq, src, dst, amount), the debit first. One to oneself moves
    nothing, but both checks are made."""
    moved = F.when(F.col("src") == F.col("dst"), F.lit(0.0)).otherwise(F.col("amount").cast("double"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("acct"), F.lit(-1).alias("sign"), F.col("dst").alias("other")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("acct"), F.lit(1).alias("sign"), F.col("src").alias("other")))
    x = df.select("seq", moved.alias("amount"), F.explode(sides).alias("x"))
    return x.select(F.col("x.acct").cast("long").alias("acct"), F.col("seq").cast("long").alias("seq"), "x.side", "x.sign", "amount", F.col("x.other").cast("long").alias("other"))


def from_types(df: DataFrame, debit: str, credit: str, kind: str = "type") -> DataFrame:
    """The same for single-account rows (seq, acct, type, amount); other types are ignored, and there is no other account."""
    sign = F.when(F.col(kind) == debit, -1).when(F.col(kind) == credit, 1)
    return df.select(F.col("acct").cast("long").alias("acct"), F.col("seq").cast("long").alias("seq"), F.lit(0).alias("side"), sign.alias("sign"), F.col("amount").cast("double").alias("amount"), F.lit(None).cast("long").alias("other")).where("sign is not null")


def _run(a: Account, pdf: pd.DataFrame, acct: int, up: float, down: float, eps: float) -> pd.DataFrame:
    falls = []
    pdf = pdf.sort_values(["seq", "side"])
    for sign, amount, other in zip(pdf["sign"].tolist(), pdf["amount"].tolist(), pdf["other"].tolist()):
        n = a.step(sign, amount, up, down, eps)
        if n is not None and other is not None and other == other:
            falls.append({"other": int(other), "n": n})
    return pd.DataFrame({"acct": [acct], "balance": [a.balance], "count": [a.count], "count_in": [a.count_in], "falls": [falls]})


def counts(moves: DataFrame, up: float, down: float, eps: float) -> DataFrame:
    """(acct, balance, count, count_in, count_to, count_in_to) after all moves; the last two sum up the falls that transfers to
    this account completed. A task holds one account's moves (six numbers each)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(Account(), pdf, pdf["acct"].iloc[0], up, down, eps)

    return with_destinations(cut(moves.groupBy("acct").applyInPandas(run, RESULT)))


def with_destinations(found: DataFrame) -> DataFrame:
    to = found.select(F.explode("falls").alias("x")).groupBy(F.col("x.other").alias("acct")).agg(F.count("*").alias("count_to"), F.sum("x.n").alias("count_in_to"))
    return found.drop("falls").join(to, "acct", "left").select("acct", "balance", "count", "count_in", F.coalesce("count_to", F.lit(0)).alias("count_to"), F.coalesce("count_in_to", F.lit(0)).alias("count_in_to"))


def stream_counts(moves: DataFrame, up: float, down: float, eps: float) -> DataFrame:
    """The same on a stream in update mode: one row for each account that a micro-batch touches, with this batch's falls."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a = Account(*state.get) if state.exists else Account()
        out = _run(a, pd.concat(list(pdfs)), key[0], up, down, eps)
        state.update(astuple(a))
        yield out

    return moves.groupBy("acct").applyInPandasWithState(run, RESULT, STATE, "update", "NoTimeout")


def anomalies(found: DataFrame, top: float = 0.98, p: float = 0.99, k: float = 1.5) -> DataFrame:
    """(acct, count, extra, part) of accounts with falls: part 1 far tail of counts; 2 far tail of extra (inflows beyond one
    a fall) among accounts of its count; 3 and 4 beyond the IQR bound of counts and of extra."""
    x = found.where("count > 0").withColumn("extra", F.col("count_in") - F.col("count")).select("acct", "count", "extra")
    parts = [pareto_tail(x, "count", top, p).withColumn("part", F.lit(1))]
    q = x.where("extra > 0").groupBy("count").agg(F.percentile("extra", F.lit(top)).alias("q"), F.min("extra").alias("m"))
    parts.append(x.join(q, "count").where("extra >= q and extra > m").select("acct", "count", "extra", F.lit(2).alias("part")))
    for part, c in ((3, "count"), (4, "extra")):
        parts.append(x.join(F.broadcast(iqr_bound(x, c, k)), F.col(c) > F.col("bound")).select("acct", "count", "extra", F.lit(part).alias("part")))  # one row
    out = parts[0]
    for o in parts[1:]:
        out = out.unionByName(o)
    return out
