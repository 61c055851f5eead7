"""Corrections by people: events are only ever appended, states are what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, APPLIED, REJECTED = "pending", "applied", "rejected"
#: State after each kind of event.
AFTER = {"submit": PENDING, "approve": APPLIED, "reject": REJECTED}
SCHEMA = "correction_id string, action string, sign_id string, context string, reading string, translation string, confidence double, at timestamp, seq long"


def events(df: DataFrame, *, correction_id: Column, action: Column, at: Column, seq: Column, **columns: Column) -> DataFrame:
    """Events of the fixed schema from any rows; columns not given are null."""
    given = {"correction_id": correction_id, "action": action, "at": at, "seq": seq} | columns
    parts = [p.strip().split(" ", 1) for p in SCHEMA.split(",")]
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts])


def states(log: DataFrame) -> DataFrame:
    """One row a correction: what was submitted last, and the state after its last event, by time and then number.

    Unknown actions change nothing. A correction that was approved or rejected without a submission has
    no content. The log is reduced by a partial aggregate, however many events a correction has.
    """
    known = log.where(F.col("action").isin(*AFTER))
    order = F.struct("at", "seq")
    content = [F.max_by(c, F.when(F.col("action") == "submit", order)).alias(c) for c in ("sign_id", "context", "reading", "translation", "confidence")]
    state = F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair])
    grouped = known.groupBy("correction_id").agg(*content, F.max_by("action", order).alias("last"), F.max("at").alias("at"), F.count(F.lit(1)).alias("n_events"))
    return grouped.withColumn("state", F.element_at(state, F.col("last"))).drop("last")


def stats(current: DataFrame) -> DataFrame:
    """total, pending, applied, rejected."""
    return current.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in (PENDING, APPLIED, REJECTED)])


def pending(current: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest corrections that wait."""
    return current.where(F.col("state") == PENDING).orderBy("at", "correction_id").limit(limit)
