"""References to records that do not exist, or that arrived only afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellstone.session import Scratch

#: A key with at least this share of all references is joined by broadcast; there are at most 1 / share such keys.
HEAVY_SHARE = 0.001


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its key and when a row of it arrived."""

    name: str
    rows: DataFrame
    key: Column
    arrived: Column


@dataclass(frozen=True)
class Child:
    """A table that refers: id of the row, its reference, the time of it, and the parent's name."""

    name: str
    parent: str
    rows: DataFrame
    id: Column
    reference: Column
    referred: Column


def missing_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Rows whose reference leads to no parent row, or only to later ones.

    Result: ref_table, ref_id, parent, key, referred, reason (``orphan`` or ``late``),
    one row for each ref_table and ref_id, however often the row came.

    * Parents and children are tagged and united in long form, children reduced to one
      row a key before the shuffle; grouping by parent and key shows which keys
      have no parent row, or one that is later than their first reference.
    * Only children with such keys are read again. Keys that hold much of the rows
      are joined by broadcast (at most 1 / HEAVY_SHARE of them), the rest by shuffle.
    * A null or empty reference is none. A reference without a time is never late,
      a parent whose rows all lack a time is never late. Keys are compared as
      strings, as written. An empty parent table makes every reference an orphan;
      without references the result is empty.
    """
    spark = children[0].rows.sparkSession
    long = None
    for p in parents:
        part = p.rows.select(
            F.lit(p.name).alias("parent"), p.key.cast("string").alias("key"), F.lit(True).alias("is_parent"),
            p.arrived.alias("arrived"), F.lit(None).cast("timestamp").alias("referred"), F.lit(0).cast("long").alias("n"),
        ).where("key is not null")
        long = part if long is None else long.unionByName(part)
    tagged = None
    for c in children:
        part = c.rows.select(
            F.lit(c.name).alias("ref_table"), c.id.cast("string").alias("ref_id"), F.lit(c.parent).alias("parent"),
            c.reference.cast("string").alias("key"), c.referred.alias("referred"),
        ).where("key is not null and key <> ''")
        tagged = part if tagged is None else tagged.unionByName(part)
    long = long.unionByName(
        tagged.select("parent", "key", F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp").alias("arrived"), "referred", F.lit(1).cast("long").alias("n"))
    )
    keys = long.groupBy("parent", "key").agg(
        F.max("is_parent").alias("found"), F.min("arrived").alias("arrived"),
        F.max("referred").alias("last"), F.min("referred").alias("first"), F.sum("n").alias("n"),
    )
    scratch = Scratch(spark, "references")
    bad = scratch.write(keys.where("n > 0 and (not found or arrived > first)").select("parent", "key", "found", "arrived", "n"))
    total = sum(c.rows.count() for c in children)
    least = max(1, int(total * HEAVY_SHARE))
    heavy, rest = bad.where(F.col("n") >= least), bad.where(F.col("n") < least)
    hot = F.broadcast(heavy.select("parent", "key", "found", "arrived"))
    by_hot = tagged.join(hot, ["parent", "key"])
    by_rest = tagged.join(F.broadcast(heavy.select("parent", "key")), ["parent", "key"], "left_anti").join(rest.select("parent", "key", "found", "arrived"), ["parent", "key"])
    found = by_hot.unionByName(by_rest).where("not found or arrived > referred")
    return found.groupBy("ref_table", "ref_id").agg(
        F.min(F.struct("parent", "key", "referred", F.when(F.col("found"), "late").otherwise("orphan").alias("reason"))).alias("r")
    ).select("ref_table", "ref_id", "r.parent", "r.key", "r.referred", "r.reason")


def missing_by_period(found: DataFrame) -> DataFrame:
    """Number of such rows for each table, month of the reference and reason; the month is null where the time is."""
    return found.groupBy("ref_table", F.date_format("referred", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))
