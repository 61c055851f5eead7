"""Checks of a data folder, each a row with its status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["pass", "warn", "fail"]


@dataclass(frozen=True)
class Check:
    """A named measure of some rows: an aggregate, and the limits from which it is a warning or a failure.

    ``at_least`` reverses the limits: the measure should be large.
    """

    name: str
    rows: DataFrame
    measure: Column
    warn: float
    fail: float
    at_least: bool = False


def run_checks(checks: list[Check]) -> DataFrame:
    """check, value, status; a measure over no rows counts as 0."""
    out = None
    for c in checks:
        value = F.coalesce(c.measure.cast("double"), F.lit(0.0))
        part = c.rows.agg(value.alias("value")).select(F.lit(c.name).alias("check"), F.round("value", 4).alias("value"))
        v = F.col("value")
        bad = (lambda limit: v < limit) if c.at_least else (lambda limit: v > limit)  # noqa: B023, E731
        part = part.withColumn("status", F.when(bad(c.fail), "fail").when(bad(c.warn), "warn").otherwise("pass"))
        out = part if out is None else out.unionByName(part)
    return out


def overall(checks: DataFrame) -> DataFrame:
    """The worst status, and how many checks have each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    worst = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.max(rank).cast("int"))
    return checks.agg(worst.alias("status"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES])


def missing_columns(found: DataFrame, expected: list[str]) -> list[str]:
    """Expected columns that a table lacks, in order."""
    return [c for c in expected if c not in found.columns]
