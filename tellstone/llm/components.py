"""Problem 5: one group for all records linked directly or over others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.session import Scratch
from tellstone.sources.tables import read_table

LEAST_CONFIDENCE = 0.65


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """For each node u with neighbours v: the smallest of them and itself, where that is not itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).where("m < u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour.

    Edges are kept as (u, v) with v < u. A node that is itself the smallest keeps its
    edges as they are, so the rows of a hub never need to meet in one task: they take the
    left join unmatched, and the minimum is found by a partial aggregate.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smaller = both.where("v > u").join(_smallest_neighbour(both), "u", "left")
    return smaller.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    joined = edges.join(_smallest_neighbour(edges), "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``id``, ``group``: every record with a link, and the smallest id of its group.

    Alternates large-star and small-star rewrites, each written to the shared folder,
    until neither changes the edges. Links to itself and links with a null end are none;
    repeated links and links in both directions are one. Without links the result
    is empty. Ids compare in binary order for strings.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.write(now)
    mark = edge_mark(now)
    while True:
        after = scratch.write(_small_star(_large_star(now)))
        scratch.drop(now)
        now, before, mark = after, mark, edge_mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def edge_mark(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, and two 64-bit hashes of all of them, each put together by exclusive or.

    Edges are different from each other, so none cancels another out, and nothing is added up
    that could overflow, however many there are.
    """
    rows = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "v", "u")))
    return tuple(x or 0 for x in rows.first())


def usable_links(matches: DataFrame, confidence: Column, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rows that are links: both ids present and different, confidence a number of at least ``least``."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return matches.where(there("tablet_a") & there("tablet_b") & (F.col("tablet_a") != F.col("tablet_b")) & confidence.isNotNull() & ~F.isnan(confidence) & (confidence >= least))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    matches = read_table(spark, folder, "join_match", "tablet_a", "tablet_b", "join_confidence")
    links = usable_links(matches, F.col("join_confidence"))
    return connected_components(links, "tablet_a", "tablet_b").select(F.col("id").alias("tablet_id"), F.col("group").alias("group_id"))


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
with recursive l as (
  select tablet_a as a, tablet_b as b from join_match
  where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and join_confidence >= 0.65 and not isnan(join_confidence)),
e as (select a, b from l union select b, a from l),
r(id, other) as (select a, a from e union select r.id, e.b from r join e on e.a = r.other)
select id as tablet_id, min(other) as group_id from r group by id
"""
}
