"""Groups of records that links hold together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellstone.session import Scratch

#: Different links that one task groups in memory; more are first rewritten by joins.
IN_ONE_TASK = 1_000_000


def linked_groups(links: DataFrame, a: str, b: str, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """node, group_id: every record with a link, and the smallest id that links lead to from it.

    Up to ``in_one_task`` different links are grouped by one task. More of them are contracted until that many are
    left: every node moves to the neighbour of the smallest hash or stays, by another hash each round, which in the mean
    takes a fixed share of the nodes away, whatever the chains. The names that nodes got are then followed back.
    Null ends and links to itself are no links; without links there are no rows.
    """
    scratch = Scratch(links.sparkSession, "groups")
    there = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = scratch.write(there.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    moves = []
    while edges.count() > in_one_task:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        least = both.groupBy("u").agg(F.min(order("v")).alias("least"))
        moves.append(scratch.write(least.select(F.col("u").alias("node"), F.least(order("u"), "least")["x"].alias("to"))))
        named = [moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "uv"]
        after = edges.join(named[0], "u").join(named[1], "v").where("to_u <> to_v")
        left = scratch.write(after.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
        scratch.drop(edges)
        edges = left
    kind = dict(edges.dtypes)["u"]
    groups = edges.coalesce(1).mapInArrow(_grouped, f"node {kind}, group_id {kind}")
    for move in reversed(moves):  # a node that has no link any more is the name of its group
        known = groups.select(F.col("node").alias("to"), "group_id")
        groups = scratch.write(move.join(known, "to", "left").select("node", F.coalesce("group_id", "to").alias("group_id")))
    if not moves:
        return groups
    smallest = groups.groupBy("group_id").agg(F.min("node").alias("smallest"))
    return groups.join(smallest, "group_id").select("node", F.col("smallest").alias("group_id"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the links of one task, with the smallest of its group."""
    links = pa.Table.from_batches(list(batches)) if (batches := [x for x in batches if x.num_rows]) else None
    if links is None:
        return
    nodes = pa.chunked_array([*links["u"].chunks, *links["v"].chunks]).unique()
    nodes = nodes.take(pa.compute.sort_indices(nodes))
    u, v = (pa.compute.index_in(links[c], nodes).to_numpy().astype(np.int64) for c in "uv")
    top = np.arange(len(nodes))
    while len(u):
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while (top != (up := top[top])).any():
            top = up
        u, v = top[u], top[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(top))], ["node", "group_id"])


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
