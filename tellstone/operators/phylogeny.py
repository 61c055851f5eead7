"""Average-linkage trees over texts, their support, and gains and losses of motifs along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.constants import HYBRID_WEIGHTS, MOTIFS, PERIODS, PRESENT, UNKNOWN_PERIOD

#: Different profiles that one tree may have; the method is sequential and keeps all their distances.
MOST_PROFILES = 4000
_TREE = "node_id string, parent_id string, node_type string, period string, height double, edge double, depth double, n_texts long, motifs array<string>"


def distances(vectors: np.ndarray) -> np.ndarray:
    """Hybrid distance of all pairs of rows: weighted cosine and Jaccard distance; a zero row has cosine distance 1."""
    norms = np.linalg.norm(vectors, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.nan_to_num(1 - vectors @ vectors.T / np.outer(norms, norms), nan=1.0)
    there = (vectors > PRESENT).astype(float)
    shared, sizes = there @ there.T, there.sum(axis=1)
    union = sizes[:, None] + sizes - shared
    jaccard = np.where(union > 0, 1 - shared / np.maximum(union, 1), 0.0)
    out = HYBRID_WEIGHTS[0] * np.clip(cosine, 0, None) + HYBRID_WEIGHTS[1] * jaccard
    np.fill_diagonal(out, 0)
    return out


def average_linkage(dist: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (node, node, height) of weighted leaves; equal distances go to the lowest pair of places.

    Leaf i stands for sizes[i] equal texts, whose own merges at height 0 come first in any case.
    """
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, weight, merges = list(range(n)), sizes.astype(float).copy(), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        rows = np.flatnonzero(alive)
        sub = d[np.ix_(rows, rows)]
        i, j = divmod(int(sub.argmin()), len(rows))
        i, j = sorted((rows[i], rows[j]))
        merges.append((ids[i], ids[j], float(d[i, j])))
        mixed = (weight[i] * d[i] + weight[j] * d[j]) / (weight[i] + weight[j])
        d[i], d[:, i] = mixed, mixed
        d[i, i] = np.inf
        weight[i] += weight[j]
        ids[i], alive[j] = n + step, False
    return merges


def _period_rank(period: str | None) -> int:
    return PERIODS.index(period) if period in PERIODS else UNKNOWN_PERIOD


def grow_tree(names: list[str], vectors: np.ndarray, sizes: np.ndarray, periods: list[str | None]) -> pd.DataFrame:
    """Nodes of the tree: 2 n - 1 rows; an ancestor has the motifs of both children and the earlier period."""
    merges = average_linkage(distances(vectors), sizes)
    n = len(names)
    motif_ids = [m for m, _, _ in MOTIFS]
    motifs = [{m for m, v in zip(motif_ids, row) if v > PRESENT} for row in vectors]
    ids, period, height, texts = list(names), list(periods), [0.0] * n, list(map(int, sizes))
    parent, edge = [None] * (2 * n - 1), [None] * (2 * n - 1)
    for k, (a, b, h) in enumerate(merges):
        ids.append(f"ANCESTOR-{n + k}")
        height.append(h)
        motifs.append(motifs[a] | motifs[b])
        period.append(min((period[a], period[b]), key=_period_rank))
        texts.append(texts[a] + texts[b])
        for child in (a, b):
            parent[child], edge[child] = n + k, h / 2
    depth = [0.0] * len(ids)
    for i in range(len(ids) - 1, -1, -1):
        if parent[i] is not None:
            depth[i] = depth[parent[i]] + edge[i]
    kinds = ["text"] * n + ["ancestor"] * (len(ids) - n)
    if ids:
        kinds[-1] = "root" if n > 1 else "text"
    return pd.DataFrame({
        "node_id": ids, "parent_id": [None if p is None else ids[p] for p in parent[: len(ids)]], "node_type": kinds, "period": period, "height": height,
        "edge": edge[: len(ids)], "depth": depth, "n_texts": texts, "motifs": [sorted(m) for m in motifs],
    })


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    order = {m: i for i, (m, _, _) in enumerate(MOTIFS)}
    out = np.zeros((len(pdf), len(order)))
    for row, entries in enumerate(pdf["entries"]):
        for e in entries:
            out[row, order[e["motif_id"]]] = e["confidence"]
    return out


def _bounded(profiles: DataFrame) -> DataFrame:
    many = profiles.limit(MOST_PROFILES + 1).count()
    if many > MOST_PROFILES:
        raise ValueError(f"a tree may have at most {MOST_PROFILES} different profiles")
    return profiles


def tree_of_profiles(profiles: DataFrame) -> DataFrame:
    """The tree over profiles (profile, entries, n_texts, period) as one row a node.

    Equal texts merge at height 0 before anything else, so a tree over their profiles, weighted by
    the number of texts, is the tree over all texts. Clustering is sequential: it runs in one task,
    on at most MOST_PROFILES profiles, beyond which it is refused. Without profiles there are no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("profile", ignore_index=True)
        return grow_tree(pdf["profile"].tolist(), _matrix(pdf), pdf["n_texts"].to_numpy(), pdf["period"].tolist())

    return _bounded(profiles).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, _TREE)


def bootstrap_support(profiles: DataFrame, rounds: int = 100, seed: int = 42) -> DataFrame:
    """node_id, support: the share of resampled trees, in percent, that have the same group of texts.

    Every round draws motifs with replacement and grows a tree in a task of its own; groups are
    compared as sets of profiles. The root's group is always there.
    """
    spark: SparkSession = profiles.sparkSession
    pdf = _bounded(profiles).select("profile", "entries", "n_texts").toPandas().sort_values("profile", ignore_index=True)
    if len(pdf) < 2:
        return spark.createDataFrame([], "node_id string, support double")
    vectors, sizes, names = _matrix(pdf), pdf["n_texts"].to_numpy(), pdf["profile"].tolist()

    def groups(rows: np.ndarray) -> list[frozenset[int]]:
        below = [frozenset([i]) for i in range(len(names))]
        for a, b, _ in average_linkage(distances(rows), sizes):
            below.append(below[a] | below[b])
        return below[len(names) :]

    own = groups(vectors)

    def run(batches):
        for batch in batches:
            for r in batch["round"]:
                drawn = np.random.default_rng((seed, int(r))).integers(0, vectors.shape[1], vectors.shape[1])
                again = set(groups(vectors[:, drawn]))
                yield pd.DataFrame({"node": [i for i, g in enumerate(own) if g in again]}, dtype="int64")

    seen = spark.range(rounds, numPartitions=min(rounds, 32)).withColumnRenamed("id", "round").mapInPandas(run, "node long").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    nodes = spark.createDataFrame([(i, f"ANCESTOR-{len(names) + i}") for i in range(len(own))], "node long, node_id string")
    return nodes.join(seen, "node", "left").select("node_id", F.round(F.coalesce("n", F.lit(0)) * 100.0 / rounds, 2).alias("support"))


def migrations(tree: DataFrame, gain: float = 0.8, loss: float = 0.7) -> DataFrame:
    """Gains and losses of motifs along the edges of a tree.

    Ancestors that unite their children's motifs show losses only; ``parsimony`` gives other ancestors.
    """
    child = tree.where("parent_id is not null").select("node_id", "parent_id", F.col("period").alias("to_period"), F.col("motifs").alias("to_motifs"))
    parent = tree.select(F.col("node_id").alias("parent_id"), F.col("period").alias("from_period"), F.col("motifs").alias("from_motifs"))
    edges = child.join(parent, "parent_id")
    event = lambda a, b, kind, confidence: F.transform(F.array_except(a, b), lambda m: F.struct(m.alias("motif_id"), F.lit(kind).alias("event_type"), F.lit(confidence).alias("confidence")))
    events = F.concat(event("to_motifs", "from_motifs", "gain", gain), event("from_motifs", "to_motifs", "loss", loss))
    return edges.select("parent_id", "node_id", "from_period", "to_period", F.explode(events).alias("e")).select("parent_id", "node_id", "from_period", "to_period", "e.*")


def parsimony(tree: pd.DataFrame) -> pd.DataFrame:
    """The tree with ancestors' motifs by Fitch's rule: what both children may have, else what either has, fixed from the root down."""
    rows = tree.set_index("node_id")
    children: dict[str, list[str]] = {}
    for node, parent in zip(tree["node_id"], tree["parent_id"]):
        if isinstance(parent, str):
            children.setdefault(parent, []).append(node)
    every = sorted({m for ms in rows["motifs"] for m in ms})
    may = {}
    for node in tree["node_id"]:  # children stand before their parents
        if node not in children:
            own = set(rows.at[node, "motifs"])
            may[node] = {m: {m in own} for m in every}
        else:
            a, b = (may[c] for c in children[node])
            may[node] = {m: (a[m] & b[m]) or (a[m] | b[m]) for m in every}
    fixed: dict[str, dict[str, bool]] = {}
    for node, parent in zip(tree["node_id"][::-1], tree["parent_id"][::-1]):
        above = fixed.get(parent) if isinstance(parent, str) else None
        fixed[node] = {m: above[m] if above and above[m] in may[node][m] else min(may[node][m]) for m in every}
    return tree.assign(motifs=[[m for m in every if fixed[n][m]] for n in tree["node_id"]])


def ancestors(tree: DataFrame, nodes: list[str]) -> DataFrame:
    """node_id of the given nodes and all above them, level by level; a tree is at most MOST_PROFILES deep."""
    spark = tree.sparkSession
    tree.select("node_id", "parent_id").createOrReplaceTempView("_tree_links")
    start = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    start.createOrReplaceTempView("_tree_start")
    return spark.sql(f"""
        with recursive up(node_id) max recursion level {MOST_PROFILES} as (
          select node_id from _tree_start
          union all select t.parent_id from up join _tree_links t on t.node_id = up.node_id where t.parent_id is not null)
        select distinct node_id from up""")
