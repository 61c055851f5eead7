import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tellstone.operators import motifs as M
from tellstone.operators import phylogeny as P


def texts(spark, *rows):
    return spark.createDataFrame([(f"T{i}", t, None) for i, t in enumerate(rows)], "text_id string, text string, translation string").select("text_id", M.full_text("text", "translation").alias("full"))


def test_instances_agree_with_counts(spark):
    df = texts(spark, "The Flood and the ark; a flood. me, ḫme", None, "", "Built a great boat 𒀭 of reed. waters rose", "kur " * 2000)
    counts = {(r["text_id"], r["motif_id"]): r["n"] for r in M.motif_matches(df).collect()}
    seen = {}
    for r in M.motif_instances(df).collect():
        seen[r["text_id"], r["motif_id"]] = seen.get((r["text_id"], r["motif_id"]), 0) + 1
    assert counts == seen and counts["T0", "MOTIF-ME-GIFTS"] == 1 and counts["T4", "MOTIF-UNDERWORLD-JOURNEY"] == 2000


def test_distances_agree_with_matrix(spark):
    df = texts(spark, "flood ark", "flood", "me", "clay and the flood", "flood ark")
    profiles, members = M.motif_profiles(M.motif_matches(df))
    assert members.count() == 5 and profiles.count() == 4
    pdf = profiles.toPandas()
    full = P.distances(P._matrix(pdf))
    at = {p: i for i, p in enumerate(pdf["profile"])}
    rows = M.profile_distances(profiles).collect()
    for r in rows:
        want = 1.0 if r["profile_1"] is None else full[at[r["profile_1"]], at[r["profile_2"]]]
        assert abs(want - r["hybrid_distance"]) < 1e-5
    assert sum(r["n_pairs"] for r in rows) == 10


def test_texts_without_motifs_have_distances(spark):
    df = texts(spark, "flood ark", "nothing here", "nor here", "flood ark")
    profiles, members = M.motif_profiles(M.motif_matches(df), df)
    assert members.count() == 4 and profiles.count() == 2
    got = sorted((r["hybrid_distance"], r["n_pairs"]) for r in M.profile_distances(profiles).collect())
    assert got == [(0.0, 1), (0.6, 1), (1.0, 4)]
    assert M.profile_distances(profiles.limit(0)).count() == 0


def test_average_linkage_by_hand():
    d = np.array([[0, 2, 6], [2, 0, 10], [6, 10, 0]], float)
    assert P.average_linkage(d, np.ones(3)) == [(0, 1, 2.0), (2, 3, 8.0)] or P.average_linkage(d, np.ones(3)) == [(0, 1, 2.0), (3, 2, 8.0)]
    heights = [h for _, _, h in P.average_linkage(d, np.array([3, 1, 1]))]
    assert heights == [2.0, (3 * 6 + 10) / 4]


def test_weighted_profiles_give_the_tree_of_all_texts():
    rng = np.random.default_rng(3)
    rows = (rng.random((6, 26)) < 0.3) * 0.8
    sizes = np.array([1, 3, 1, 2, 1, 1])
    every = np.repeat(rows, sizes, axis=0)
    few = sorted(h for _, _, h in P.average_linkage(P.distances(rows), sizes))
    many = sorted(h for _, _, h in P.average_linkage(P.distances(every), np.ones(len(every))))
    assert np.allclose(few, many[len(every) - len(rows) :])


def profiles(spark):
    rows = [("a", [("MOTIF-ARK", 0.8), ("MOTIF-FLOOD", 0.9)], 2, "OB"), ("b", [("MOTIF-FLOOD", 0.9)], 1, "ED"), ("c", [("MOTIF-ME-GIFTS", 0.7)], 1, None)]
    return spark.createDataFrame(rows, "profile string, entries array<struct<motif_id string, confidence double>>, n_texts long, period string")


def test_tree(spark):
    tree = P.tree_of_profiles(profiles(spark)).toPandas().set_index("node_id")
    assert len(tree) == 5 and (tree["parent_id"].isna()).sum() == 1
    root = tree[tree["node_type"] == "root"].iloc[0]
    assert root["n_texts"] == 4 and root["period"] == "ED" and len(root["motifs"]) == 3
    assert P.tree_of_profiles(profiles(spark).limit(0)).count() == 0
    assert P.tree_of_profiles(profiles(spark).where("profile = 'a'")).count() == 1
    events = P.migrations(P.tree_of_profiles(profiles(spark))).collect()
    assert events and {r["event_type"] for r in events} == {"loss"}  # ancestors unite their children
    assert {r["node_id"] for r in P.ancestors(P.tree_of_profiles(profiles(spark)), ["a"]).collect()} == {"a", "ANCESTOR-3", "ANCESTOR-4"}
    fitch = P.parsimony(P.tree_of_profiles(profiles(spark)).toPandas())
    assert list(fitch.set_index("node_id").loc["ANCESTOR-3", "motifs"]) == ["MOTIF-FLOOD"]


def test_support(spark):
    rows = {r["node_id"]: r["support"] for r in P.bootstrap_support(profiles(spark), rounds=20).collect()}
    assert rows["ANCESTOR-4"] == 100 and 0 <= rows["ANCESTOR-3"] <= 100
    assert P.bootstrap_support(profiles(spark).limit(0)).count() == 0
