import random

import pytest
from pyspark.sql import functions as F

from tellstone.operators import joinsearch
from tellstone.operators.groups import linked_groups
from tellstone.operators.joinsearch import continuity, join_search
from tellstone.plans.fragments import best_reconstructions, match_components
from tellstone.session import Scratch


def test_groups(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(70)] + [(200, 300 + i) for i in range(90)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    df = spark.createDataFrame([*links, (5, 5), (None, 3), (3, None), (1, 0)], "a long, b long")
    rows = linked_groups(df, "a", "b").collect()
    assert {r["node"]: r["group_id"] for r in rows} == {x: find(x) for x in list(top)} and len(rows) == len(top)
    assert linked_groups(df.limit(0), "a", "b").count() == 0


@pytest.fixture
def written(monkeypatch):
    """One item for each table that is written to the shared folder."""
    tables, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, *args: tables.append(self) or write(self, *args))
    return tables


def test_groups_of_a_long_chain_take_few_tables(spark, written):
    names = random.Random(3).sample([f"T-{i}" for i in range(400)], 400)
    df = spark.createDataFrame([*zip(names, names[1:]), ("x", "y"), ("y", "é")], "a string, b string")
    rows = linked_groups(df, "a", "b").collect()
    assert len(written) == 1
    assert {r["node"]: r["group_id"] for r in rows} == {**{n: min(names) for n in names}, "x": "x", "y": "x", "é": "x"} and len(rows) == 403
    again = linked_groups(df, "a", "b", in_one_task=20).collect()  # contracted by joins first
    assert sorted(again) == sorted(rows) and 1 < len(written) < 60


def test_components_of_a_long_chain_take_few_tables(spark, written, tmp_path):
    names = random.Random(4).sample([f"T-{i}" for i in range(300)], 300)
    rows = [*((a, b, 0.65) for a, b in zip(names, names[1:])), ("x", "y", 0.9), ("y", "z", 0.64), ("z", "z", 0.9), ("", "x", 0.9), ("w", "x", float("nan"))]
    spark.createDataFrame(rows, "tablet_a string, tablet_b string, join_confidence double").write.parquet(f"{tmp_path}/join_match.parquet")
    assert [tuple(r) for r in match_components(spark, str(tmp_path)).collect()] == [(2, 300)]
    assert len(written) == 1


def test_join_search_makes_no_row_for_each_common_term(spark, tmp_path):
    texts = spark.range(300).selectExpr("cast(id as string) as id", "concat('a b c d e f g h ', if(id % 3 = 0, '', concat('t', id % 7, ' U')), if(id = 5, ' b a', '')) as text")
    found = join_search(texts.where("id % 20 = 0"), texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    want = {}
    words = {r["id"]: r["text"].lower().split() for r in texts.collect()}
    for q in (str(i) for i in range(0, 300, 20)):
        rows = []
        for p in words.keys() - {q}:
            shares = [len(set(a) & set(b)) / min(len(set(a)), len(set(b))) for a, b in ((words[q], words[p]), ([*zip(words[q], words[q][1:])], [*zip(words[p], words[p][1:])]))]
            rows.append((-round(0.6 * shares[0] + 0.4 * shares[1], 9), p))
        want[q] = [p for _, p in sorted(rows)[:3]]
    got = {}
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["partner"])
    assert got == want


def test_join_search_of_single_words(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "x x x"), ("c", "y"), (None, "x")], "id string, text string")
    rows = join_search(texts.where("id in ('a', 'c')"), texts).collect()
    assert [tuple(r) for r in rows] == [("a", "b", 1.0, 0.0, 0.6, 1)]


def test_reconstructions_of_equal_texts(spark, tmp_path):
    rows = [(f"T-{i}", "w1 w2 w3" if i < 30 else f"w{i} w1", 0) for i in range(60)] + [("T-0", "old", -1)]
    spark.createDataFrame(rows, "id string, transliteration string, created_at int").write.parquet(f"{tmp_path}/tablets.parquet")
    best = best_reconstructions(spark, str(tmp_path))
    assert "Generate" not in best._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in best.collect()] == [("T-0", "T-1", 1.0), ("T-0", "T-10", 1.0), ("T-0", "T-11", 1.0), ("T-0", "T-20", 1.0), ("T-1", "T-20", 1.0)]


def test_best_pairs_meet_only_where_scores_are_high(spark, monkeypatch):
    asked, search = [], joinsearch.join_search
    monkeypatch.setattr(joinsearch, "join_search", lambda *args, **more: asked.append(more.get("least")) or search(*args, **more))
    rng = random.Random(7)
    rows = [(f"T-{i}", " ".join(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.choice((1, 2, 3, 9, 30))))) for i in range(400)]
    texts = spark.createDataFrame(rows, "id string, text string")
    queries = texts.where("cast(substr(id, 3) as int) % 5 = 0")

    def want(k, n):
        found = search(queries, texts, k).selectExpr("least(id, partner) a", "greatest(id, partner) b", "round(score, 6) s").distinct().collect()
        return [(a, b, s) for s, a, b in sorted((-r["s"], r["a"], r["b"]) for r in found)][:n]

    for n, upto in ((5, 1), (10_000, 3)):
        asked.clear()
        got = [(r["a"], r["b"], -r["score"]) for r in joinsearch.best_pairs(queries, texts, n).collect()]
        assert got == want(3, n) and len(asked) == upto
    for least in (1.0, 0.9, 0.7, 0.3):
        for by in ("min", "max"):
            all_of = [tuple(r) for r in search(queries, texts, 400, by).collect() if round(r["score"], 6) >= least]
            assert sorted(tuple(r) for r in search(queries, texts, 400, by, least).collect()) == sorted(all_of) and (all_of or by == "max")


def test_join_search(spark):
    texts = spark.createDataFrame([("a", "x y z"), ("b", "X y q"), ("c", "z"), ("d", ""), ("e", None), ("f", "r s"), ("g", "x y z")], "id string, text string")
    got = {}
    for r in join_search(texts.where("id = 'a'"), texts, 5).orderBy("place").collect():
        got[r["partner"]] = (round(r["words"], 3), round(r["bigrams"], 3), round(r["score"], 3))
    assert list(got) == ["g", "c", "b"] and got == {"g": (1.0, 1.0, 1.0), "c": (1.0, 0.0, 0.6), "b": (0.667, 0.5, 0.6)} or list(got) == ["g", "b", "c"]
    assert join_search(texts.limit(0), texts).count() == 0
    one = spark.range(1).select(continuity(F.lit(0.5), F.lit(1.0), F.lit(None).cast("double")).alias("a"), continuity(F.lit(0.5), F.lit(1.0), F.lit(0.5), "max").alias("b")).first()
    assert abs(one["a"] - 0.55) < 1e-9 and abs(one["b"] - 0.6) < 1e-9
