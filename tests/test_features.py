import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellstone.operators import blocks as B
from tellstone.operators import features as E
from tellstone.plans.features import visual_word_shares
from tellstone.plans.fragments import char_neighbours
from tellstone.session import spread


def test_terms(spark):
    df = spark.createDataFrame([("Ab, cd! x ef",), (None,), ("",)], "t string")
    rows = df.select(E.word_terms(F.col("t"), 2).alias("w"), E.char_terms(F.col("t"), 2).alias("c")).collect()
    assert rows[0]["w"] == ["ab", "cd", "ef", "ab cd", "cd ef"] and rows[1]["w"] == [] and rows[2]["c"] == []
    assert rows[0]["c"][:7] == [" ", "a", "b", ",", " ", " a", "ab"]


def test_weights_and_neighbours(spark):
    docs = [(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["d"]), (4, []), (5, None)]
    df = spark.createDataFrame(docs, "id int, terms array<string>")
    got = {(r["id"], r["term"]): r["weight"] for r in E.weighted_terms(df).collect()}
    idf = lambda n: math.log(6 / (1 + n)) + 1
    a, b = (1 + math.log(2)) * idf(2), idf(1)
    assert got[1, "a"] == pytest.approx(a / math.hypot(a, b)) and got[3, "d"] == pytest.approx(1)
    weights = E.weighted_terms(df)
    near = E.nearest_by_terms(weights.where("id = 1"), weights, 3).collect()
    assert [(r["neighbour"], r["place"]) for r in near] == [(2, 1)]
    assert {r["term"] for r in E.weighted_terms(df, most_terms=1).collect()} == {"a"}
    assert E.weighted_terms(df.limit(0)).count() == 0


def test_neighbours_make_no_row_for_each_common_term(spark):
    rng = np.random.default_rng(2)
    docs = [(f"d{i}", [f"t{t}" for t in rng.zipf(1.4, 30) if t < 900]) for i in range(250)] + [("d250", ["t1", "t2"]), ("d251", ["t1", "t2"])]
    weights = E.weighted_terms(spark.createDataFrame(docs, "id string, terms array<string>"))
    found = E.nearest_by_terms(weights.where("id in ('d250', 'd3', 'd44')"), weights, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin", "")
    vectors = {}
    for r in weights.collect():
        vectors.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = set()
    for q in ("d250", "d3", "d44"):
        sims = {p: round(sum(w * v.get(t, 0) for t, w in vectors[q].items()), 9) for p, v in vectors.items() if p != q and vectors[q].keys() & v.keys()}
        want |= {(q, p, place + 1) for place, p in enumerate(sorted(sims, key=lambda p: (-sims[p], p))[:4])}
    assert {(r["id"], r["neighbour"], r["place"]) for r in found.collect()} == want


def test_char_neighbours_join_no_terms_and_use_all_cores(spark, tmp_path):
    rows = [(f"M-{i}", f"abc {'xyz' * (i % 5)} {i % 7}", 0) for i in range(50)] + [("M-0", "old", -1), ("M-60", None, 0)]
    spark.createDataFrame(rows, "id string, text string, created_at int").write.parquet(f"{tmp_path}/myth_texts.parquet")
    found = char_neighbours(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert found.where("id = 'M-0' and place = 1").first()["neighbour"] == "M-35"
    assert {r["id"] for r in found.collect()} == {"M-0", "M-20", "M-40"}
    grouped = spark.range(9).groupBy("id").count()
    assert spread(grouped, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


def test_every_text_has_char_neighbours(spark, tmp_path):
    rows = [(f"M-{i}", f"abc {'xyz' * (i % 5)} {i % 7}", 0) for i in range(1, 40)] + [("no number", "abc xyz 3", 0), ("M-7b", "xyz", 0), ("null", None, 0)]
    spark.createDataFrame(rows, "id string, text string, created_at int").write.parquet(f"{tmp_path}/myth_texts.parquet")
    found = char_neighbours(spark, str(tmp_path))
    rows_of = found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["place"]) for r in rows_of) == sorted((r[0], place) for r in rows if r[1] for place in (1, 2, 3))


def test_pairs_beyond_the_bounds_are_left_out_and_no_other(monkeypatch):
    monkeypatch.setattr(E, "FIRST_AXES", 12)
    monkeypatch.setattr(E, "AXES", 24)
    rng, k = np.random.default_rng(7), 3
    n, n_terms = 900, 400
    kinds = rng.random((60, n_terms)) * (rng.random((60, n_terms)) < 0.1)
    x = kinds[rng.integers(0, 60, n)] + 0.3 * rng.random((n, n_terms)) * (rng.random((n, n_terms)) < 0.05)
    x[5], x[700:703] = 0, x[3]  # without terms; equal ones
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = x @ x.T
    np.fill_diagonal(sims, 0)
    want = {(i, j) for i in range(n) for j in np.lexsort((np.arange(n), -np.round(sims[i], 9)))[:k] if sims[i, j] > 0}

    def part(of):
        at, term = np.nonzero(x[of])
        return at, term, x[of][at, term]

    axes = E._axes(*part(range(0, n, 3)), 300)
    side = lambda of: (pa.array([f"{i:04d}" for i in of]), part(of), E._bounds(*part(of), len(of), *axes).astype(np.float32))
    multiplied = []
    products = B.products
    monkeypatch.setattr(B, "products", lambda q, r, shape: multiplied.append(shape) or products(q, r, shape))
    for many in (1, 0):  # pairs within the bounds, or all of a block
        monkeypatch.setattr(E, "MANY", many)
        queries, top, found = side(range(n)), np.full((n, k), -1.0), []
        for begin in range(0, n, 300):
            out = E._nearest_bounded(queries, side(range(begin, begin + 300)), top, n_terms, k).to_pylist()
            found += [(int(r["id"]), int(r["neighbour"]), r["similarity"]) for r in out]
        assert len(found) < 2.5 * k * n and bool(multiplied) == (many == 0)
        best = {}
        for i, j, s in found:
            best.setdefault(i, []).append((-round(s, 9), j))
        assert {(i, j) for i, rows in best.items() for _, j in sorted(rows)[:k]} == want


def test_counts_of_chars_and_their_neighbours(spark):
    rng = np.random.default_rng(3)
    texts = [(f"t{i}", " ".join("".join(rng.choice(list("abcİß𒀀é-"), rng.integers(1, 6))) for _ in range(rng.integers(0, 9)))) for i in range(120)] + [("null", None), ("blank", " \t\n "), (None, "abc")]
    df = spark.createDataFrame(texts, "id string, text string")
    counted = E.char_counts(df)
    number = lambda t: sum((ord(c) + 1) << 21 * (len(t) - 1 - i) for i, c in enumerate(t))
    want = {}
    for r in df.select("id", E.char_terms(F.col("text")).alias("terms")).collect():
        want[r["id"]] = {number(t): r["terms"].count(t) for t in r["terms"]}
    assert {r["id"]: dict(zip(r["terms"], r["counts"])) for r in counted.collect()} == want
    weights = E.weighted_terms(df.select("id", E.char_terms(F.col("text")).alias("terms")), sublinear=False)
    asks = F.col("id").endswith("0") | F.col("id").isin("null", "blank")
    near = sorted(tuple(r) for r in E.nearest_by_terms(weights.where(asks), weights, 3).collect())
    for most in (200_000, 10):  # the second by joins
        found = E.nearest_by_counts(counted, asks, 3, most)
        assert sorted(tuple(r) for r in found.collect()) == near and len(near) > 30
    plan = E.nearest_by_counts(counted, asks, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert E.nearest_by_counts(E.char_counts(df.limit(0)), asks, 3).count() == 0


def test_reduced_vectors_keep_products(spark):
    df = spark.createDataFrame([(i, [f"t{i % 3}", f"u{i % 2}"]) for i in range(12)], "id int, terms array<string>")
    weights = E.weighted_terms(df)
    full = {}
    for r in weights.collect():
        full.setdefault(r["id"], {})[r["term"]] = r["weight"]
    low = {r["id"]: np.array(r["vector"]) for r in E.reduced_vectors(weights, 5).collect()}
    for i in range(12):
        for j in range(12):
            assert low[i] @ low[j] == pytest.approx(sum(w * full[j].get(t, 0) for t, w in full[i].items()), abs=1e-6)


def test_visual_words(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{n % 4}", (rng.normal(size=3) * 0.01 + (n % 2) * 5).tolist()) for n in range(40)] + [("none", None)]
    shares = E.visual_words(spark.createDataFrame(rows, "image_id string, descriptor array<double>"), k=2).collect()
    assert {r["image_id"]: r["share"] for r in shares} == {f"i{n}": 1.0 for n in range(4)}


def test_visual_words_of_the_query(spark, folder):
    words = {r["word"] for r in visual_word_shares(spark, folder).collect()}
    assert 8 < len(words) <= 256


def test_models_from_outside(spark):
    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    assert {r["id"]: r["embedding"] for r in E.embedded(df, Lengths).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    assert E.asked(df, None).count() == 0
    assert [tuple(r) for r in E.asked(df, lambda: str.upper, "say {text}").collect()] == [(1, "SAY ABC")]
