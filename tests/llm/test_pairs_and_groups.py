import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tellstone.llm import registry
from tellstone.llm.components import connected_components, edge_mark, usable_links
from tellstone.llm.cooccurrence import cooccurrence
from tellstone.llm.neardup import near_duplicates, word_pairs
from tellstone.llm.termcounts import marked_terms, miscounted, term_counts


def sets_of(rng, n, vocabulary=60):
    """Records with a few items that nearly all have and a long tail."""
    return [[f"t{min(int(rng.expovariate(0.08)), vocabulary)}" for _ in range(rng.randrange(0, 12))] for _ in range(n)]


@pytest.mark.parametrize("least,share,heavy", [(1, 0.0, 0.2), (1, 0.0, 2.0), (1, 0.0, 0.0), (4, 0.0, 0.1), (3, 0.02, 0.1)])
def test_cooccurrence(spark, least, share, heavy):
    records = [*sets_of(random.Random(1), 700), [], ["only"], None, ["a", None, "b"]]
    df = spark.createDataFrame([(str(i), r, "c") for i, r in enumerate(records)], "rec string, terms array<string>, term string")
    sets = [{x for x in r if x is not None} for r in records if r and any(x is not None for x in r)]
    singles, pairs = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    n = len(sets)
    want = {p: (c, singles[p[0]], singles[p[1]], n) for p, c in pairs.items() if c >= least and c >= share * n}
    rows = cooccurrence(df, least, share, heavy).collect()
    assert {(r["term_a"], r["term_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r["lift"] - r["n_ab"] * n / (r["n_a"] * r["n_b"])) < 1e-9 for r in rows)


def test_cooccurrence_of_nothing(spark):
    df = spark.createDataFrame([], "rec string, terms array<string>")
    assert cooccurrence(df).count() == 0 and cooccurrence(df, 5, 0.005).count() == 0


def test_all_pairs_of_signs(spark, folder):
    rows = registry.QUERIES["p3_pairs"](spark, folder)
    assert rows.columns == ["term_a", "term_b", "n_ab", "n_a", "n_b", "lift"]
    assert rows.where("n_ab = 1").count() > 0 and rows.where("lift < 1").count() > 0


def groups(links):
    at = {}

    def top(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        at[y] = x
    return {x: top(x) for x in list(at)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i:03d}") for i in range(150)]
    loose = [(f"r{rng.randrange(300)}", f"r{rng.randrange(300)}") for _ in range(160)]
    links = chain + star + loose + [(b, a) for a, b in chain[:5]]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, ("x", "x"), (None, "x"), ("x", None)], "a string, b string").withColumns({"u": F.lit(1), "group": F.lit(2)})
    rows = connected_components(df).collect()
    assert {r["id"]: r["group"] for r in rows} == groups([p for p in links if p[0] != p[1]]) and len({r["id"] for r in rows}) == len(rows)
    assert connected_components(df.limit(0)).count() == 0


def test_mark_of_very_many_edges(spark):
    edges = spark.range(20_000_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v"))
    mark = edge_mark(edges)
    assert mark[0] == 20_000_000 and mark != edge_mark(edges.withColumn("u", F.when(F.col("u") == 5, 20_000_001).otherwise(F.col("u"))))
    assert edge_mark(edges.limit(0)) == (0, 0, 0)


def test_links(spark):
    rows = [("a", "b", 0.65), ("a", "b", 0.649), ("a", "a", 1.0), ("", "b", 1.0), (None, "b", 1.0), ("a", "c", None), ("a", "d", float("nan")), ("b", "a", 0.9)]
    df = spark.createDataFrame(rows, "tablet_a string, tablet_b string, join_confidence double")
    assert sorted((r[0], r[1]) for r in usable_links(df, F.col("join_confidence")).collect()) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("similarity,hits,pieces", [(Fraction(1, 2), 2, (4096, 9999, 9999)), (Fraction(1, 2), 1, (4, 16, 50)), (Fraction(4, 5), 3, (8, 8, 10**6))])
def test_near_duplicates(spark, similarity, hits, pieces):
    rng = random.Random(7)
    base = [[rng.randrange(400) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    docs = [sorted({x for x in b if rng.random() > 0.15} | {rng.randrange(400) for _ in range(rng.randrange(4))}) for b in base for _ in range(6)]
    docs += [docs[0]] * 40 + [[], [5], [5], [5, 6]] + [list(range(1000, 1300)), list(range(1000, 1302))]
    df = spark.createDataFrame([(i, [x - 200 for x in d], "z") for i, d in enumerate(docs)] + [(9999, None, "z")], "id long, pairs array<long>, rep string")
    pairs, members = near_duplicates(df, similarity, hits, pieces)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    first = {}
    for i, d in enumerate(docs):
        if d:
            first.setdefault(tuple(d), i)
    assert rep == {i: first[tuple(d)] for i, d in enumerate(docs) if d}
    want = set()
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        o = len(set(a) & set(b))
        if Fraction(o, len(set(a) | set(b))) >= similarity:
            want.add((min(i, j), max(i, j)))
    rows = pairs.collect()
    assert {(r["rep_a"], r["rep_b"]) for r in rows} == want and len(rows) == len(want)


def test_near_duplicates_of_nothing(spark):
    pairs, members = near_duplicates(spark.createDataFrame([], "id long, pairs array<long>"))
    assert pairs.count() == 0 and members.count() == 0


def test_word_pairs(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],), (None,)], "w array<string>")
    sizes = [r[0] for r in df.select(F.size(word_pairs(F.col("w")))).collect()]
    assert sizes == [2, 0, 0, 0]


@pytest.mark.parametrize("bits,most", [(4, 1_000_000), (1, 50), (2, 10)])
def test_term_counts(spark, bits, most):
    records = [*sets_of(random.Random(9), 500), [], None, ["", None, ""], ["one"] * 5000]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(records)], "id int, terms array<string>, records int").repartition(7)
    rows = term_counts(df, bits, most).collect()
    occurrences, in_records = Counter(), defaultdict(set)
    for i, r in enumerate(records):
        for t in r or []:
            if t is not None:
                occurrences[t] += 1
                in_records[t].add(i)
    assert {r["term"]: (r["occurrences"], r["records"]) for r in rows} == {t: (n, len(in_records[t])) for t, n in occurrences.items()} and len(rows) == len(occurrences)


def test_term_counts_beyond_memory(spark):
    terms = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.sha2(F.concat("id", F.lit("-"), i).cast("string"), 256), F.lit("x" * 100)))
    rows = term_counts(spark.range(4000).select(F.concat(terms, F.array(F.lit("all"))).alias("terms")), memory="30MB")
    assert rows.count() == 400_001 and rows.where("occurrences = 4000 and records = 4000").select("term").collect()[0][0] == "all"


def test_one_term_in_very_many_batches(spark, monkeypatch):
    rows = spark.range(60_000, numPartitions=40).select(F.array(F.lit("a"), (F.col("id") % 7).cast("string")).alias("terms"))
    got = {r["term"]: r["records"] for r in term_counts(rows, most_rows=10).collect()}
    assert got["a"] == 60_000 and sum(got.values()) == 120_000


def test_marks(spark):
    counts = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 4), ("d", 1, 1)], "term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in marked_terms(counts, 10).collect()} == {"a": "rare", "b": None, "c": "common", "d": "rare"}
    known = spark.createDataFrame([("A", 9), ("B", 8), ("Z", 0), ("Y", 3), ("C", None), (None, 1)], "sign_id string, corpus_frequency int")
    assert sorted(tuple(r) for r in miscounted(counts, known).collect()) == [("b", 8, 9), ("y", 3, 0)]
    assert term_counts(spark.createDataFrame([], "terms array<string>")).count() == 0
