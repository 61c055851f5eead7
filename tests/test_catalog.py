import pytest
from pyspark.sql import functions as F

from tellstone.operators import catalog as C


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(1, "Flood tale", "a", "OB"), (2, None, "FLOOD", "NA"), (3, "Hymn", None, None), (4, "100% sure", "b", "OB")], "id int, title string, text string, period string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search(entries):
    assert ids(C.search(entries, "flood", ("title", "text"))) == [1, 2]
    assert ids(C.search(entries, "flood", ("title", "text"), period=["OB"])) == [1]
    assert ids(C.search(entries, "", ("title",), period=None)) == [1, 2, 3, 4]
    assert ids(C.search(entries, "", like={"title": "SURE"})) == [4]
    assert ids(C.search_loosely(entries, "flood", "title", "text", period=["NB"])) == [1]


def test_any_column_and_facets(entries):
    assert ids(C.any_column_contains(entries, "^hymn$|^2$")) == [2, 3]
    counts = {(r["facet"], r["value"]): r["n"] for r in C.facet_counts(entries, "period", "text").collect()}
    assert counts[("period", "OB")] == 2 and (("period", None) not in counts)
    top = C.facet_counts(entries, "text", top=1).collect()
    assert [r["value"] for r in top] == ["FLOOD"]  # ties by value


def test_writes(spark, entries):
    batch = spark.createDataFrame([(4, "x", "x", "x", 1), (5, "first", "x", "x", 1), (5, "second", "x", "x", 2)], "id int, title string, text string, period string, n int")
    assert [(r["id"], r["title"]) for r in C.first_wins(batch, entries, ["id"], ["n"]).collect()] == [(5, "first")]
    target = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 0, "added")], "k string, at int, v string")
    assert {r["k"]: r["v"] for r in C.last_wins(target, new, ["k"], "at").collect()} == {"a": "new", "b": "kept", "c": "added"}
    assert C.set_values(entries, F.col("id") == 1, title="T").where("id = 1").first()["title"] == "T"
    with pytest.raises(ValueError):
        C.set_values(entries, F.lit(True), nope=1)


def test_batches(spark):
    df = spark.range(2500).select((F.col("id") % 50).alias("a"), "id")
    got = C.batches(df, 1000, "a", "id").orderBy("a", "id").collect()
    assert [r["batch"] for r in got] == [i // 1000 for i in range(2500)]
    assert C.batches(df.limit(0), 10, "a").count() == 0
