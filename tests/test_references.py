from datetime import datetime, timezone

from pyspark.sql import functions as F

from tellstone.functions.times import utc_time
from tellstone.operators.references import Child, Parent, missing_by_period, missing_references


def at(day):
    return datetime(2024, 1, day, tzinfo=timezone.utc)


def run(spark, parents, children):
    p = spark.createDataFrame(parents, "id string, arrived timestamp, parent string, n int")
    c = spark.createDataFrame(children, "id string, ref string, seen timestamp, key string")
    return missing_references([Parent("p", p, F.col("id"), F.col("arrived"))], [Child("c", "p", c, F.col("id"), F.col("ref"), F.col("seen"))])


def test_orphan_late_and_kept(spark):
    parents = [("a", at(5), "x", 1), ("a", at(9), "x", 1), ("b", None, "x", 1), (None, at(1), "x", 1)]
    children = [("1", "a", at(6), "k"), ("2", "a", at(4), "k"), ("3", "z", at(4), "k"), ("3", "z", at(4), "k"), ("4", "", at(4), "k"), ("5", None, at(4), "k"), ("6", "b", at(1), "k"), ("7", "a", None, "k"), ("8", "A", at(6), "k"), ("9", "z", None, "k")]
    rows = {r["ref_id"]: r["reason"] for r in run(spark, parents, children).collect()}
    assert rows == {"2": "late", "3": "orphan", "8": "orphan", "9": "orphan"}
    found = {(r["month"], r["reason"]): r["n_refs"] for r in missing_by_period(run(spark, parents, children)).collect()}
    assert found == {("2024-01", "late"): 1, ("2024-01", "orphan"): 2, (None, "orphan"): 1}


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert [r["reason"] for r in run(spark, [], [("1", "a", at(1), "k")]).collect()] == ["orphan"]


def test_hot_key(spark):
    rows = run(spark, [("b", at(1), "x", 1)], [(str(i), "hot" if i % 3 else f"cold{i}", at(2), "k") for i in range(3000)])
    assert rows.count() == 3000


def test_times_in_several_notations(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02T03:04:05",), ("2024-01-02T05:04:05+02:00",), ("2024-01-02T03:04:05Z",), ("nonsense",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(F.date_format(utc_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05"] * 4 + [None] * 3
