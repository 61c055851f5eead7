"""Search, facets and writes of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def matches_any(query: str, *columns: str) -> Column:
    """Whether any column contains the query, whatever the case; % and _ in it stay wildcards. Empty finds all."""
    if not query:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def search(entries: DataFrame, query: str = "", text: tuple[str, ...] = ("title", "transliteration", "translation"), like: dict[str, str] | None = None, **equal: str | list[str] | None) -> DataFrame:
    """Entries with the query in any text column and the given values elsewhere.

    A value may be one or a list; a value of None or empty sets no condition. Conditions are
    combined by and, the text columns by or within their own brackets. ``like`` asks for a substring.
    """
    conditions = [matches_any(query, *text)]
    for column, value in equal.items():
        if value:
            conditions.append(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    for column, value in (like or {}).items():
        if value:
            conditions.append(F.col(column).ilike(f"%{value}%"))
    return entries.where(reduce(lambda a, b: a & b, conditions))


def search_loosely(entries: DataFrame, query: str, *columns: str, **equal: list[str]) -> DataFrame:
    """The same without brackets: the values only bind the last text column, as ``a or b or (c and value)`` does."""
    last = reduce(lambda a, b: a & b, [matches_any(query, columns[-1]), *[F.col(c).isin(*v) for c, v in equal.items()]])
    return entries.where(reduce(lambda a, b: a | b, [matches_any(query, c) for c in columns[:-1]] + [last]))


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page in a total order; give a key as the last order column."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def any_column_contains(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows any of whose columns, as text, has the pattern, whatever the case. Nulls match nothing."""
    texts = F.array(*[F.col(c).cast("string") for c, t in rows.dtypes if not t.startswith(("array", "struct", "map"))])
    return rows.where(F.exists(F.array_compact(texts), lambda x: x.rlike(f"(?i){pattern}")))


def facet_counts(rows: DataFrame, *facets: str, top: int | None = None) -> DataFrame:
    """Rows facet, value, n for each value of each facet, from one pass over the rows; nulls are not counted.

    ``top`` keeps so many of each facet, ties by value.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    return counts.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("place") <= top).drop("place")


def first_wins(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch to append: the first of each key that the target does not have yet; a partial aggregate, so that no key meets whole."""
    body = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*body), F.struct(*order)).alias("_row"))
    return first.select(*key, *[F.col(f"_row.{c}").alias(c) for c in body]).select(*batch.columns).join(target.select(*key).distinct(), key, "left_anti")


def last_wins(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The target after the batch: for each key the row that is latest by ``order``, those of the batch before equals."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    body = F.struct(*[c for c in both.columns if c not in key])
    latest = both.groupBy(*key).agg(F.max_by(body, F.struct(F.col(order), F.col("_new"))).alias("_row"))
    return latest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in target.columns if c not in key])


def set_values(rows: DataFrame, condition: Column, **values: object) -> DataFrame:
    """Rows with new values where the condition holds; unknown column names are refused."""
    unknown = set(values) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return rows.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows with ``batch``: numbers of runs of ``size`` rows in order.

    Rows are range-partitioned by the order and numbered within their partition; the sizes of
    the partitions before, one number each, are added. No task sees more than its range.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    numbered = ordered.withColumn("_place", place).join(F.broadcast(before), "_part")
    return numbered.withColumn("batch", F.floor((F.col("_before") + F.col("_place") - 1) / size)).drop("_part", "_place", "_before")
