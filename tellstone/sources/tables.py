"""The named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of the folder, with only the named columns if there are any."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_by_id(df: DataFrame, key: str, stamp: str | None, *columns: str) -> DataFrame:
    """One row for each key; the latest by stamp where rows come again.

    Grouping runs as a partial aggregate before the shuffle, so that a key with
    very many rows never reaches one task whole.
    """
    body = F.struct(*columns)
    picked = F.max_by(body, F.col(stamp)) if stamp else F.any_value(body)
    return df.groupBy(key).agg(picked.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def tablets(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Tablets, each once with its latest row."""
    return latest_by_id(read_table(spark, folder, "tablets"), "id", "created_at", *columns)


def catalog(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Catalogue entries, each once."""
    return latest_by_id(read_table(spark, folder, "corpus_catalog"), "id", None, *columns)


def myths(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Myth texts, each once with its latest row."""
    return latest_by_id(read_table(spark, folder, "myth_texts"), "id", "created_at", *columns)


def detections(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Detected signs, each once; rows that come again are exact copies."""
    return latest_by_id(read_table(spark, folder, "cuneiform_signs"), "id", None, *columns)


def table_or_empty(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the folder, or an empty one of the schema where there is no such table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") if there else spark.createDataFrame([], schema)
