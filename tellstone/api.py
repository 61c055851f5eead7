"""One object for everyday use: search, readings, corrections, vectors, health, exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tellstone.functions.text import sign_tokens
from tellstone.operators import catalog as C
from tellstone.operators import corrections, readings, similarity
from tellstone.plans.quality import quality_checks, quality_status
from tellstone.session import ship_package
from tellstone.sinks import exports
from tellstone.sources import tables
from tellstone.sources.unions import transliterations


class Archive:
    """The tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark)

    def tablets(self, *columns: str) -> DataFrame:
        return tables.tablets(self.spark, self.folder, *(columns or ("source", "title", "cuneiform", "transliteration", "language", "period", "genre", "myth_labels", "content_hash", "p_number", "created_at")))

    def catalog(self, *columns: str) -> DataFrame:
        return tables.catalog(self.spark, self.folder, *(columns or (*exports.CSV_COLUMNS, "transliteration", "translation", "accession_date", "content_hash")))

    def search_corpus(self, query: str = "", limit: int = 100, offset: int = 0, provenance: str | None = None, **equal: str | list[str] | None) -> DataFrame:
        """A page of the catalogue: the query in title, transliteration or translation, other columns equal to the given values."""
        return C.page(C.search(self.catalog(), query, like={"provenance": provenance}, **equal), limit, offset, F.col("id"))

    def signs(self, sign_types: list[str] | None = None, periods: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
        rows = tables.detections(self.spark, self.folder, "tablet_id", "sign_type", "confidence", "atf_hypothesis")
        if min_confidence > 0:
            rows = rows.where(F.col("confidence") >= min_confidence)
        rows = rows.join(self.tablets("period").withColumnRenamed("id", "tablet_id"), "tablet_id", "left")
        return C.search(rows, sign_type=sign_types, period=periods)

    def knowledge(self, sign_id: str | None = None) -> DataFrame:
        rows = tables.read_table(self.spark, self.folder, "prebaked_sign_knowledge")
        return rows.where(F.col("sign_id") == sign_id) if sign_id else rows

    def get_embeddings(self, embedding_type: str) -> DataFrame:
        return tables.read_table(self.spark, self.folder, "prebaked_embeddings").where(F.col("embedding_type") == embedding_type)

    def nearest(self, queries: DataFrame, embedding_type: str, k: int = 10) -> DataFrame:
        """The k nearest vectors of the type to each query (id, vec)."""
        rows = self.get_embeddings(embedding_type).where(F.size("embedding") == F.col("embedding_dim")).select("id", F.col("embedding").alias("vec"))
        return similarity.exact_nearest(queries, rows, k)

    def _tokens(self) -> DataFrame:
        rows = transliterations(self.tablets("source", "transliteration"), tables.myths(self.spark, self.folder, "corpus_source", "transliteration"), self.catalog("source_corpus", "transliteration"))
        return rows.select(sign_tokens(F.col("transliteration")).alias("tokens"))

    def disambiguate(self, sign_id: str, context: list[str], most: int = 5) -> DataFrame:
        """The most probable readings of a sign in a context; an unknown sign has no rows."""
        tokens = self._tokens()
        return readings.reading_posteriors(self.knowledge(sign_id), readings.token_totals(tokens), readings.window_pairs(tokens, 3), context, most)

    def disambiguate_sequence(self, signs: list[str], window: int = 5) -> DataFrame:
        """The best reading of each sign of a short sequence, in order; null for an unknown one."""
        tokens = self._tokens()
        totals, pairs = readings.token_totals(tokens), readings.window_pairs(tokens, 3)
        out = self.spark.createDataFrame(list(enumerate(signs)), "place int, sign_id string")
        best = None
        for i, sign in enumerate(signs):
            around = signs[max(0, i - window) : i] + signs[i + 1 : i + 1 + window]
            part = readings.reading_posteriors(self.knowledge(sign), totals, pairs, around, 1).select(F.lit(i).alias("place"), "reading", "posterior")
            best = part if best is None else best.unionByName(part)
        return out.join(best, "place", "left").orderBy("place") if best is not None else out

    def submit_correction(self, path: str, correction_id: str, sign_id: str, context: str, reading: str, translation: str = "", confidence: float = 1.0) -> None:
        self._event(path, correction_id, "submit", sign_id, context, reading, translation, confidence)

    def approve_correction(self, path: str, correction_id: str) -> None:
        self._event(path, correction_id, "approve")

    def reject_correction(self, path: str, correction_id: str) -> None:
        self._event(path, correction_id, "reject")

    def _event(self, path: str, correction_id: str, action: str, *content: object) -> None:
        row = (correction_id, action, *(content or (None,) * 5))
        columns = "correction_id string, action string, sign_id string, context string, reading string, translation string, confidence double"
        df = self.spark.createDataFrame([row], columns).withColumns({"at": F.current_timestamp(), "seq": F.unix_micros(F.current_timestamp())})
        df.write.mode("append").parquet(path)

    def corrections(self, path: str) -> DataFrame:
        return corrections.states(self.spark.read.schema(corrections.SCHEMA).parquet(path))

    def health(self) -> tuple[DataFrame, DataFrame]:
        """All checks, and the overall status."""
        return quality_checks(self.spark, self.folder), quality_status(self.spark, self.folder)

    def stats(self, *facets: str, top: int | None = 20) -> DataFrame:
        return C.facet_counts(self.catalog(), *(facets or ("source_corpus", "period", "genre", "provenance")), top=top)

    def stream_catalog(self, source: str | None = None, size: int = 1000) -> Iterator[list[Row]]:
        """Batches of entries in the order of corpus and object, a partition at a time."""
        rows = C.search(self.catalog(), source_corpus=source).orderBy("corpus_id", "object_id", "id")
        batch: list[Row] = []
        for row in rows.toLocalIterator(prefetchPartitions=True):
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def updated(self, condition: Column, **values: object) -> DataFrame:
        """The catalogue with new values where the condition holds."""
        return C.set_values(self.catalog(), condition, **values)

    def export_catalog(self, path: str, fmt: str = "jsonl", source: str | None = None) -> None:
        rows = C.search(self.catalog(), source_corpus=source)
        if fmt == "csv":
            exports.catalog_csv(rows, path)
        elif fmt in ("jsonl", "atf"):
            (exports.jsonl if fmt == "jsonl" else exports.atf_entries)(rows).write.text(path)
        else:
            raise ValueError(f"unknown format {fmt!r}")
