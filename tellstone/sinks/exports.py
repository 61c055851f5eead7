"""Exports: each format is a DataFrame of text lines or JSON documents, and written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ["corpus_id", "object_id", "title", "period", "provenance", "genre", "language", "source_corpus"]
BASE = "https://example.org/tablets/"


def jsonl(entries: DataFrame) -> DataFrame:
    """One JSON document an entry, in column ``value``; nulls are written."""
    return entries.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def catalog_csv(entries: DataFrame, path: str) -> None:
    """The eight catalogue columns with a header; values are quoted where they need it."""
    entries.select(*CSV_COLUMNS).write.option("header", True).option("escape", '"').csv(path)


def atf_entries(entries: DataFrame) -> DataFrame:
    """Entries as blocks of ``#atf:`` lines, with transliteration and translation where there are any, and an empty line."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    head = [F.concat(F.lit(f"#atf: {k}="), v) for k, v in (("corpus", F.coalesce("source_corpus", F.lit(""))), ("object", F.coalesce("object_id", F.lit(""))), ("period", text("period")), ("provenance", text("provenance")), ("genre", text("genre")))]
    body = [F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c))) for p, c in (("& ", "transliteration"), ("# translation: ", "translation"))]
    return entries.select(F.array_join(F.array_compact(F.array(*head, *body, F.lit(""))), "\n").alias("value"))


def atf_lines(tablets: DataFrame) -> DataFrame:
    """id, line_no, value: the tablet dialect, a transliteration split at ``. `` into numbered lines.

    Lines are numbered before empty ones are dropped, so that numbers may leave gaps.
    """
    pieces = F.split("transliteration", r"\. ", -1)
    numbered = F.filter(F.transform(pieces, lambda x, i: F.when(F.trim(x) != "", F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x)))), lambda x: x.isNotNull())
    head = F.array(
        F.concat(F.lit("&P"), F.col("id"), F.lit(" = "), F.coalesce("title", F.lit(""))), F.concat(F.lit("@tablet "), F.col("id")),
        F.concat(F.lit("@language "), F.lower(F.coalesce("language", F.lit("unknown")))), F.lit("@script cuneiform"),
    )
    rows = tablets.where("transliteration <> ''").select("id", F.posexplode(F.concat(head, numbered, F.array(F.lit("")))).alias("line_no", "value"))
    return rows


def jsonld_nodes(tablets: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """id and ``node``: a JSON-LD node a tablet, with a description of its embedding (tablet_id, model, dim) where there is one."""
    rows = tablets
    if embeddings is not None:
        rows = rows.join(embeddings.select(F.col("tablet_id").alias("id"), F.struct(F.lit("cuneiform:EmbeddingVector").alias("@type"), F.col("model").alias("cuneiform:model"), F.col("dim").alias("cuneiform:dimension")).alias("_emb")), "id", "left")
    fields = [
        F.concat(F.lit(BASE), F.col("id")).alias("@id"), F.array(F.lit("cuneiform:Tablet"), F.lit("schema:CreativeWork")).alias("@type"), F.col("id").alias("schema:identifier"),
        F.col("source").alias("dcterms:source"), F.col("title").alias("dcterms:title"), F.col("cuneiform").alias("cuneiform:cuneiformText"), F.col("transliteration").alias("cuneiform:transliteration"),
        F.col("language").alias("cuneiform:language"), F.col("period").alias("cuneiform:period"), F.col("genre").alias("cuneiform:genre"), F.col("myth_labels").alias("cuneiform:motifTags"),
    ]
    if embeddings is not None:
        fields.append(F.col("_emb").alias("cuneiform:hasEmbedding"))
    return rows.select("id", F.to_json(F.struct(*fields)).alias("node"))


def cytoscape_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element a node (id and any attributes) and an edge (source, target and any attributes)."""
    node = F.to_json(F.struct(F.struct(*[F.col(c) for c in nodes.columns]).alias("data"), F.lit("tablet").alias("classes")))
    edge_id = F.concat_ws("-", F.lit("e"), "source", "target").alias("id")
    edge = F.to_json(F.struct(F.struct(edge_id, *[F.col(c) for c in edges.columns]).alias("data")))
    return nodes.select(F.lit("node").alias("kind"), node.alias("element")).unionByName(edges.select(F.lit("edge").alias("kind"), edge.alias("element")))


def xml_text(value: Column) -> Column:
    """Text with the five special characters escaped; null counts as empty."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def graphml_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document in column ``value``, in the order of ``part``: header, nodes, edges, footer."""
    keys = [("node", c, t) for c, t in nodes.dtypes if c != "id"] + [("edge", c, t) for c, t in edges.dtypes if c not in ("source", "target")]
    kind = lambda t: "double" if t in ("double", "float") else "long" if t in ("int", "bigint") else "string"
    head = ["<?xml version='1.0' encoding='utf-8'?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{f}_{c}" for="{f}" attr.name="{c}" attr.type="{kind(t)}"/>' for f, c, t in keys] + ['<graph edgedefault="undirected">']
    data = lambda f, df, skip: [F.concat(F.lit(f'<data key="{f}_{c}">'), xml_text(F.col(c)), F.lit("</data>")) for c in df.columns if c not in skip]
    spark = nodes.sparkSession
    node = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('">'), *data("node", nodes, ("id",)), F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("source")), F.lit('" target="'), xml_text(F.col("target")), F.lit('">'), *data("edge", edges, ("source", "target")), F.lit("</edge>")).alias("value"))
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, value string")
    return ends.unionByName(node).unionByName(edge)


def deposition(tablets: DataFrame) -> DataFrame:
    """One JSON document with the number of records, and of different languages and genres, and counts by language and genre."""
    totals = tablets.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("language").alias("languages"), F.countDistinct("genre").alias("genres"))
    counts = lambda c: tablets.groupBy(F.coalesce(c, F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"by_{c}"))
    return totals.crossJoin(counts("language")).crossJoin(counts("genre")).select(F.to_json(F.struct("*")).alias("value"))  # one row each


def sign_documents(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """sign_id and ``value``: a JSON document a sign, with readings, counts and its context rules, at most ten, in order.

    ``catalog`` is made by ``readings.sign_catalog``, ``rules`` by ``readings.context_rules``.
    """
    listed = rules.groupBy(F.col("token").alias("sign_id")).agg(F.array_sort(F.collect_list(F.struct("place", "pattern", "probability"))).alias("context_rules"))
    joined = catalog.join(listed, "sign_id", "left")
    return joined.select("sign_id", F.to_json(F.struct(*[c for c in catalog.columns], F.coalesce("context_rules", F.array().cast("array<struct<place:int,pattern:string,probability:double>>")).alias("context_rules"))).alias("value"))


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Overwrite only the folders of the keys in the rows; the rest of the table stays."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Text files of ``value``, whose order over all files is that of the given columns."""
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    ordered.select("value").write.text(path)
