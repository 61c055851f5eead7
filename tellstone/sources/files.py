"""Files of many formats as rows: JSON, CSV, HTML, the transliteration format, archives, images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.functions import text as X

FRAGMENT_SCHEMA = "fragment_id string, kind string, transliteration string, translation string, metadata map<string,string>"
IMAGES = "*.{jpg,jpeg,png,tif,tiff}"


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files whose root is a list, an object with ``data`` or ``items``, or an object of records.

    Result: column ``record`` (variant). A record may hold fields of any type; ``text_field`` reads one as text.
    Files that can't be parsed give no rows.
    """
    roots = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("root"))
    inner = F.coalesce(F.try_variant_get("root", "$.data", "variant"), F.try_variant_get("root", "$.items", "variant"), F.col("root"))
    listed = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.map_values(F.try_variant_get(inner, "$", "map<string,variant>")))
    return roots.where("root is not null").select(F.explode(listed).alias("record"))


def text_field(record: Column, name: str) -> Column:
    """A field that may be text or a list of texts, joined by blanks; null where it is missing."""
    return F.coalesce(F.array_join(F.try_variant_get(record, f"$.{name}", "array<string>"), " "), F.try_variant_get(record, f"$.{name}", "string"))


def html_links(pages: DataFrame, marker: str = "text=c", most: int = 5) -> DataFrame:
    """url, place, link_id, label: the first links of each page (url, html) whose address has the marker and that have a label.

    The id is what follows the last ``text=``. Null pages have no links.
    """
    marked = F.regexp_extract_all("html", F.lit(rf"(?is)<a\s[^>]*href=\"([^\"]*{marker}[^\"]*)\"[^>]*>(?:(?!</a>).)*?[^<>\s](?:(?!</a>).)*</a>"), F.lit(0))
    rows = pages.select("url", F.posexplode(F.slice(marked, 1, most)).alias("place", "a"))
    address = F.regexp_extract("a", r"(?is)href=\"([^\"]*)\"", 1)
    label = F.trim(F.regexp_replace("a", r"(?is)<[^>]*>", ""))
    return rows.select("url", "place", F.substring_index(address, "text=", -1).alias("link_id"), label.alias("label")).where("label <> ''")


def parsed_atf(content: Column) -> Column:
    """metadata (map), transliteration and translation of text in the ``#atf:`` dialect.

    ``#atf: key=value`` lines give metadata, the last of equal keys counts and a line without ``=`` none; ``&`` lines are
    joined by blanks; the last ``# translation:`` line counts.
    """
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n", -1), F.trim)
    pairs = F.filter(lines, lambda x: x.startswith("#atf:") & F.contains(x, F.lit("=")))
    key = lambda x: F.trim(F.substring_index(F.substring(x, 6, 1 << 30), "=", 1))
    entries = F.transform(pairs, lambda x: F.struct(key(x).alias("k"), F.trim(F.regexp_replace(x, r"^#atf:[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))
    said = F.filter(lines, lambda x: x.startswith("# translation:"))
    return F.struct(
        F.map_from_entries(last).alias("metadata"),
        F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("&")), lambda x: F.trim(F.substring(x, 2, 1 << 30))), " ").alias("transliteration"),
        F.when(F.size(said) > 0, F.trim(F.regexp_replace(F.element_at(said, -1), r"^# translation:", ""))).otherwise("").alias("translation"),
    )


def atf_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of files in the ``#atf:`` dialect, one a file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), parsed_atf(F.col("value")).alias("p"))
    return rows.select(F.regexp_extract("file", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1).alias("fragment_id"), F.lit("atf").alias("kind"), "p.transliteration", "p.translation", "p.metadata")


def csv_fragments(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Fragments of CSV files with a header, one a row; all other columns become metadata. Nothing is inferred."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    known = {"transliteration", "translation"}
    fragment = F.col(f"`{id_column}`") if id_column else F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))
    rest = [c for c in rows.columns if c not in known]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in rest]), lambda e: e["v"].isNotNull())
    text = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(fragment.alias("fragment_id"), F.lit("csv").alias("kind"), text("transliteration").alias("transliteration"), text("translation").alias("translation"), F.map_from_entries(pairs).alias("metadata"))


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".atf", ".txt", ".csv", ".json")) -> DataFrame:
    """archive, name, content of the text members of ZIP files. Members of other kinds are left out, damaged archives have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if name.lower().endswith(suffixes):
                                yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name).decode("utf-8", "replace")]})
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, name string, content string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """image_path, tablet_id, entry_id of image files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).load(path).select("path")
    stem = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return files.select(F.col("path").alias("image_path"), X.tablet_id_of(F.col("path")).alias("tablet_id"), F.pmod(F.xxhash64(stem), F.lit(1_000_000)).alias("entry_id"))


def checksums(spark: SparkSession, path: str, expected: dict[str, str] | None = None) -> DataFrame:
    """file, sha256 and ok of the files of a folder; ok is null where nothing is expected."""
    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    want = spark.createDataFrame(list((expected or {}).items()), "file string, want string")
    return rows.join(F.broadcast(want), "file", "left").select("file", "sha256", (F.col("sha256") == F.col("want")).alias("ok"))


def migrated(legacy: DataFrame) -> DataFrame:
    """Rows of the older table (id, bron, titel, cuneiform, transliteratie) as tablets, each content once with the smallest id.

    Sentinel texts count as none: ``n.n.b.`` and those that say ``Zie Oxford``; a row with neither text is left out.
    """
    real = lambda c: F.when((F.trim(c) != "n.n.b.") & ~F.contains(c, F.lit("Zie Oxford")), X.printable_text(F.col(c)))
    rows = legacy.select(F.col("id").alias("old"), F.col("bron").alias("source"), F.col("titel").alias("title"), F.coalesce(real("cuneiform"), F.lit("")).alias("cuneiform"), F.coalesce(real("transliteratie"), F.lit("")).alias("transliteration"))
    rows = rows.where("cuneiform <> '' or transliteration <> ''").withColumn("content_hash", X.content_hash(F.col("cuneiform"), F.col("transliteration")))
    kept = rows.groupBy("content_hash").agg(F.min_by(F.struct("source", "title", "cuneiform", "transliteration"), "old").alias("r")).select("content_hash", "r.*")
    c = F.col
    return kept.select(
        F.concat(F.lit("LEGACY-"), c("content_hash")).alias("id"), "source", "title", "cuneiform", "transliteration", X.language_of(c("cuneiform"), c("transliteration")).alias("language"),
        X.period_of(c("source"), c("title")).alias("period"), X.genre_of(c("title"), c("transliteration")).alias("genre"), X.myth_labels(F.concat_ws(" ", "title", "transliteration")).alias("myth_labels"), "content_hash",
    )


def demo_catalog(spark: SparkSession, n: int = 200) -> DataFrame:
    """A made-up catalogue of n entries that cycles through periods, places, kinds and languages."""
    cyc = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("id"), F.lit(len(values))) + 1).cast("int"))
    rows = spark.range(n).select(
        (F.col("id") + 1).alias("id"), F.lit("demo").alias("corpus_id"), F.format_string("P%06d", F.col("id") + 1).alias("object_id"), cyc(["ED", "OLD_AKKADIAN", "URIII", "OB", "MB", "NA", "NB", "LB", "ACH"]).alias("period"),
        cyc(["Ur", "Uruk", "Nippur", "Sippar", "Lagash", "Nineveh", "Babylon", "Assur"]).alias("provenance"), cyc(["Letter", "Hymn", "Lexical", "Administrative", "Literary", "Legal", "Ritual"]).alias("genre"),
        cyc(["Sumerian", "Akkadian"]).alias("language"), F.lit("DEMO").alias("source_corpus"),
    )
    return rows.withColumn("title", F.concat_ws(" ", "genre", F.lit("from"), "provenance"))
