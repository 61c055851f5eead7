import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tellstone.api import Archive
from tellstone.operators import corrections
from tellstone.sinks import exports
from tellstone.sources import files, paged, tables
from tellstone.streaming import incremental


def test_json_roots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"id": 1, "cuneiform": ["𒀭", "𒂗"]}, {"id": 2, "cuneiform": "𒀭"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    (tmp_path / "c.json").write_text(json.dumps({"x": {"id": 4}, "y": {"id": 5}}))
    (tmp_path / "d.json").write_text("{broken")
    rows = files.json_records(spark, str(tmp_path)).select(F.try_variant_get("record", "$.id", "int").alias("id"), files.text_field(F.col("record"), "cuneiform").alias("c")).collect()
    assert {r["id"]: r["c"] for r in rows} == {1: "𒀭 𒂗", 2: "𒀭", 3: None, 4: None, 5: None}


def test_links(spark):
    html = '<a href="x?text=c.1.1">One</a> <a href="y">no</a><a class="k" href="x?a=text=c.2"><b>Two</b></a><a href="x?text=c.3"> </a>'
    rows = files.html_links(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).collect()
    assert [(r["link_id"], r["label"]) for r in rows] == [("c.1.1", "One"), ("c.2", "Two")]


def test_atf(spark, tmp_path):
    content = "#atf: period=OB\n#atf: period = NA\n#atf: bad\n& lugal e2\n& gal\n# translation: first\n# translation: last"
    p = spark.createDataFrame([(content,), (None,)], "t string").select(files.parsed_atf(F.col("t")).alias("p")).select("p.*").collect()
    assert p[0]["metadata"] == {"period": "NA"} and p[0]["transliteration"] == "lugal e2 gal" and p[0]["translation"] == "last"
    assert p[1]["transliteration"] == "" and p[1]["metadata"] == {}
    (tmp_path / "frag1.atf").write_text(content)
    assert files.atf_fragments(spark, str(tmp_path)).first()["fragment_id"] == "frag1"


def test_csv_zip_images_checksums(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ID,transliteration,note\n1,"a, ""b""",x\n2,,\n')
    rows = files.csv_fragments(spark, str(tmp_path / "f.csv"), "ID").orderBy("fragment_id").collect()
    assert rows[0]["transliteration"] == 'a, "b"' and rows[0]["metadata"] == {"ID": "1", "note": "x"} and rows[1]["transliteration"] is None
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.atf", "& a")
        z.writestr("b.png", b"\x89")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    assert [(r["name"], r["content"]) for r in files.zip_members(spark, str(tmp_path)).collect()] == [("in/a.atf", "& a")]
    (tmp_path / "CDLI-P000001.png").write_bytes(b"x")
    image = files.images(spark, str(tmp_path)).first()
    assert image["tablet_id"] == "CDLI-P000001" and 0 <= image["entry_id"] < 1_000_000
    got = {r["file"]: r["ok"] for r in files.checksums(spark, str(tmp_path / "CDLI-P000001.png"), {"CDLI-P000001.png": "0"}).collect()}
    assert got == {"CDLI-P000001.png": False}


def test_paged_service(spark, tmp_path):
    for at in (0, 2):
        (tmp_path / f"{at}.json").write_text(json.dumps({"rows": [{"n": at}, {"n": at + 1}]}))
    paged.register(spark)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{offset}}.json").option("rows", 4).option("length", 2).load()
    assert sorted(json.loads(r["record"])["n"] for r in df.collect()) == [0, 1, 2, 3]


def test_legacy_and_demo(spark):
    legacy = spark.createDataFrame([(1, "OB", "Letter", "𒀭", "a"), (2, "OB", "Letter", "𒀭", "a"), (3, "x", "y", "n.n.b.", "Zie Oxford website"), (4, None, None, None, "b")], "id int, bron string, titel string, cuneiform string, transliteratie string")
    rows = files.migrated(legacy).orderBy("transliteration").collect()
    assert [(r["transliteration"], r["genre"]) for r in rows] == [("a", "Administrative"), ("b", "Unknown")]
    assert files.demo_catalog(spark, 21).where("period = 'ED'").count() == 3


def test_guarded_table(spark, tmp_path):
    assert tables.table_or_empty(spark, str(tmp_path), "none", "a int").count() == 0


def test_exports(spark, tmp_path):
    entries = spark.createDataFrame([("c", 'o,1 "q"', "T", "OB", None, "g", "l", "S", "a b", None)], ", ".join(f"{c} string" for c in [*exports.CSV_COLUMNS, "transliteration", "translation"]))
    exports.catalog_csv(entries, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["object_id"] == 'o,1 "q"' and back["provenance"] is None
    assert exports.atf_entries(entries).first()["value"].split("\n")[3:] == ["#atf: provenance=unknown", "#atf: genre=g", "& a b", ""]
    assert json.loads(exports.jsonl(entries).first()["value"])["provenance"] is None
    tablets = spark.createDataFrame([("t1", "T", "a b. . c", None), ("t2", "T", "", "x")], "id string, title string, transliteration string, language string")
    assert [r["value"] for r in exports.atf_lines(tablets).orderBy("line_no").collect()] == ["&Pt1 = T", "@tablet t1", "@language unknown", "@script cuneiform", "1. a b", "3. c", ""]
    nodes = spark.createDataFrame([("a<", "x & y")], "id string, title string")
    edges = spark.createDataFrame([("a<", "b", 0.5)], "source string, target string, weight double")
    exports.write_lines(exports.graphml_parts(nodes, edges), str(tmp_path / "g"), "part")
    import xml.etree.ElementTree as ET

    text = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert len(list(ET.fromstring(text).iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 1
    kinds = [json.loads(r["element"])["data"] for r in exports.cytoscape_elements(nodes, edges).collect()]
    assert kinds[1]["id"] == "e-a<-b"
    exports.replace_keys(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), str(tmp_path / "p"), "k")
    exports.replace_keys(spark.createDataFrame([(3, "a")], "v int, k string"), str(tmp_path / "p"), "k")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [2, 3]


def log(spark, rows):
    return spark.createDataFrame([(c, a, "AN", "KI", "an", "t", 1.0, f"2024-01-01 00:00:0{s}", s) for c, a, s in rows], corrections.SCHEMA.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


def test_correction_states_and_stream(spark, tmp_path):
    first = log(spark, [("1", "submit", 1), ("2", "submit", 2), ("2", "approve", 3), ("3", "approve", 1), ("4", "shrug", 1)])
    assert {r["correction_id"]: r["state"] for r in corrections.states(first).collect()} == {"1": "pending", "2": "applied", "3": "applied"}
    assert tuple(corrections.stats(corrections.states(first)).first()) == (3, 1, 2, 0)
    assert [r["correction_id"] for r in corrections.pending(corrections.states(first)).collect()] == ["1"]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in (first, log(spark, [("1", "reject", 5)])):
        batch.write.mode("append").parquet(source)
        incremental.append_corrections(incremental.stream_of(spark, source, corrections.SCHEMA), out, check)
    assert {r["correction_id"]: r["state"] for r in incremental.current_states(spark, out).collect()} == {"1": "rejected", "2": "applied", "3": "applied"}


def test_motif_stream(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in ([("a", "flood flood")], [("b", "the flood")]):
        spark.createDataFrame(rows, "text_id string, full string").write.mode("append").parquet(source)
        incremental.count_motifs(incremental.stream_of(spark, source, "text_id string, full string"), out, check)
    row = incremental.motif_totals(spark, out).where("motif_id = 'MOTIF-FLOOD'").first()
    assert (row["n_texts"], row["n"]) == (2, 3)


def test_windowed_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 05:00:00", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    counts = incremental.windowed_counts(incremental.stream_of(spark, source, "ts timestamp, event_type string"))
    counts.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["kind"], r["n"]) for r in spark.table("windows").collect()] == [("a", 2)]  # the last window is still open


def test_archive(spark, folder, tmp_path):
    archive = Archive(spark, folder)
    assert archive.search_corpus("letter", limit=5).count() <= 5
    assert archive.signs(["wedge"], min_confidence=0.5).where("sign_type <> 'wedge' or confidence < 0.5").count() == 0
    sign = archive.knowledge().first()["sign_id"]
    posterior = archive.disambiguate(sign, ["EN"], 1000).agg(F.sum("posterior")).first()[0]
    assert posterior == pytest.approx(1, abs=1e-4)
    sequence = archive.disambiguate_sequence([sign, "NOT-A-SIGN"]).collect()
    assert len(sequence) == 2 and sequence[1]["reading"] is None
    path = str(tmp_path / "log")
    archive.submit_correction(path, "c1", sign, "x", "r")
    archive.approve_correction(path, "c1")
    archive.submit_correction(path, "c2", sign, "x", "r")
    archive.reject_correction(path, "c2")
    assert {r["correction_id"]: r["state"] for r in archive.corrections(path).collect()} == {"c1": "applied", "c2": "rejected"}
    checks, status = archive.health()
    assert checks.count() == 10 and status.first()["status"] in ("pass", "warn", "fail")
    assert sum(len(b) for b in archive.stream_catalog(size=30)) == archive.catalog().count()
    archive.export_catalog(str(tmp_path / "out"), "jsonl", source="CDLI")
    assert all(json.loads(r["value"])["source_corpus"] == "CDLI" for r in spark.read.text(str(tmp_path / "out")).collect())
