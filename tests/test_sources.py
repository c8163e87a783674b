import datetime as dt

import pytest
from pyspark.sql import functions as F

from fojas import fixed, schemas
from fojas.sources import cases as C, store
from fojas.sources import files, listings, prices

LINK = fixed.SHARE_HOST + "/index.php/s/abc"


def rows_of(spark, *cells):
    return spark.createDataFrame([("s", i + 2, list(c)) for i, c in enumerate(cells)], schemas.LISTING_CELLS)


@pytest.mark.parametrize(
    "cells, error",
    [
        (("Parte HL", "**Livianos**", "https://example.com/s/abc", "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", LINK.replace("https", "http"), "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", LINK + "/download", "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", LINK + "?x=1 y", "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", LINK + "?path=%2FA", "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", LINK + "?openfile=12", "1"), "unexpected link"),
        (("Parte HL", "**Livianos**", "", "1"), "no link"),
        (("Parte HL", "**Livianos**", "   ", "1"), "no link"),
        (("Parte HL", "** **", LINK, "1"), "no title"),
        ((fixed.CORPUS + " 61", "**Licencias**", LINK, "1"), "unexpected part"),
        (("", "**Licencias**", LINK, "1"), "unexpected part"),
        (("Parte 61", "**Licencias**", LINK), "columns"),
    ],
)
def test_bad_listing_rows(spark, cells, error):
    [row] = listings.listing_rows(rows_of(spark, cells)).collect()
    assert row["error"] == error


def test_listing_fields(spark):
    folder = LINK + "?dir=undefined&path=%2FBiblioteca%20Virtual%2F77&openfile=870251"
    got = {
        r["part"]: r
        for r in listings.listings(
            rows_of(
                spark, ("Parte", "Título", "btn", "orden"), ("Parte 129 ", "**Op.   extranjeros**\n aéreos ", LINK + "\n", "3"),
                ("Parte 77", "Obstáculos", folder, "2"), ("", "", " ", ""),
            )
        ).collect()
    }
    assert set(got) == {"129", "77"}
    assert (got["129"]["title"], got["129"]["download_url"], got["129"]["token"]) == ("Op. extranjeros aéreos", LINK + "/download", "abc")
    assert (got["77"]["folder"], got["77"]["file_id"], got["77"]["download_url"]) == ("/Biblioteca Virtual/77", "870251", None)


def test_duplicate_parts_and_failure(spark):
    rows = listings.listing_rows(rows_of(spark, ("Parte 61", "a", LINK, ""), ("Parte 61", "b", LINK, ""))).orderBy("row_no")
    assert [r["error"] for r in rows.collect()] == [None, "listed twice"]
    with pytest.raises(Exception, match="listed twice"):
        listings.require_valid(rows).collect()
    missing = listings.find_listings(spark.createDataFrame([("61",), ("99",)], "part STRING"), rows.filter("error IS NULL").drop("error"))
    assert {r["part"]: r["error"] for r in missing.collect()} == {"61": None, "99": "not listed"}


def test_csv_sheet_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(f'parte,titulo,btn-Ver,orden\nParte 61,"**Licencias ""x"",\n de piloto** ",{LINK},1\nParte 62,Corta,{LINK}\n', encoding="utf-8")
    rows = listings.read_sheet(spark, str(path))
    assert listings.header_errors(rows).count() == 0
    got = listings.listing_rows(rows).orderBy("row_no").collect()
    assert [(r["row_no"], r["title"], r["error"]) for r in got][0] == (2, 'Licencias "x", de piloto', None)
    assert (got[1]["row_no"], got[1]["error"]) == (3, "columns")


def test_sheet_id_and_folder_xml(spark):
    pages = spark.createDataFrame([("var c = {idSpread: 'Ab-9_'}",), ("nothing",)], "html STRING")
    assert [(r["sheet_id"], r["error"]) for r in listings.sheet_ids(pages).collect()] == [("Ab-9_", None), (None, "no sheet id in page")]
    xml = (
        '<?xml version="1.0"?><d:multistatus xmlns:d="DAV:" xmlns:oc="http://owncloud.org/ns"><d:response><d:href>/webdav/a/</d:href>'
        "<d:propstat><d:prop><oc:fileid>1</oc:fileid></d:prop></d:propstat></d:response><d:response><d:href>/webdav/a/b.pdf</d:href>"
        "<d:propstat><d:prop><oc:fileid>870251</oc:fileid></d:prop></d:propstat></d:response></d:multistatus>"
    )
    listed = spark.createDataFrame([("77", "870251"), ("78", "5"), ("61", None)], "part STRING, file_id STRING")
    folders = spark.createDataFrame([("77", xml), ("78", xml)], "part STRING, xml STRING")
    got = {r["part"]: (r["file_url"], r["error"]) for r in listings.folder_files(listed, folders).collect()}
    assert got == {"77": (fixed.SHARE_HOST + "/webdav/a/b.pdf", None), "78": (None, "file 5 not found in shared folder")}


def test_store_manifest_and_cache(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "61.pdf").write_bytes(b"%PDF-a")
    (land / "67.pdf").write_bytes(b"<html>")
    scanned = files.scan_files(spark, str(land))
    assert {r["part"]: r["error"] for r in scanned.collect()} == {"61": None, "67": "not a PDF"}
    root = str(tmp_path / "store")
    store.commit(scanned.withColumn("title", F.lit("t")).withColumn("share_url", F.lit("u")), root, "f1", dt.datetime(2026, 1, 1))
    stored = store.contents(spark, root)
    fetched = scanned.filter("error IS NULL").select("part", F.lit("t").alias("title"), F.lit("u").alias("share_url"), "sha256")
    empty = spark.createDataFrame([], "part STRING, title STRING, share_url STRING, sha256 STRING, fetched_at TIMESTAMP")
    now, later = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    assert [r["status"] for r in files.with_status(fetched, empty).collect()] == ["new"]
    manifest = files.next_manifest(fetched, empty, now)
    again = files.next_manifest(fetched.withColumn("title", F.lit("t2")), manifest, later)
    [row] = again.collect()
    assert (row["title"], row["fetched_at"]) == ("t2", now)
    changed = fetched.withColumn("sha256", F.lit("x"))
    assert [r["status"] for r in files.with_status(changed, manifest).collect()] == ["changed"]
    assert files.next_manifest(changed, manifest, later).collect()[0]["fetched_at"] == later
    assert files.fetch_totals(files.with_status(fetched, manifest)).collect()[0].asDict() == {"total": 1, "new": 0, "changed": 0, "unchanged": 1}
    newest = files.latest(manifest, stored)
    assert [r["part"] for r in newest.collect()] == ["61"]
    broken = stored.withColumn("content", F.lit(b"zz"))
    with pytest.raises(Exception, match="does not match"):
        files.latest(manifest, broken).collect()
    asked = spark.createDataFrame([("61", True), ("99", False)], "part STRING, offline BOOLEAN")
    got = {r["part"]: (r["from_cache"], r["error"]) for r in files.sourced(asked, fetched, newest).collect()}
    assert got == {"61": (True, None), "99": (False, "no download and no stored copy")}


def test_registry_uploads_each_version_once(spark):
    f = spark.createDataFrame([("61", "a"), ("61", "b"), ("67", "b")], "part STRING, sha256 STRING")
    registry = spark.createDataFrame([("a", "d1")], "sha256 STRING, doc_id STRING")
    new = files.unregistered(f, registry)
    assert [r["sha256"] for r in new.collect()] == ["b"]
    assert files.registered(registry, new.withColumn("doc_id", F.lit("d2"))).count() == 2


CASE = '{"id": "a", "question": "q", "expected_secciones": [{"parte": "61", "seccion": "61.1"}], "reference_answer": "r", "out_of_scope": false}'


@pytest.mark.parametrize(
    "line, error",
    [
        (CASE, None),
        ("{", "invalid JSON"),
        ("[1]", "not an object"),
        (CASE.replace('"id"', '"extra": 1, "id"'), "unknown keys"),
        (CASE.replace('"q"', '" "'), "question must be a non-empty string"),
        (CASE.replace('"q"', "5"), "question must be a non-empty string"),
        (CASE.replace("false", '"no"'), "out_of_scope must be true or false"),
        (CASE.replace('[{"parte": "61", "seccion": "61.1"}]', '["61.1"]'), "expected_secciones must be a list of sections"),
        (CASE.replace('"61.1"', '""'), "expected_secciones must be a list of sections"),
        (CASE.replace('[{"parte": "61", "seccion": "61.1"}]', "[]"), "expected sections do not fit the scope"),
        (CASE.replace("false", "true"), "expected sections do not fit the scope"),
    ],
)
def test_case_validation(spark, line, error):
    df = spark.createDataFrame([("f", 1, line)], "source STRING, at BIGINT, value STRING")
    assert C.case_rows(df).collect()[0]["error"] == error


def test_duplicate_cases_selection_and_append(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, CASE), ("f", 2, CASE)], "source STRING, at BIGINT, value STRING")
    rows = C.case_rows(df)
    assert sorted(str(r["error"]) for r in rows.collect()) == ["None", "duplicate case id"]
    valid = C.cases(rows)
    assert valid.collect()[0]["source"] == "owner"
    with pytest.raises(Exception, match="unknown case id nope"):
        C.select_cases(valid, spark.createDataFrame([("a",), ("nope",)], "id STRING")).collect()
    path = str(tmp_path / "cases")
    C.append_cases(valid, valid.filter("false"), path)
    back = C.cases(C.case_rows(C.read_lines(spark, path)))
    assert back.collect()[0]["expected"] == [("61", "61.1")]
    with pytest.raises(Exception, match="already exists"):
        C.append_cases(valid, back, path)


def test_replay(spark):
    cases = spark.createDataFrame([("a", "q"), ("b", "q2"), ("c", "q"), ("d", "q")], "id STRING, question STRING")
    rec = spark.createDataFrame([("a", "q", None), ("b", "q", None), ("c", "q", "boom")], "id STRING, question STRING, error STRING")
    assert {r["id"]: r["replay"] for r in C.replay_status(cases, rec).collect()} == {"a": "ok", "b": "changed", "c": "errored", "d": "missing"}
    reports = spark.createDataFrame([(5, ["retrieval"]), (3, ["retrieval"]), (5, ["answer"])], "schema_version INT, stages ARRAY<STRING>")
    assert [r["error"] is None for r in C.replayable(reports).collect()] == [True, False, False]
    versions = spark.createDataFrame([("61", "h1"), ("67", "h2")], "part STRING, content_hash STRING")
    loaded = spark.createDataFrame([("61", "h1"), ("67", "zz")], "part STRING, content_hash STRING")
    assert [r["part"] for r in C.version_mismatches(versions, loaded).collect()] == ["67"]


def test_prices_file(spark, tmp_path):
    path = tmp_path / "p.toml"
    path.write_text("[m-1]\ninput = 4\ncache_write = 5.0\ncache_read = 0.2\noutput = 20\n")
    assert prices.read_prices(spark, str(path)).collect()[0].asDict() == {"model": "m-1", "input": 4.0, "cache_write": 5.0, "cache_read": 0.2, "output": 20.0}
    assert prices.listed_prices(spark).count() == 4


def test_reports_are_read_as_they_are_written(spark, tmp_path):
    rows = [(5, ["retrieval"], i) for i in range(7)] + [(5, ["answer"], 9)]
    reports = spark.createDataFrame(rows, "schema_version INT, stages ARRAY<STRING>, n INT").withColumn(
        "cases", F.transform(F.sequence(F.lit(0), "n"), lambda i: F.struct(F.concat_ws("-", "n", i).alias("id"), F.lit("¿?").alias("question")))
    )
    C.write_report(reports.drop("n").coalesce(2), str(tmp_path / "runs"))
    back = C.read_reports(spark, str(tmp_path / "runs"))
    assert back.count() == 8 and back.filter("error IS NULL").count() == 7 and back.select("report").distinct().count() == 8
    assert {r.id for r in C.recorded_cases(back).collect()} == {f"{i}-{j}" for i in range(7) for j in range(i + 1)}
    (tmp_path / "one.json").write_text('{\n "schema_version": 5,\n "stages": ["retrieval"],\n "cases": []\n}')
    assert C.read_reports(spark, str(tmp_path / "one.json"), one_per_file=True).first()["error"] is None
