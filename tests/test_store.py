"""Commits to the content store, whatever happens between their steps, and the manifest read back."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fojas.sources import files, store

DAYS = [dt.datetime(2026, 3, d) for d in (1, 2, 3, 4)]
LANDED = "part STRING, path STRING, title STRING, share_url STRING, content BINARY"


def landed(spark, rows):
    """(part, content[, title]) as a fetch."""
    return files.hashed(spark.createDataFrame([(r[0], f"{i}", r[2] if len(r) > 2 else "t", "u", b"%PDF-" + r[1]) for i, r in enumerate(rows)], LANDED))


def sha(content):
    return hashlib.sha256(b"%PDF-" + content).hexdigest()


def state(spark, root):
    held = sorted((r.part, bytes(r.content)[5:]) for r in store.contents(spark, root).collect())
    rows = sorted((r.part, r.sha256, r.title, r.fetched_at) for r in store.manifest(spark, root).collect())
    return held, rows


def test_versions_statuses_and_times(spark, tmp_path):
    root = str(tmp_path)
    assert state(spark, root) == ([], [])
    said = lambda df: sorted((r.part, r.status) for r in df.collect())
    assert said(store.commit(landed(spark, [("61", b"a"), ("61", b"a"), ("67", b"b")]), root, "f1", DAYS[0])) == [("61", "new"), ("67", "new")]
    assert said(store.commit(landed(spark, [("61", b"c", "t2"), ("67", b"b", "t3")]), root, "f2", DAYS[1])) == [("61", "changed"), ("67", "unchanged")]
    held, rows = state(spark, root)
    assert held == [("61", b"a"), ("61", b"c"), ("67", b"b")]
    assert rows == [("61", sha(b"c"), "t2", DAYS[1]), ("67", sha(b"b"), "t3", DAYS[0])]
    # what was there before comes back: not stored again, but a change
    assert said(store.commit(landed(spark, [("61", b"a")]), root, "f3", DAYS[2])) == [("61", "changed")]
    held, rows = state(spark, root)
    assert len(held) == 3 and rows[0] == ("61", sha(b"a"), "t", DAYS[2])
    assert {r.part: r.sha256 for r in store.manifest(spark, root, DAYS[1]).collect()}["61"] == sha(b"c")
    newest = files.latest(store.manifest(spark, root), store.contents(spark, root))
    assert {(r.part, bytes(r.content)[5:]) for r in newest.collect()} == {("61", b"a"), ("67", b"b")}


@pytest.mark.parametrize("crash", ["before", "in contents", "staged", "done"])
def test_a_crash_in_any_place_stores_once(spark, tmp_path, crash):
    root = str(tmp_path)
    store.commit(landed(spark, [("61", b"a")]), root, "f1", DAYS[0])
    before = state(spark, root)
    fetch = landed(spark, [("61", b"b"), ("67", b"x"), ("67", b"x")])
    if crash == "in contents":
        fetch.limit(1).select("part", "sha256", "content").write.parquet(f"{root}/contents/commit=f2")
    elif crash != "before":
        store.stage(fetch, root, "f2")
    if crash == "done":
        store.finish(spark, root, "f2", DAYS[1])
    else:
        assert state(spark, root) == before  # nothing of it shows
    for _ in range(2):
        said = store.commit(fetch, root, "f2", DAYS[1])
        assert sorted((r.part, r.status) for r in said.collect()) == [("61", "changed"), ("67", "new")]
    held, rows = state(spark, root)
    assert held == [("61", b"a"), ("61", b"b"), ("67", b"x")] and [r[0] for r in rows] == ["61", "67"]


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path)
    for name in ("a", "b"):
        store.stage(landed(spark, [("61", b"a")]), root, name)
    for name in ("b", "a"):
        store.finish(spark, root, name, DAYS[0])
    held, rows = state(spark, root)
    assert held == [("61", b"a")] and len(rows) == 1


def test_unusable_files_and_names(spark, tmp_path):
    root = str(tmp_path)
    bad = spark.createDataFrame([("61", "1", "t", "u", bytearray(b"<html>")), (None, "2", "t", "u", bytearray(b"%PDF-a")), ("62", "3", "t", "u", None)], LANDED)
    extra = files.hashed(bad).withColumn("commit", F.lit("x")).withColumn("at", F.lit(1))
    assert store.commit(extra, root, "f1", DAYS[0]).count() == 0 and state(spark, root) == ([], [])
    assert store.commits(spark, root).count() == 1
    with pytest.raises(ValueError, match="must consist of"):
        store.commit(extra, root, "../f2", DAYS[0])


def test_numbers_as_names_stay_text(spark, tmp_path):
    root = str(tmp_path)
    for i, name in enumerate(("007", "7", "2026-03-01")):
        store.commit(landed(spark, [("61", name.encode())]), root, name, DAYS[i])
    assert sorted(r.commit for r in store.commits(spark, root).collect()) == ["007", "2026-03-01", "7"]
    assert len(state(spark, root)[0]) == 3


def test_a_store_of_files_is_taken_over(spark, tmp_path):
    old, root = tmp_path / "old", str(tmp_path / "new")
    for part, content in (("61", b"a"), ("61", b"b"), ("67", b"c")):
        (old / part).mkdir(parents=True, exist_ok=True)
        (old / part / f"{sha(content)}.pdf").write_bytes(b"%PDF-" + content)
    (old / "67" / f"{'0' * 64}.pdf").write_bytes(b"%PDF-z")
    entry = lambda h: {"titulo": "T", "share_url": "u", "sha256": h, "fetched_at": "2026-02-01T10:00:00+00:00"}
    (old / "manifest.json").write_text(json.dumps({"61": entry(sha(b"b")), "67": entry(sha(b"c"))}))
    (old / "none.json").write_text("{}")
    assert store.read_manifest(spark, str(old / "none.json")).count() == 0
    listed = store.read_manifest(spark, str(old / "manifest.json"))
    assert {(r.part, r.title, r.fetched_at) for r in listed.collect()} == {(p, "T", dt.datetime(2026, 2, 1, 10)) for p in ("61", "67")}
    found = store.scan_store(spark, str(old))
    assert [r.part for r in found.filter("error IS NOT NULL").collect()] == ["67"]
    current = found.join(listed.select("part", "sha256", "title", "share_url"), ["part", "sha256"])
    older = found.join(listed, ["part", "sha256"], "left_anti").withColumn("title", F.lit("T")).withColumn("share_url", F.lit("u"))
    store.commit(older, root, "older", dt.datetime(2026, 1, 1))
    store.commit(current, root, "current", dt.datetime(2026, 2, 1, 10))
    held, rows = state(spark, root)
    assert held == [("61", b"a"), ("61", b"b"), ("67", b"c")]
    assert rows == sorted((r.part, r.sha256, r.title, r.fetched_at) for r in listed.collect())
