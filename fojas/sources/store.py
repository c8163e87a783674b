"""The content store: every version of every part by content hash, and the manifest of what fetches found.

A commit carries the name of its fetch. It writes the new contents and the fetch's rows to folders of that
name, over what an attempt that crashed left there, and last the one row that makes them count. Readers go
by those rows alone: a crashed commit shows nothing, run again it stores once, and once done it does nothing
more. Nothing is ever rewritten, so versions that were replaced stay. A name belongs to one writer at a time.
Two fetches that land one new version at the same time may both write it; it counts once, as the smaller name's.

    contents/commit=NAME   part, sha256, content
    fetches/commit=NAME    part, title, share_url, sha256
    commits/commit=NAME    at (one row)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fojas.operators import editions as E
from fojas.sources.tables import folder_name, read_or_empty, replaced

CONTENTS = "part STRING, sha256 STRING, content BINARY"
FETCHES = "part STRING, title STRING, share_url STRING, sha256 STRING"
COMMITS = "at TIMESTAMP"
STORED_ENTRY = "titulo: STRING, share_url: STRING, sha256: STRING, fetched_at: TIMESTAMP"  # of a manifest kept as JSON


def _done(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    rows = read_or_empty(spark, f"{root}/{table}", f"{schema}, commit STRING")
    return rows.join(commits(spark, root), "commit")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Commits that are done: commit, at."""
    return read_or_empty(spark, f"{root}/commits", f"{COMMITS}, commit STRING")


def fetches(spark: SparkSession, root: str) -> DataFrame:
    """What every fetch found: commit, part, title, share_url, sha256, at."""
    return _done(spark, root, "fetches", FETCHES)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The content versions held and the commit that holds each: part, sha256, commit. No content is read."""
    return _done(spark, root, "contents", CONTENTS).groupBy("part", "sha256").agg(F.min("commit").alias("commit"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """Every content version once: part, sha256, content."""
    rows = read_or_empty(spark, f"{root}/contents", f"{CONTENTS}, commit STRING")
    return rows.join(versions(spark, root), ["part", "sha256", "commit"], "left_semi").drop("commit")


def stage(files: DataFrame, root: str, name: str) -> None:
    """Write a fetch's new contents and its rows, which do not count until ``finish``.

    ``files``: part, path (of its own for every file), title, share_url, sha256, content, error; files with an error
    and those without part or hash are left out. Copies of one version are stored once. Where a part was fetched
    with several contents all are stored, and its row has the one of the greatest hash.
    """
    spark, name = files.sparkSession, folder_name(name)
    good = files.filter("error IS NULL AND part IS NOT NULL AND sha256 IS NOT NULL")
    # keys first, without contents: which files bring a version that is not held
    held = versions(spark, root).filter(F.col("commit") != name)
    new = good.groupBy("part", "sha256").agg(F.min("path").alias("path")).join(held, ["part", "sha256"], "left_anti")
    replaced(good.join(new, ["part", "sha256", "path"], "left_semi").select("part", "sha256", "content"), f"{root}/contents/commit={name}", CONTENTS)
    row = F.max(F.struct("sha256", "title", "share_url")).alias("r")
    replaced(good.groupBy("part").agg(row).select("part", "r.title", "r.share_url", "r.sha256"), f"{root}/fetches/commit={name}", FETCHES)


def finish(spark: SparkSession, root: str, name: str, at: dt.datetime) -> None:
    """Make a staged fetch count, as of a time."""
    row = spark.range(1).select(F.lit(at).cast("timestamp").alias("at"))
    replaced(row.coalesce(1), f"{root}/commits/commit={folder_name(name)}", COMMITS)


def commit(files: DataFrame, root: str, name: str, at: dt.datetime) -> DataFrame:
    """Store a fetch and say what each part's content is: part, sha256, status (new, changed, unchanged).

    Repeated in any state, also after a crash, it stores once and says the same.
    """
    spark = files.sparkSession
    if commits(spark, root).filter(F.col("commit") == folder_name(name)).isEmpty():
        stage(files, root, name)
        finish(spark, root, name, at)
    return statuses(spark, root).filter(F.col("commit") == name).select("part", "sha256", "status")


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """Every fetch of every part as new, changed or unchanged against the fetch before: commit, part, at, sha256, status."""
    before = F.lag("sha256").over(Window.partitionBy("part").orderBy("at", "commit"))
    status = F.when(before.isNull(), "new").when(before == F.col("sha256"), "unchanged").otherwise("changed")
    return fetches(spark, root).select("commit", "part", "at", "sha256", status.alias("status"))


def manifest(spark: SparkSession, root: str, at: dt.datetime | None = None) -> DataFrame:
    """The parts with their current version, or the one of a time: part, title, share_url, sha256, fetched_at.

    Title and link are those of the last fetch; ``fetched_at`` is when the version that it found came. Of fetches at
    one time the greatest hash counts.
    """
    rows = fetches(spark, root)
    if at is not None:
        rows = rows.filter(F.col("at") <= F.lit(at).cast("timestamp"))
    last = rows.groupBy("part").agg(F.max_by(F.struct("title", "share_url", "sha256"), F.struct("at", "sha256", "commit")).alias("r"))
    now = E.valid_at(E.intervals(rows.select("part", "sha256", F.col("at").alias("fetched_at"))))
    since = now.select("part", F.col("valid_from").alias("fetched_at"))
    return last.select("part", "r.*").join(since, "part")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest kept as one JSON object by part, in the columns of ``manifest``; an empty file has no parts."""
    entries = F.from_json("value", f"MAP<STRING, STRUCT<{STORED_ENTRY}>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("part", "e"))
    return rows.select("part", F.col("e.titulo").alias("title"), "e.share_url", "e.sha256", "e.fetched_at")


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """Files kept as ``<part>/<sha256>.pdf``: part, path, sha256 (of the content), content, error.

    A file whose content is not that of its name has an error.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    named = lambda n: F.regexp_extract("path", r"([^/]+)/([0-9a-f]{64})\.pdf$", n)
    rows = raw.select(named(1).alias("part"), "path", F.sha2("content", 256).alias("sha256"), "content", named(2).alias("name"))
    return rows.withColumn("error", F.when(F.col("name") != F.col("sha256"), "stored content does not match its hash")).drop("name")
