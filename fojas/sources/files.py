"""Landed files and their content versions against a manifest; ``sources.store`` keeps both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fojas import fixed


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder whose names are ``<part>.pdf``: part, path, content, sha256, error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return hashed(raw.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("part"), "path", "content"))


def hashed(files: DataFrame) -> DataFrame:
    """Content hash of every file; ``error`` where the content is not a PDF."""
    magic = F.substring("content", 1, len(fixed.PDF_MAGIC)).cast("string")
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn(
        "error", F.when(magic != fixed.PDF_MAGIC, "not a PDF")
    )


def with_status(fetched: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fetched parts (part, title, share_url, sha256) as new, changed or unchanged by content hash."""
    known = manifest.select("part", F.col("sha256").alias("previous"))
    status = (
        F.when(F.col("previous").isNull(), "new")
        .when(F.col("previous") == F.col("sha256"), "unchanged")
        .otherwise("changed")
    )
    return fetched.join(known, "part", "left").withColumn("status", status).drop("previous")


def next_manifest(fetched: DataFrame, manifest: DataFrame, now) -> DataFrame:
    """The manifest after a fetch. Only new and changed content moves ``fetched_at``; title and link
    always follow the listing; parts that were not fetched keep their row."""
    new = fetched.select("part", *[F.col(c).alias(f"new_{c}") for c in ("title", "share_url", "sha256")])
    both = manifest.join(new, "part", "full_outer")
    same = F.col("sha256").eqNullSafe(F.col("new_sha256")) | F.col("new_sha256").isNull()
    return both.select(
        "part", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("title", "share_url", "sha256")],
        F.when(same, F.col("fetched_at")).otherwise(F.lit(now).cast("timestamp")).alias("fetched_at"),
    )


def fetch_totals(statuses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many parts are new, changed and unchanged."""
    return statuses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged")],
    )


def latest(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Newest stored version per part; fails when content no longer matches its hash.

    A listing restored from the manifest has no folder or file id.
    """
    joined = manifest.join(stored, ["part", "sha256"])
    intact = F.sha2("content", 256) == F.col("sha256")
    checked = F.when(intact, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("stored content does not match its hash: part "), "part")).cast("binary")
    )
    return joined.select("part", "title", "share_url", "sha256", checked.alias("content"))


def sourced(requested: DataFrame, fetched: DataFrame, cached: DataFrame) -> DataFrame:
    """Each requested part from its fresh download, else from the newest stored copy, else an error.

    ``requested``: part, offline (the part's fetch was not tried or failed). ``fetched`` and
    ``cached``: part, title, share_url, sha256.
    """
    fields = ("title", "share_url", "sha256")
    fresh = fetched.select("part", F.struct(*fields).alias("fresh"))
    kept = cached.select("part", F.struct(*fields).alias("kept"))
    joined = requested.join(fresh, "part", "left").join(kept, "part", "left")
    usable = F.when(~F.col("offline"), F.col("fresh"))
    chosen = F.coalesce(usable, F.col("kept"))
    return joined.select(
        "part", *[chosen[f].alias(f) for f in fields], (usable.isNull() & F.col("kept").isNotNull()).alias("from_cache"),
        F.when(chosen.isNull(), "no download and no stored copy").alias("error"),
    )


def unregistered(files: DataFrame, registry: DataFrame, keys: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """Content versions the registry has no document for, once each: what must be uploaded or indexed."""
    return files.join(registry, list(keys), "left_anti").dropDuplicates(list(keys))


def registered(registry: DataFrame, added: DataFrame) -> DataFrame:
    """The registry with documents added for versions it did not have."""
    return registry.unionByName(added.select(*registry.columns))
