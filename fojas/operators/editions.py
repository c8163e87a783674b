"""Which content version of a part counts when: the manifest's history as validity intervals.

A version is a part's file by its content hash. The history has a row for each fetch (or each change), and
one without hash where a part left the listing. An interval runs from the fetch that brought a version to
the one that replaced it; content that comes back opens an interval of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas.operators import definitions as D


def intervals(history: DataFrame) -> DataFrame:
    """(part, sha256, fetched_at) to (part, content_hash, edition, valid_from, valid_to), valid_to null while it lasts.

    ``edition`` counts a part's versions from 1. Fetches that found the same content change nothing; of several at one
    time the last by hash counts. Rows without part or time are no fetches.
    """
    fetches = history.filter(F.col("part").isNotNull() & F.col("fetched_at").isNotNull())
    fetches = fetches.groupBy("part", "fetched_at").agg(F.max("sha256").alias("sha256"))
    order = Window.partitionBy("part").orderBy("fetched_at")
    before = F.lag("sha256").over(order)
    changes = fetches.withColumn("new", ~F.col("sha256").eqNullSafe(before)).filter("new")
    dated = changes.withColumn("valid_to", F.lead("fetched_at").over(order)).filter(F.col("sha256").isNotNull())
    edition = F.row_number().over(order)
    return dated.select("part", F.col("sha256").alias("content_hash"), edition.alias("edition"), F.col("fetched_at").alias("valid_from"), "valid_to")


def _holds(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def valid_at(versions: DataFrame, at=None) -> DataFrame:
    """The version of every part that is valid at a time; without one, the current one."""
    return versions.filter(F.col("valid_to").isNull() if at is None else _holds(F.lit(at).cast("timestamp")))


def as_of(rows: DataFrame, versions: DataFrame, at: str, unit: str = "DAY") -> DataFrame:
    """Rows with ``part`` and a time, each with the version of its part that was valid then, or none.

    A range join made an equi-join: a row meets only the versions that hold some of its own day (or other
    ``unit``), by (part, day). Which they are is found for the days that rows ask about, once each, so
    neither a much-asked part nor a long history multiplies the rows. Rows without part or time get nulls.
    """
    day = F.date_trunc(unit, F.col(at))
    own = rows.withColumn("day_", day)
    asked = own.filter(F.col("day_").isNotNull()).select("part", "day_").distinct()
    end = F.col("day_") + F.expr(f"INTERVAL 1 {unit}")
    near = asked.join(versions, "part").filter((F.col("valid_from") < end) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day_"))))
    near = near.select(*[F.col(c).alias(f"{c}_v") for c in ("part", "day_")], "content_hash", "edition", "valid_from", "valid_to")
    same = (F.col("part") == F.col("part_v")) & (F.col("day_") == F.col("day__v")) & _holds(F.col(at))
    return own.join(near, same, "left").drop("day_", "part_v", "day__v")


def restricted(corpus: dict[str, DataFrame], versions: DataFrame) -> dict[str, DataFrame]:
    """A parsed corpus that holds several editions of its parts, with only the given versions (content_hash).

    Pages, sections, references, definitions and the terms sections use are those of these versions alone;
    of several files that define one phrase the first counts.
    """
    wanted = versions.select("content_hash").distinct()
    kept = {name: df.join(wanted, "content_hash", "left_semi") for name, df in corpus.items()}
    if "section_terms" in kept:
        first = D.by_phrase(kept["definitions"]).select("phrase", F.col("content_hash").alias("def_hash"))
        kept["section_terms"] = kept["section_terms"].join(first, ["phrase", "def_hash"], "left_semi")
    return kept
