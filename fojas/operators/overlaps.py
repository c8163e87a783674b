"""Joins of ranges with ranges, as equi-joins: no range is written out as its members.

A range belongs to the level at which it touches two bins at most, bins of level L being 2 ** L wide. Two
ranges that overlap do so in a bin of the larger one's level, so each side is put into the bins of its
own level and of the other side's larger levels under the same keys. A range of any length thus takes two
rows for each level that occurs there, of which there are as many as the lengths have binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(first: Column, last: Column) -> Column:
    return F.when(last > first, F.length(F.bin((last - first).cast("bigint")))).otherwise(0)


def _bin(place: Column, level: Column) -> Column:
    """Which bin of a level a place from 0 lies in."""
    return F.call_function("shiftright", place.cast("bigint"), level)


def _levels(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_set(f"level{side}").alias("others"))


def _binned(rows: DataFrame, levels: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows once for each bin of their own level and of the other side's larger ones."""
    own = F.col(f"level{side}")
    wanted = F.array_union(F.array(own), F.filter("others", lambda x: x > own))
    rows = rows.join(levels, keys).withColumn("level", F.explode(wanted)).drop("others")
    return rows.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"first{side}"), F.col("level")), _bin(F.col(f"last{side}"), F.col("level")))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose ranges (first and last place, from 0, both inside) overlap.

    Each pair comes once: in the bin where the overlap begins. Rows with a null key, a null end or an
    empty range overlap nothing. Columns of the sides other than the keys must have different names.
    """

    def prepared(df: DataFrame, ends: tuple[str, str], side: str) -> DataFrame:
        first, last = (F.col(c).cast("bigint") for c in ends)
        df = df.filter((first >= 0) & (first <= last)).withColumns({f"first{side}": first, f"last{side}": last})
        return df.withColumn(f"level{side}", _level(F.col(f"first{side}"), F.col(f"last{side}")))

    a, b = prepared(left, left_ends, "_a"), prepared(right, right_ends, "_b")
    pairs = _binned(a, _levels(b, keys, "_b"), keys, "_a").join(_binned(b, _levels(a, keys, "_a"), keys, "_b"), [*keys, "level", "bin"])
    begin = F.greatest("first_a", "first_b")
    meet = (F.col("level") == F.greatest("level_a", "level_b")) & (_bin(begin, F.col("level")) == F.col("bin")) & (begin <= F.least("last_a", "last_b"))
    return pairs.filter(meet).drop("level", "bin", *[f"{c}_{s}" for c in ("first", "last", "level") for s in "ab"])
