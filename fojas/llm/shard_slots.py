"""Sharding by fixed virtual slots.

A record's hash gives one of ``slots`` virtual slots, for ever. Bytes are added up by slot, and a
versioned table maps slots to shards. Rebalancing edits that map and appends a version: it moves whole
slots and never rehashes a record. The driver handles one number per slot, thousands whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SLOTS = 8192
MAP = T.StructType([T.StructField("version", T.LongType()), T.StructField("v_slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType())])


def size_of(text: str) -> Column:
    """UTF-8 bytes of a text (null: none) and 16 more."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(16)).cast("long")


def crc_of(text: str) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def v_slot(columns: list[Column], slots: int = SLOTS, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(slots))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """(v_slot, size) rows to bytes of the slots in use; combined before the shuffle."""
    return {r.v_slot: r.n for r in rows.groupBy("v_slot").agg(F.sum("size").alias("n")).collect()}


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slots to shards, the largest first to the emptiest shard: near equal bytes."""
    heap, out = [(0, s) for s in range(shards)], {}
    heapq.heapify(heap)
    for slot, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + n, shard))
    return out


def rebalanced(old: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map after an edit for ``shards`` shards and new sizes: few slots move, each from a shard over
    the mean (or one that is gone) to the emptiest."""
    mean = sum(sizes.values()) / shards
    out = {slot: old[slot] for slot in sizes if slot in old and old[slot] < shards}
    total = [0] * shards
    for slot, shard in out.items():
        total[shard] += sizes[slot]
    loose = [slot for slot in sizes if slot not in out]
    for slot in sorted(out, key=lambda x: (sizes[x], x)):
        if sizes[slot] and total[out[slot]] - sizes[slot] >= mean:
            total[out[slot]] -= sizes[slot]
            loose.append(slot)
            del out[slot]
    heap = [(n, s) for s, n in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-sizes[x], x)):
        n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (n + sizes[slot], shard))
    return out


def save_map(spark: SparkSession, path: str, mapping: dict[int, int], sizes: dict[int, int], version: int) -> None:
    """Append one version to the map's table; earlier versions stay."""
    rows = [(version, slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(mapping.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest version of a stored map, or the one asked for."""
    table = spark.read.schema(MAP).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, {r.v_slot: r.shard for r in table.filter(F.col("version") == version).collect()}


def assign(rows: DataFrame, mapping: dict[int, int], order: list[str]) -> DataFrame:
    """Rows with ``v_slot`` plus ``shard`` and ``slot``, the place within the shard, gapless from 0.

    Places follow the virtual slots of a shard and within one of them ``order``, so numbering needs one
    virtual slot in a task, not a shard. Rows equal in ``order`` take neighbouring places.
    """
    spark = rows.sparkSession
    counts = {r.v_slot: r.n for r in rows.groupBy("v_slot").agg(F.count("*").alias("n")).collect()}
    begins, upto = [], {}
    for slot in sorted(counts):
        shard = mapping[slot]
        begins.append((slot, shard, upto.get(shard, 0)))
        upto[shard] = upto.get(shard, 0) + counts[slot]
    schema = T.StructType([T.StructField("v_slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("begin_", T.LongType())])
    table = F.broadcast(spark.createDataFrame(begins, schema))  # one row per slot at most
    placed = rows.withColumn("place_", F.row_number().over(Window.partitionBy("v_slot").orderBy(*order)) - 1)
    return placed.join(table, "v_slot").withColumn("slot", (F.col("begin_") + F.col("place_")).cast("long")).drop("begin_", "place_")


def shard_documents(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """(id, text) to (id, size, text_crc32, v_slot, shard, slot), a row for each row; the map goes to ``path``.

    The hash takes id and checksum, so rows that repeat an id with other texts are spread; equal rows
    share a virtual slot. A null id is a value like others, a null text is empty. No shard is nearer to
    the mean than its largest virtual slot allows. Without rows there are no slots and no rows. A stored
    map is edited (a new version), else version 1 is made. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("id", size_of("text").alias("size"), crc_of("text").alias("text_crc32"))
    rows = rows.withColumn("v_slot", v_slot([F.col("id"), F.col("text_crc32")], slots))
    sizes = slot_bytes(rows)
    try:
        version, old = load_map(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        version, old = 0, {}
    mapping = rebalanced(old, sizes, shards) if old else first_map(sizes, shards)
    if mapping:
        save_map(spark, path, mapping, sizes, version + 1)
    return assign(rows, mapping, ["id", "text_crc32", "size"])
