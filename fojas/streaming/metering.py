"""Usage per exchange and stage while calls are being made, handed over and begun anew by takes.

A batch writes the partial sums of its own attempts, over what an attempt that crashed left there, and then
a row that makes them count; the stream holds no state. A fold combines the batches since the fold before
into one folder, so a reader opens few folders however long the stream has run. A take is a cut between
batches: it hands over what was used since the take before, and readers count on from there. Folds and takes
are folders that are never changed: a take asked for again by its name, also after a crash, is the same.

    parts/batch=N, batches/batch=N     partial sums of a batch; the row that makes them count
    folds/upto=N, folded/upto=N        those of all batches after the fold before, up to N; the same
    takes/take=NAME                    after, upto: the batches handed over

Batches that are folded are read no more and may be deleted. One process at a time folds and takes; the
stream may run meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fojas.operators import usage as U
from fojas.sources.tables import folder_name, read_or_empty, replaced

PARTS = (
    "exchange_id STRING, stage STRING, model STRING, requests BIGINT, " + ", ".join(f"{t} BIGINT" for t in U.TOKENS)
    + ", cost DOUBLE, unknown BIGINT, unpriced BOOLEAN, first_seq BIGINT, unmetered_requests BIGINT"
)
DONE = "done BOOLEAN"
TAKES = "after BIGINT, upto BIGINT"
NONE = -1  # before the first batch


def start(attempts: DataFrame, prices: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    """Write the partial sums of priced attempts, batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        replaced(U.usage_parts(batch), f"{root}/parts/batch={batch_id}", PARTS)
        _count(batch.sparkSession, f"{root}/batches/batch={batch_id}")

    writer = U.priced(attempts, prices).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _count(spark: SparkSession, path: str) -> None:
    replaced(spark.range(1).select(F.lit(True).alias("done")).coalesce(1), path, DONE)


def _last(rows: DataFrame, column: str) -> int:
    [number] = rows.agg(F.max(column)).first()
    return NONE if number is None else number


def _takes(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/takes", f"{TAKES}, take STRING")


def _folded(spark: SparkSession, root: str) -> int:
    return _last(read_or_empty(spark, f"{root}/folded", f"{DONE}, upto BIGINT"), "upto")


def _folds(spark: SparkSession, root: str, after: int, upto: int) -> DataFrame:
    done = read_or_empty(spark, f"{root}/folded", f"{DONE}, upto BIGINT").filter(F.col("upto") <= upto)
    rows = read_or_empty(spark, f"{root}/folds", f"{PARTS}, upto BIGINT").filter((F.col("upto") > after) & (F.col("upto") <= upto))
    return rows.join(done, "upto", "left_semi").drop("upto")


def _batches(spark: SparkSession, root: str, after: int) -> tuple[DataFrame, DataFrame]:
    done = read_or_empty(spark, f"{root}/batches", f"{DONE}, batch BIGINT").filter(F.col("batch") > after)
    rows = read_or_empty(spark, f"{root}/parts", f"{PARTS}, batch BIGINT").filter(F.col("batch") > after)
    return done, rows.join(done, "batch", "left_semi")


def fold(spark: SparkSession, root: str) -> int:
    """Combine the batches since the last fold; returns the last batch that is folded (-1: none)."""
    before = _folded(spark, root)
    done, rows = _batches(spark, root, before)
    upto = _last(done, "batch")
    if upto == NONE:
        return before
    replaced(U.combined(rows.filter(F.col("batch") <= upto)), f"{root}/folds/upto={upto}", PARTS)
    _count(spark, f"{root}/folded/upto={upto}")
    return upto


def take(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Stage totals since the take before, which from now on count no more; the same again for a name taken before."""
    mine = lambda: _takes(spark, root).filter(F.col("take") == folder_name(name)).first()
    if mine() is None:
        upto, after = fold(spark, root), _last(_takes(spark, root), "upto")
        cut = spark.range(1).select(F.lit(after).cast("bigint").alias("after"), F.lit(upto).cast("bigint").alias("upto"))
        replaced(cut.coalesce(1), f"{root}/takes/take={name}", TAKES)
    row = mine()
    return U.roll_up(U.combined(_folds(spark, root, row.after, row.upto)))


def read_usage(spark: SparkSession, root: str, since_take: bool = True) -> DataFrame:
    """Stage totals since the last take, or since the start."""
    folded = _folded(spark, root)
    after = _last(_takes(spark, root), "upto") if since_take else NONE
    _, late = _batches(spark, root, folded)
    return U.roll_up(U.combined(_folds(spark, root, after, folded).unionByName(late.drop("batch"))))
