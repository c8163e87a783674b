"""Sentences of answers that are still arriving.

Each micro-batch adds blocks to the answers it names. Blocks are taken in the order of their numbers,
whatever order they arrive in: those after a gap wait for it. Every block taken is a state of its
answer; the batch grounding runs on each state, and a sentence is emitted in the first state that shows
it complete. A stop carries the number of blocks, and an answer ends when all of them are there. Open
answers live in a written table per batch in the shared folder, so a lost executor recomputes a batch
from files, and a restarted batch overwrites its own output. Of answers that ended the ids are kept there for
good, in a table each batch adds its own to, so what is delivered again, however late, does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fojas import fixed, schemas
from fojas.operators import grounding as G
from fojas.sources.tables import read_or_empty, replaced

BLOCK = f"type: STRING, text: STRING, citations: ARRAY<STRUCT<{schemas.RAW_CITATION}>>"
BLOCK_EVENTS = f"answer_id STRING, seq INT, event STRING, block STRUCT<{BLOCK}>"
OPEN_ANSWERS = (
    f"answer_id STRING, content ARRAY<STRUCT<seq: INT, block: STRUCT<{BLOCK}>>>, seen INT, stop_at INT, emitted_end INT,"
    " emitted INT"
)
ENDED = "answer_id STRING"


def complete_sentences(open_answers: DataFrame, documents: DataFrame) -> DataFrame:
    """Sentences that become final in the states an answer passes through.

    ``open_answers``: answer_id, content (blocks in order), seen (how many of them were handled
    before), emitted_end. In a state all sentences but the last are complete. Nothing is emitted
    before the coverage line allows an answer and a complete sentence carries a citation.
    """
    fresh = open_answers.filter(F.size("content") > F.col("seen"))
    states = fresh.select(
        "answer_id", F.explode(F.sequence(F.col("seen") + 1, F.size("content"))).alias("state"), "content"
    ).select(
        "answer_id", "state", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("stop_reason"),
        F.slice("content", F.lit(1), F.col("state")).alias("content"),
    )
    mapped = G.ground(states, documents, ("state",)).filter(F.col("coverage").isin("total", "parcial"))
    done = mapped.select("answer_id", "state", F.slice("sentences", F.lit(1), F.greatest(F.size("sentences") - 1, F.lit(0))).alias("done"))
    shown = done.filter(F.exists("done", lambda s: F.size(s["citations"]) > 0))
    earlier = Window.partitionBy("answer_id").orderBy("state").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.array_max(F.col("done.end"))).over(earlier)
    marked = shown.withColumn("reached", reached).join(fresh.select("answer_id", "emitted_end"), "answer_id")
    past = F.greatest(F.coalesce("reached", F.lit(0)), "emitted_end")
    rows = marked.withColumn("past", past).select("answer_id", "state", "past", F.inline("done"))
    return rows.filter(F.col("end") > F.col("past")).drop("past")


def replay_sentences(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """What would have been emitted while these complete responses arrived, block by block."""
    whole = responses.select("answer_id", F.coalesce("content", F.array().cast(responses.schema["content"].dataType)).alias("content"))
    return complete_sentences(whole.withColumn("seen", F.lit(0)).withColumn("emitted_end", F.lit(0)), documents)


def _merged(batch: DataFrame, open_before: DataFrame) -> DataFrame:
    """Answers after a batch: all blocks by number, how many are ready (no gap before them), how many were
    handled before, and whether the answer ends now.

    A block delivered twice is kept once. ``batch`` holds nothing of answers that ended before.
    """
    arrived = batch.groupBy("answer_id").agg(
        F.collect_list(F.when(F.col("event") == "block", F.struct("seq", "block"))).alias("arrived"),
        F.max(F.when(F.col("event") == "stop", F.col("seq"))).alias("stop_now"),
        F.max(F.when(F.col("event") == "error", F.lit(True))).alias("failed"),
    )
    both = open_before.join(arrived, "answer_id", "full_outer")
    none = F.array().cast(open_before.schema["content"].dataType)
    # after sorting by number, equal numbers are neighbours: of them the first is kept
    sorted_all = F.array_sort(F.concat(F.coalesce("content", none), F.coalesce("arrived", none)), lambda x, y: x["seq"] - y["seq"])
    both = both.withColumn("all", sorted_all)
    before = F.concat(F.array(F.lit(-1)), F.slice(F.col("all.seq"), F.lit(1), F.greatest(F.size("all") - 1, F.lit(0))))
    both = both.withColumn("content", F.filter(F.transform(F.arrays_zip(F.col("all").alias("x"), before.alias("p")), lambda z: F.when(z["x"]["seq"] != z["p"], z["x"])), lambda x: x.isNotNull()))
    both = both.withColumn("ready", F.size(F.filter(F.transform("content", lambda x, i: x["seq"] == i), lambda same: same)))
    stop_at = F.coalesce("stop_at", "stop_now")
    failed = F.coalesce("failed", F.lit(False))
    return both.select(
        "answer_id", "content", "ready", F.coalesce("seen", F.lit(0)).alias("seen"), stop_at.alias("stop_at"), F.coalesce("emitted_end", F.lit(0)).alias("emitted_end"),
        F.coalesce("emitted", F.lit(0)).alias("emitted"), (~failed & F.coalesce(F.col("ready") >= stop_at, F.lit(False))).alias("stopped"),
        failed.alias("failed"),
    )


def _final_events(merged: DataFrame, documents: DataFrame) -> DataFrame:
    """The closing event of every answer that ended in a batch: the whole answer, or an error."""
    ended = merged.filter("stopped").select(
        "answer_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("stop_reason"),
        F.col("content.block").alias("content"),
    )
    answers = G.ground(ended, documents)
    shown = F.to_json(F.struct("sentences", "refused", "incomplete", "likely_parts"))
    bad = F.to_json(F.struct(F.lit(fixed.ANSWER_ERROR).alias("message")))
    ok = F.col("error").isNull()
    closing = answers.select(
        "answer_id", F.when(ok, "answer").otherwise("error").alias("type"), F.when(ok, shown).otherwise(bad).alias("payload")
    )
    failed = merged.filter("failed").select("answer_id", F.lit("error").alias("type"), bad.alias("payload"))
    return closing.unionByName(failed)


def answer_events(merged: DataFrame, emitted: DataFrame, documents: DataFrame) -> DataFrame:
    """Numbered events of a batch: sentences, then the answer or error that ends the sequence."""
    sentences = emitted.select(
        "answer_id", F.lit(0).alias("last"), F.col("end").alias("place"), F.lit("sentence").alias("type"),
        F.to_json(F.struct(F.struct("text", "citations", "starts").alias("sentence"))).alias("payload"), "end",
    )
    closing = _final_events(merged, documents).select(
        "answer_id", F.lit(1).alias("last"), F.lit(0).alias("place"), "type", "payload", F.lit(None).cast("int").alias("end")
    )
    rows = sentences.unionByName(closing).join(merged.select("answer_id", "emitted"), "answer_id")
    order = Window.partitionBy("answer_id").orderBy("last", "place")
    return rows.select("answer_id", (F.col("emitted") + F.row_number().over(order) - 1).alias("seq"), "type", "payload", "end")


def batch_writer(spark: SparkSession, documents: DataFrame, root: str) -> Callable[[DataFrame, int], None]:
    """The per-batch step: read the open answers, write this batch's events and the new open answers."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            open_before = spark.createDataFrame([], OPEN_ANSWERS)
        else:
            open_before = spark.read.schema(OPEN_ANSWERS).parquet(f"{root}/open/{batch_id - 1:09d}")
        merged_path = f"{root}/merged/{batch_id:09d}"
        ended = read_or_empty(spark, f"{root}/ended", f"{ENDED}, batch BIGINT").filter(F.col("batch") < batch_id)
        _merged(batch.join(ended, "answer_id", "left_anti"), open_before).write.mode("overwrite").parquet(merged_path)
        merged = spark.read.parquet(merged_path)  # a written table cuts the lineage and feeds all uses
        moved = merged.filter("ready > seen OR stopped")
        own = documents.join(moved.select("answer_id"), "answer_id", "left_semi")  # of this batch's answers only
        states = moved.select("answer_id", F.slice(F.col("content.block"), F.lit(1), F.col("ready")).alias("content"), "seen", "emitted_end")
        emitted = complete_sentences(states, own)
        events_path = f"{root}/events/{batch_id:09d}"
        answer_events(merged, emitted, own).write.mode("overwrite").parquet(events_path)
        sent = spark.read.parquet(events_path).groupBy("answer_id").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.max("end").alias("reached")
        )
        replaced(merged.filter("stopped OR failed").select("answer_id"), f"{root}/ended/batch={batch_id}", ENDED)
        after = merged.filter("NOT (stopped OR failed)").join(sent, "answer_id", "left")
        after.select(
            "answer_id", "content", F.col("ready").alias("seen"), "stop_at",
            F.greatest("emitted_end", F.coalesce("reached", F.lit(0))).alias("emitted_end"), (F.col("emitted") + F.coalesce("n", F.lit(0))).alias("emitted"),
        ).write.mode("overwrite").parquet(f"{root}/open/{batch_id:09d}")

    return step


def start(spark: SparkSession, blocks: DataFrame, documents: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    """Run the emission over a stream of BLOCK_EVENTS; events land under ``root``/events."""
    writer = blocks.writeStream.foreachBatch(batch_writer(spark, documents, root)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/events/*").select("answer_id", "seq", "type", "payload")
