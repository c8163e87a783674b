"""The corpus pipeline: language ID, near duplicates, benchmark passages, mix of sources, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fojas.llm import decontaminate, lang_centroid, mix_flow, near_hamming, shard_slots
from fojas.llm.common import new_folder, read, ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (no letters, or too far from every language) go."""
    ship(spark)
    model = lang_centroid.train(docs.filter(F.col("doc_id").isNotNull()))
    found = lang_centroid.predict_beside(docs.select(*COLUMNS), model)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays, in one row.

    Rows that share an id and a text are one document; those that share an id alone are judged and kept each by
    its own text. Null, empty and blank texts are copies of nothing, and rows without id stay as they are.
    """
    ship(spark)
    found = near_hamming.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"))
    gone = found.filter(~F.col("kept")).select(F.col("id").alias("doc_id"), "th").distinct()
    rows = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    kept = rows.join(gone, ["doc_id", "th"], "left_anti")
    once = kept.filter("doc_id is not null").groupBy("doc_id", "th").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return once.select("doc_id", "row.*").unionByName(kept.filter("doc_id is null").drop("th"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that held nothing else go."""
    ship(spark)
    return decontaminate.cleaned(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with sources weighing 3, 1, 2 in turn."""
    ship(spark)
    sized = docs.select(*COLUMNS, mix_flow.word_count("text").alias("size"))
    targets = mix_flow.source_targets(written(sized.select("source", "size"), "sizes"))
    rows = sized.withColumnRenamed("doc_id", "id").withColumn("sources", F.array("source"))
    taken = mix_flow.mix(rows, {s: t for s, (_, t) in targets.items()}).filter("copies > 0").withColumnRenamed("id", "doc_id")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it, by near equal bytes."""
    ship(spark)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    return shard_slots.shard_documents(rows, SHARDS, new_folder(spark, "slot_map")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]
#: Trained centroids, signatures and seeded hashes are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
