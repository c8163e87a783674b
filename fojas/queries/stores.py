"""Queries over what jobs keep in the shared folder between runs: the content store and the usage meter."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from fojas import fixed
from fojas.queries.evaluation import EVENT_USAGE, USAGE_ROWS, event_attempts, usage_rows
from fojas.queries.registry import query, table
from fojas.session import shared_dir
from fojas.sources import files, store
from fojas.sources.prices import listed_prices
from fojas.streaming import metering


def fetched(documents, later):
    """Documents as a fetch of PDF files; every seventh length is no PDF. In the later one every third has changed."""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("!")) if later else F.coalesce("text", F.lit(""))
    text = F.when(F.col("n_chars") % 3 == 0, body).otherwise(F.coalesce("text", F.lit("")))
    head = F.when(F.col("n_chars") % 7 == 0, "<html>").otherwise(fixed.PDF_MAGIC)
    key = F.col("doc_id").cast("string")
    rows = documents if later else documents.filter("n_chars % 5 <> 0")
    return files.hashed(rows.select(
        key.alias("part"), key.alias("path"), (F.lit("later") if later else F.col("source")).alias("title"), F.col("source").alias("share_url"),
        F.encode(F.concat(head, text), "UTF-8").alias("content"),
    ))


@query("q41_store_commits", sql=f"""
WITH d AS (SELECT source, n_chars % 5 = 0 AS late, n_chars % 3 = 0 AS altered, strlen(coalesce(text, '')) + {len(fixed.PDF_MAGIC)} AS n FROM documents WHERE n_chars % 7 <> 0)
SELECT source, count(*) AS parts, count(*) + count(*) FILTER (altered AND NOT late) AS versions, count(*) FILTER (late) AS "new", count(*) FILTER (altered AND NOT late) AS "changed",
  count(*) FILTER (NOT altered AND NOT late) AS "unchanged", count(*) FILTER (late OR altered) AS moved, CAST(sum(n + CASE WHEN altered THEN 1 ELSE 0 END) AS BIGINT) AS current_bytes
FROM d GROUP BY 1""")
def q41_store_commits(spark, sf):
    """Two fetches of the documents into a content store. The second crashes before it counts and is then run twice."""
    documents = table(spark, sf, "documents")
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    days = [dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)]
    store.commit(fetched(documents, False), root, "first", days[0])
    store.stage(fetched(documents.filter("n_chars % 2 = 0"), True), root, "second")
    for _ in range(2):
        statuses = store.commit(fetched(documents, True), root, "second", days[1])
    manifest = store.manifest(spark, root)
    totals = files.fetch_totals(statuses.join(manifest.select("part", F.col("share_url").alias("source")), "part"), ("source",))
    current = files.latest(manifest, store.contents(spark, root)).join(manifest.select("part", "fetched_at"), "part")
    sizes = current.groupBy(F.col("share_url").alias("source")).agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("fetched_at") == F.lit(days[1])).alias("moved"), F.sum(F.length("content").cast("bigint")).alias("current_bytes")
    )
    kept = store.versions(spark, root).join(manifest.select("part", F.col("share_url").alias("source")), "part").groupBy("source").agg(F.count(F.lit(1)).alias("versions"))
    return sizes.join(totals.drop("total"), "source").join(kept, "source").select("source", "parts", "versions", "new", "changed", "unchanged", "moved", "current_bytes")


def _usage_of(condition):
    """The usage of some events, its cost to nine places: six would round sums that end in a five by their order."""
    usage = EVENT_USAGE.replace("FROM events)", f"FROM events WHERE {condition})").replace("round(sum(cost), 6)", "round(sum(cost), 9)")
    return f"(WITH {usage} {USAGE_ROWS})"


@query("q42_usage_takes", sql=f"""
SELECT 'first' AS taken, * FROM {_usage_of('event_id % 3 = 0')}
UNION ALL SELECT 'open' AS taken, * FROM {_usage_of('event_id % 3 <> 0')}""")
def q42_usage_takes(spark, sf):
    """Events metered in batches: a third is taken, a third is folded after the take, a third still lies in batches."""
    events = table(spark, sf, "events")
    root = f"{shared_dir(spark)}/meter-{uuid.uuid4().hex}"
    for turn in range(3):
        events.filter(F.col("event_id") % 3 == turn).repartition(2, "event_id").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        metering.start(event_attempts(stream), listed_prices(spark), root).awaitTermination()
        if turn == 0:
            metering.take(spark, root, "first")
        elif turn == 1:
            metering.fold(spark, root)
    both = metering.take(spark, root, "first").withColumn("taken", F.lit("first")).unionByName(metering.read_usage(spark, root).withColumn("taken", F.lit("open")))
    return usage_rows(both, 9, "taken")
