"""Queries over parts that were published more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fojas.operators import definitions as D
from fojas.operators import editions as E
from fojas.plans import jobs as J
from fojas.queries.registry import query, table
from fojas.queries.retrieval import READS, search_events
from fojas.session import shared_dir


def editions_of_parts(part):
    """Every brand as a part of two editions: the first has all items, the second two in three, a page later.

    Brands whose number divides by five went back to their first edition. Returns page rows and the history.
    """
    first = part.withColumn("content_hash", F.concat(F.lit("a-"), "p_brand")).withColumn("pdf_page", F.col("p_size"))
    second = part.filter("p_partkey % 3 <> 0").withColumn("content_hash", F.concat(F.lit("b-"), "p_brand")).withColumn("pdf_page", (F.col("p_size") % 50 + 1).cast("int"))
    rows = first.unionByName(second).select(
        "content_hash", F.col("p_brand").alias("part"), F.col("p_partkey").alias("section_ord"), F.col("p_name").alias("section"), "pdf_page",
        F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    last = F.when(F.substring_index("p_brand", "#", -1).cast("int") % 5 == 0, "a-").otherwise("b-")
    fetches = F.map_from_arrays(F.array(*[F.lit(f"2024-0{m}-01") for m in (1, 2, 3)]), F.array(F.lit("a-"), F.lit("b-"), last))
    brands = part.select("p_brand").distinct().select(F.col("p_brand").alias("part"), F.explode(fetches).alias("at", "edition"))
    return rows, brands.select("part", F.concat("edition", "part").alias("sha256"), F.col("at").cast("timestamp").alias("fetched_at"))


def editions_of_definitions(part):
    """A part of definitions in two editions: the first defines the items' kinds, the second their
    qualities and every second name (by the alphabet). Returns definitions and the history."""
    names = part.select(F.col("p_name").alias("name")).distinct()
    words = lambda n: names.select(F.split("name", " ")[n].alias("term")).distinct()
    placed = lambda df, start: df.select((F.rank().over(Window.orderBy("term")) + start).alias("def_ord"), "term")
    every_second = placed(names.withColumnRenamed("name", "term"), 1000).filter("def_ord % 2 = 0")
    kinds = placed(words(1), 0).withColumn("content_hash", F.lit("a-definitions"))
    qualities = placed(words(0), 0).unionByName(every_second).withColumn("content_hash", F.lit("b-definitions"))
    rows = kinds.unionByName(qualities).select(
        "content_hash", F.lit("1").alias("part"), F.lit("1.11").alias("section"), "def_ord", "term", F.concat("term", F.lit(": x")).alias("text"), F.lit(1).alias("pdf_page")
    )
    history = [("1", "a-definitions", "2024-01-01"), ("1", "b-definitions", "2024-02-01")]
    return rows, part.sparkSession.createDataFrame(history, "part string, sha256 string, at string").select("part", "sha256", F.col("at").cast("timestamp").alias("fetched_at"))


@query("q38_current_edition", sql=f"""
WITH {READS},
ed AS (SELECT p_brand, p_partkey, p_name, lower(p_type) AS p_type, CAST(substring(p_brand, 7) AS INT) % 5 = 0 AS back, p_size FROM part),
it AS (SELECT p_brand, p_partkey, p_name, p_type, CASE WHEN back THEN p_size ELSE p_size % 50 + 1 END AS page FROM ed WHERE back OR p_partkey % 3 <> 0),
rt AS (SELECT CAST(user_id AS VARCHAR) AS question_id, 'Brand#' || (CAST(json_extract_string(props, '$.k') AS INT) % 25 + 1) AS brand, min(event_id) AS r FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
s AS (SELECT DISTINCT rd.question_id, r * 4294967296 + p_partkey AS rank, p_partkey, p_name, p_type FROM rd JOIN it ON it.p_brand = rd.brand AND it.page = rd.page JOIN rt ON rt.question_id = rd.question_id AND rt.brand = rd.brand),
nm AS (SELECT p_name AS phrase FROM (SELECT p_name, rank() OVER (ORDER BY p_name) AS k FROM (SELECT DISTINCT p_name FROM part)) WHERE k % 2 = 0),
ql AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS phrase FROM part),
us AS (
  SELECT question_id, rank, phrase, EXISTS (SELECT 1 FROM nm WHERE nm.phrase = s.p_name) AND string_split(s.p_name, ' ')[1] = ql.phrase AS covered
  FROM s JOIN ql ON ql.phrase = string_split(p_name, ' ')[1] OR ql.phrase = p_type
  UNION ALL SELECT question_id, rank, phrase, false FROM s JOIN nm ON nm.phrase = p_name),
fq AS (SELECT question_id, phrase, count(*) AS n FROM us GROUP BY 1, 2),
tp AS (SELECT us.*, row_number() OVER (PARTITION BY us.question_id, rank ORDER BY len(string_split(us.phrase, ' ')) DESC, n, us.phrase) AS place FROM us JOIN fq ON fq.question_id = us.question_id AND fq.phrase = us.phrase WHERE NOT covered),
fs AS (SELECT question_id, phrase, min(row(rank, place)) AS seen FROM tp GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seen) AS k FROM fs)
SELECT s.question_id, count(*) AS n_sections, CAST(sum(p_partkey) AS BIGINT) AS ord_sum, any_value(t.terms) AS terms
FROM s LEFT JOIN (SELECT question_id, string_agg(phrase, ',' ORDER BY k) AS terms FROM rk WHERE k <= 20 GROUP BY 1) t ON t.question_id = s.question_id GROUP BY 1""")
def q38_current_edition(spark, sf):
    """Sections read and definitions attached from a corpus that holds two editions of every part: only the
    current ones show, also where an earlier edition came back."""
    part, events = table(spark, sf, "part"), table(spark, sf, "events")
    rows, history = editions_of_parts(part)
    definitions, definition_history = editions_of_definitions(part)
    versions = E.intervals(history.unionByName(definition_history))
    key = ("content_hash", "section_ord")
    root = f"{shared_dir(spark)}/editions-{uuid.uuid4().hex}"
    corpus = {
        "parts": versions.select("part", "content_hash").distinct().withColumn("page_count", F.lit(50)), "section_pages": rows.drop("text"),
        "definition_pages": definitions.drop("text"), "definitions": definitions, "section_terms": J.written(D.section_terms(rows.select(*key, "text"), definitions, key), f"{root}/section_terms"),
    }
    reads = search_events(events)
    routes = reads.filter(F.col("type") == "tool_call").groupBy("question_id", "part").agg(F.min("seq").alias("route_rank"))
    found, attached = J.retrieve_totals(corpus, routes, reads, root, E.valid_at(versions))
    terms = attached.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))  # at most a prompt's definitions
    return found.join(terms, "question_id", "left").select("question_id", "n_sections", "ord_sum", F.array_join("t.term", ",").alias("terms"))


@query("q39_asked_editions", sql="""
WITH ev AS (SELECT *, 'Brand#' || (CAST(json_extract_string(props, '$.k') AS INT) % 25 + 1) AS part FROM events),
h AS (SELECT part, ts, CASE WHEN CAST(trunc(value) AS INT) % 11 = 0 THEN NULL ELSE 'h' || CAST(trunc(value) AS INT) % 4 END AS hash FROM ev WHERE event_type = 'purchase'),
c AS (SELECT * FROM (SELECT *, lag(hash) OVER w AS p, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY part ORDER BY ts)) WHERE (k = 1 AND hash IS NOT NULL) OR hash IS DISTINCT FROM p),
n AS (SELECT part, ts, hash, CASE WHEN hash IS NOT NULL THEN count(hash) OVER (PARTITION BY part ORDER BY ts) END AS edition FROM c)
SELECT a.event_id, a.part, n.hash AS content_hash, CAST(n.edition AS INT) AS edition FROM ev a ASOF LEFT JOIN n ON n.part = a.part AND n.ts <= a.ts WHERE a.event_type IN ('click', 'view')""")
def q39_asked_editions(spark, sf):
    """Which edition of its part each question saw: purchases as fetches (some of them withdrawals), clicks and
    views as questions."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf, "events").withColumn("part", F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")))
    content = F.col("value").cast("int")
    history = events.filter("event_type = 'purchase'").select(
        "part", F.when(content % 11 != 0, F.concat(F.lit("h"), (content % 4).cast("string"))).alias("sha256"), F.col("ts").alias("fetched_at")
    )
    asked = events.filter("event_type in ('click', 'view')").select("event_id", "part", "ts")
    return E.as_of(asked, E.intervals(history), "ts").select("event_id", "part", "content_hash", "edition")
