"""Queries over evaluation runs that replay what an earlier run retrieved."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fojas import schemas
from fojas.plans import replay as RP
from fojas.queries.registry import query, table
from fojas.session import shared_dir


def corpus_of(documents):
    """Documents as the sections of one part per language, each part with one definition, all on page one."""
    page = F.array(F.struct(F.lit(1).alias("pdf_page"), F.lit("1").alias("printed_page"), F.lit("I").alias("edition"), F.lit(None).cast("string").alias("amendment"), F.lit("mayo 2026").alias("date")))
    lang = F.coalesce("lang", F.lit("none"))
    hashed = F.concat(F.lit("h-"), lang).alias("content_hash")
    parts = documents.select(lang.alias("part"), hashed).distinct()
    sections = documents.select(
        hashed, F.col("doc_id").alias("section_ord"), lang.alias("part"), F.col("doc_id").cast("string").alias("section"), F.col("source").alias("title"), page.alias("pages")
    )
    definitions = parts.select("content_hash", F.lit(0).alias("def_ord"), "part", F.lit("1.11").alias("section"), F.concat(F.lit("término "), "part").alias("term"), page.alias("pages"))
    none = documents.sparkSession.createDataFrame([], "content_hash STRING, section_ord BIGINT, page_index INT, at INT, item INT, to_part STRING, to_section STRING, text STRING")
    return {"parts": parts, "sections": sections, "definitions": definitions, "references": none}


def recorded_of(documents):
    """An earlier run over the documents as cases, with one defect by length: not recorded, another question, failed,
    an unknown section, nothing retrieved, an unknown definition."""
    v = F.col("n_chars") % 7
    lang, own = F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")
    ref = F.array(F.struct(lang.alias("parte"), F.when(v == 3, F.concat(own, F.lit("x"))).otherwise(own).alias("seccion")))
    term = F.array(F.struct(lang.alias("parte"), F.lit("1.11").alias("seccion"), F.concat(F.when(v == 5, "otro ").otherwise("término "), lang).alias("term")))
    kept = documents.filter(v != 0)
    return kept.select(
        own.alias("id"), F.when(v == 1, "¿Antes?").otherwise(F.col("source")).alias("question"), F.when(v == 2, "boom").alias("error"),
        F.when(v != 4, ref).otherwise(F.slice(ref, 1, 0)).alias("retrieved_secciones"), F.when(F.col("n_chars") % 2 == 1, term).otherwise(F.slice(term, 1, 0)).alias("definiciones"),
    )


def replayed_answers(documents):
    """What the model said of each document: one sentence that cites the first document of the prompt and one it cannot back."""
    cited = F.array(F.struct(F.lit("content_block_location").alias("type"), F.lit("x").alias("cited_text"), F.lit(0).alias("document_index"), F.lit(0).alias("start_block_index"), F.lit(1).alias("end_block_index")))
    block = lambda text, c=None: F.struct(F.lit("text").alias("type"), F.lit(text).alias("text"), (F.lit(None).cast(f"ARRAY<STRUCT<{schemas.RAW_CITATION}>>") if c is None else c).alias("citations"))
    content = F.array(block("COBERTURA: total\n\n"), block("Se puede volar", cited), block(". Vence en 2030."))
    raw = F.to_json(F.struct(F.lit("m").alias("model"), F.lit("end_turn").alias("stop_reason"), content.alias("content")))
    return documents.select(F.col("doc_id").cast("string").alias("answer_id"), raw.alias("raw"))


@query("q43_answer_replay", sql="""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, n_chars % 7 AS v, n_chars % 2 = 1 AS has_term, n_chars % 11 = 0 AS outside FROM documents),
e AS (SELECT *, CASE WHEN v = 0 THEN 'no recorded retrieval' WHEN v = 1 THEN 'the question changed since the recording' WHEN v = 2 THEN 'the recorded run failed'
    WHEN v = 5 AND has_term THEN 'no such definition: otro ' || lang WHEN v = 3 THEN 'no such section: ' || doc_id || 'x'
    WHEN lang = 'fr' AND (v <> 4 OR has_term) THEN 'part loaded in another version: fr' END AS error FROM d)
SELECT CAST(doc_id AS VARCHAR) AS case_id, error, CASE WHEN error IS NULL AND v <> 4 THEN 0.5 END AS grounding,
  CASE WHEN error IS NULL THEN (v = 4) = outside END AS refusal_correct, CASE WHEN error IS NULL THEN CASE WHEN v = 4 THEN 0 ELSE 1 END END AS n_dropped FROM e""")
def q43_answer_replay(spark, sf):
    """Answers over what an earlier run retrieved: cases that cannot be replayed fail, those without sections are refused."""
    documents = table(spark, sf, "documents")
    corpus = corpus_of(documents)
    expected = F.array(F.struct(F.col("lang").alias("part"), F.col("doc_id").cast("string").alias("section")))
    cases = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("question"), (F.col("n_chars") % 11 == 0).alias("out_of_scope"), expected.alias("expected"))
    ran_on = corpus["parts"].select("part", F.when(F.col("part") == "fr", "h-older").otherwise(F.col("content_hash")).alias("content_hash"))
    urls = corpus["parts"].select("part", F.lit("u").alias("source_url"))
    root = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    results, _ = RP.run(corpus, cases, root, "answer", replayed_answers(documents), urls, recorded=recorded_of(documents), recorded_versions=ran_on)
    return results.select("case_id", "error", "grounding", "refusal_correct", "n_dropped")
