"""Queries over recorded answers made from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fojas.functions import text as T
from fojas.operators import grounding as G
from fojas.queries import feeds
from fojas.queries import sqltext as S
from fojas.queries.registry import query, table

DOCUMENT_SOURCE = "SELECT CAST(doc_id AS VARCHAR) AS answer_id, lang, n_chars, source, text FROM documents"
TURN_SOURCE = (
    "SELECT conv_id || '-' || turn AS answer_id, role AS lang, length(text) AS n_chars, role AS source, text FROM conversations"
)


def answers_sql(source: str) -> str:
    """Answers made from a table of texts, in SQL: lines, spans, cuts, pieces and their layout."""
    return ANSWERS_TEMPLATE.replace("$SOURCE", source)


ANSWERS_TEMPLATE = rf"""
l AS (
  SELECT answer_id, lang, n_chars, source,
    CASE lang WHEN 'de' THEN 'ninguna' WHEN 'fr' THEN 'parcial' ELSE 'total' END AS coverage,
    'COBERTURA: ' || CASE lang WHEN 'de' THEN 'ninguna - lo regula la Parte 67.'
      WHEN 'fr' THEN 'parcial - lo regula la Parte 67.' ELSE 'total' END AS opening,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
  FROM ($SOURCE)),
b AS (
  SELECT answer_id, n, line, CASE WHEN n % 2 = 1 AND n % 3 = 0 THEN '- ' || line ELSE line END AS t
  FROM (SELECT answer_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l)),
o AS (
  SELECT b.*, length(l.opening) + 2
    + coalesce(sum(length(t) + 1) OVER (PARTITION BY b.answer_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM b JOIN l USING (answer_id)),
spans AS (
  SELECT answer_id, s AS sp_start, s + length(t) AS sp_end, line AS cited_text,
    (n // 2) % 2 AS di, (n // 2) % 3 AS blk FROM o WHERE n % 2 = 0),
f AS (
  SELECT l.answer_id, l.coverage, l.n_chars, length(l.opening) AS body,
    l.opening || chr(10) || chr(10) || coalesce(x.rest, '') AS full_text
  FROM l LEFT JOIN (SELECT answer_id, string_agg(t || chr(10), '' ORDER BY n) AS rest FROM b GROUP BY 1) x USING (answer_id)),
cuts AS (
  SELECT answer_id, k, body + sum(length(p)) OVER (PARTITION BY answer_id ORDER BY k) AS cut
  FROM (SELECT answer_id, body, unnest(ps) AS p, generate_subscripts(ps, 1) AS k
        FROM (SELECT answer_id, body, string_split({S.cut_marked("substring(full_text, body + 1)")}, chr(30)) AS ps FROM f))),
kept_cuts AS (
  SELECT DISTINCT answer_id, cut FROM cuts c
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.answer_id = c.answer_id AND s.sp_start < c.cut AND c.cut < s.sp_end)),
bounds AS (
  SELECT answer_id, coalesce(lag(cut) OVER (PARTITION BY answer_id ORDER BY cut), body) AS p_start, cut AS p_end
  FROM kept_cuts JOIN f USING (answer_id)),
pieces AS (
  SELECT answer_id, p_start, p_end, substring(full_text, CAST(p_start AS BIGINT) + 1, CAST(p_end - p_start AS BIGINT)) AS raw
  FROM bounds JOIN f USING (answer_id) WHERE p_start < p_end),
support AS (
  SELECT answer_id, list_distinct(flatten(list({S.claim_tokens("cited_text || CASE di WHEN 0 THEN ' 61.' || answer_id || ' 61' ELSE ' 91.' || answer_id || ' 91' END")}))) AS sup
  FROM spans GROUP BY 1),
m AS (
  SELECT p.*, {S.without_markup("raw")} AS txt, {S.claim_tokens(S.without_markup("raw"))} AS toks, coalesce(sup, []) AS sup,
    regexp_matches(raw, '\S') AS has_text, regexp_matches(raw, '^\s*\n') AS lead_nl, regexp_matches(raw, '\n\s*$') AS trail_nl,
    regexp_matches(raw, '^\s*(?:[-*•]|\d+[.)])(?:\s|$)') AS bullet
  FROM pieces p LEFT JOIN support USING (answer_id)),
k AS (
  SELECT *, regexp_matches(txt, '\p{{L}}') AS letters,
    regexp_matches(txt, '\p{{L}}') AND len(list_filter(toks, lambda x: NOT list_contains(sup, x))) = 0 AS kept FROM m),
w1 AS (
  SELECT *,
    coalesce(max(CASE WHEN has_text THEN p_start END) OVER prev, -1) AS last_text,
    coalesce(max(CASE WHEN lead_nl THEN p_start END) OVER upto, -1) AS last_nl,
    coalesce(last_value(CASE WHEN has_text THEN trail_nl END IGNORE NULLS) OVER prev, false) AS trail_prev,
    coalesce(sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER prev, 0) AS kept_before,
    coalesce(max(CASE WHEN kept THEN p_start END) OVER prev, -1) AS last_kept,
    last_value(CASE WHEN kept THEN p_end END IGNORE NULLS) OVER prev AS prev_end,
    last_value(CASE WHEN kept THEN txt END IGNORE NULLS) OVER prev AS prev_txt
  FROM k
  WINDOW prev AS (PARTITION BY answer_id ORDER BY p_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY answer_id ORDER BY p_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, last_nl > last_text OR trail_prev AS brk FROM w1),
w3 AS (
  SELECT *, coalesce(max(CASE WHEN bullet AND (brk OR kept_before = 0) THEN p_start END) OVER upto, -1) > last_kept AS item,
    coalesce(max(CASE WHEN brk THEN p_start END) OVER upto, -1) > last_kept AS para
  FROM w2 WINDOW upto AS (PARTITION BY answer_id ORDER BY p_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w4 AS (SELECT *, CASE WHEN item THEN 'item' WHEN para AND kept_before > 0 THEN 'paragraph' END AS starts FROM w3),
s AS (
  SELECT answer_id, p_start, p_end, kept, letters, starts,
    CASE WHEN NOT kept OR (starts IS NULL AND prev_end = p_start AND regexp_matches(prev_txt, '[:;]$')) THEN txt
      ELSE {S.capitalize("txt")} END AS txt
  FROM w4),
sc AS (
  SELECT s.answer_id, s.p_start, count(*) AS n_c, sum(f.n_chars % 50 + sp.blk + 1) AS pages,
    bool_or(di = 0) AS c0, bool_or(di = 1) AS c1
  FROM s JOIN spans sp ON sp.answer_id = s.answer_id AND s.p_start <= sp.sp_start AND sp.sp_end <= s.p_end
  JOIN f ON f.answer_id = s.answer_id WHERE s.kept GROUP BY 1, 2),
ans AS (
  SELECT f.answer_id, f.coverage, f.coverage = 'ninguna' OR coalesce(x.n_cited, 0) = 0 AS refused, x.*
  FROM f LEFT JOIN (
    SELECT s.answer_id AS aid, count(*) FILTER (kept) AS n_kept, count(*) FILTER (letters AND NOT kept) AS n_dropped,
      sum(n_c) AS n_cites, count(n_c) AS n_cited, sum(pages) AS page_sum, bool_or(c0) AS c0, bool_or(c1) AS c1,
      string_agg(CASE WHEN kept THEN coalesce(starts, '') || '|' || txt END, '#' ORDER BY s.p_start) AS body_text,
      string_agg(CASE WHEN letters AND NOT kept THEN txt END, '#' ORDER BY s.p_start) AS dropped_text
    FROM s LEFT JOIN sc ON sc.answer_id = s.answer_id AND sc.p_start = s.p_start GROUP BY 1) x ON x.aid = f.answer_id)
"""

ANSWERS = answers_sql(DOCUMENT_SOURCE)


def grounded(spark, sf):
    documents = feeds.texts(table(spark, sf, "documents"))
    responses = G.parse_responses(feeds.answer_responses(documents))
    return G.ground(responses, feeds.answer_documents(documents))


@query("q05_grounding", sql=f"""
WITH {ANSWERS}
SELECT answer_id, refused, NOT refused AND coverage = 'parcial' AS incomplete, coverage,
  CASE WHEN refused THEN 0 ELSE coalesce(n_kept, 0) END AS n_sentences, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN refused THEN 0 ELSE CAST(coalesce(n_cites, 0) AS BIGINT) END AS n_citations,
  CASE WHEN refused THEN 0 ELSE CAST(coalesce(page_sum, 0) AS BIGINT) END AS page_sum,
  md5(CASE WHEN refused THEN '' ELSE coalesce(body_text, '') END) AS body, md5(coalesce(dropped_text, '')) AS dropped,
  CASE WHEN coverage = 'total' THEN '' WHEN c1 AND NOT coalesce(c0, false) THEN '67:91.' || answer_id ELSE '67:61.' || answer_id END AS likely
FROM ans""")
def q05_grounding(spark, sf):
    """Responses to answers: sentences, citations, dropped claims, status and likely parts."""
    a = grounded(spark, sf)
    laid = F.transform("sentences", lambda s: F.concat_ws("|", F.coalesce(s["starts"], F.lit("")), s["text"]))
    cites = F.flatten(F.transform("sentences", lambda s: s["citations"]))
    likely = F.transform("likely_parts", lambda p: F.concat_ws(":", p["part"], p["citation"]["section"]))
    return a.withColumn("cites", cites).select(
        "answer_id", "refused", "incomplete", "coverage",
        F.size("sentences").alias("n_sentences"), F.size("dropped").alias("n_dropped"), F.size("cites").alias("n_citations"),
        F.aggregate("cites", F.lit(0).cast("bigint"), lambda acc, c: acc + c["pdf_page_start"]).alias("page_sum"),
        F.md5(F.array_join(laid, "#")).alias("body"), F.md5(F.array_join("dropped", "#")).alias("dropped"),
        F.array_join(likely, ",").alias("likely"),
    )


@query("q06_sentences", sql=f"""
WITH p AS (
  SELECT doc_id, p, k, length(p) AS n FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k
    FROM (SELECT doc_id, string_split({S.cut_marked("text")}, chr(30)) AS ps FROM documents))),
q AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS piece_start FROM p)
SELECT d.doc_id, count(q.doc_id) AS n_sentences, CAST(coalesce(sum(piece_start), 0) AS BIGINT) AS start_sum, coalesce(max(n), 0) AS longest,
  coalesce(sum(length({S.without_markup("p")})), 0) AS kept_chars
FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id AND regexp_matches(p, '\\p{{L}}') GROUP BY 1""")
def q06_sentences(spark, sf):
    """Sentence pieces of every document with their offsets, without a shuffle."""
    d = table(spark, sf, "documents").select("doc_id", T.sentence_pieces(F.col("text")).alias("pieces"))
    d = d.withColumn("ends", T.running_ends(F.col("pieces")))
    placed = F.zip_with(
        "pieces", "ends", lambda p, e: F.struct(p.alias("p"), (e - F.length(p)).cast("bigint").alias("start"))
    )
    d = d.select("doc_id", F.filter(placed, lambda x: x["p"].rlike(r"(?U)\p{L}")).alias("s"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(
        "doc_id", F.size("s").alias("n_sentences"), total(F.col("s.start")).alias("start_sum"),
        F.coalesce(F.array_max(F.transform("s.p", F.length)), F.lit(0)).alias("longest"),
        total(F.transform("s.p", lambda x: F.length(T.without_markup(x)))).alias("kept_chars"),
    )


@query("q07_layout", sql=f"""
WITH {ANSWERS},
z AS (
  SELECT s.answer_id, s.p_start, coalesce(starts, '') AS st,
    lag(coalesce(starts, '')) OVER w AS prev_st
  FROM s JOIN ans ON ans.answer_id = s.answer_id WHERE s.kept AND NOT ans.refused
  WINDOW w AS (PARTITION BY s.answer_id ORDER BY s.p_start)),
y AS (
  SELECT *, last_value(CASE WHEN st = 'item' THEN 'list' WHEN st = 'paragraph' OR prev_st IS NULL THEN 'paragraph' END IGNORE NULLS)
      OVER (PARTITION BY answer_id ORDER BY p_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM z),
x AS (
  SELECT *, st = 'paragraph' OR prev_st IS NULL
    OR (st = 'item' AND lag(kind) OVER (PARTITION BY answer_id ORDER BY p_start) = 'paragraph') AS opens FROM y)
SELECT answer_id, count(*) FILTER (opens) AS n_blocks, count(*) FILTER (st = 'item') AS n_items,
  count(*) FILTER (kind = 'paragraph') AS n_paragraph_sentences, count(*) AS n_sentences
FROM x GROUP BY 1""")
def q07_layout(spark, sf):
    """Sentences of every answer grouped into paragraphs and lists."""
    from fojas.operators.render import layout

    s = layout(G.sentence_rows(grounded(spark, sf)))
    return s.groupBy("answer_id").agg(
        F.max("block").alias("n_blocks"),
        F.count_if(F.col("starts") == "item").alias("n_items"),
        F.count_if(F.col("kind") == "paragraph").alias("n_paragraph_sentences"),
        F.count(F.lit(1)).alias("n_sentences"),
    )
