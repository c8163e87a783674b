"""Queries over sources, versions, structure and references, made from documents, pages and orders."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import labels as L
from fojas.functions import text as T
from fojas.operators import refs as R
from fojas.operators import structure as ST
from fojas.plans import jobs as J
from fojas.queries import sqltext as S
from fojas.queries.registry import query, table
from fojas.session import shared_dir
from fojas.sources import files, listings

HOST = fixed.SHARE_HOST + "/index.php/s/"


@query("q01_listings", sql=rf"""
WITH r AS (
  SELECT regexp_extract(url, '/(en|de|fr|es)/', 1) AS sheet, page_id + 2 AS row_no,
    CASE WHEN url LIKE 'https%' THEN 'Parte ' ELSE 'PARTE ' END || regexp_extract(url, '/(\d+)', 1) AS raw_part,
    {S.collapse("replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '**', '')")} AS title,
    '{HOST}tk' || page_id || CASE WHEN contains(url, '?') THEN '?path=%2F' || page_id || '%20x&openfile=' || page_id
      WHEN contains(url, '#') THEN '/download' ELSE '' END AS link
  FROM pages),
e AS (
  SELECT *, nullif(regexp_extract(raw_part, '^Parte\s+([0-9]+|[A-Z]+)$', 1), '') AS part,
    CASE WHEN contains(link, '?') THEN url_decode(regexp_extract(link, 'path=([^&]*)', 1)) END AS folder,
    CASE WHEN contains(link, '?') THEN regexp_extract(link, 'openfile=([^&]*)', 1) END AS file_id,
    CASE WHEN title = '' THEN 'no title' WHEN link LIKE '%/download' THEN 'unexpected link' END AS content_error
  FROM r),
f AS (SELECT *, min(CASE WHEN part IS NOT NULL AND content_error IS NULL THEN row_no END) OVER (PARTITION BY sheet, part) AS first_row FROM e)
SELECT sheet, row_no, part, title, folder, file_id, CASE WHEN file_id IS NULL THEN link || '/download' END AS download_url,
  CASE WHEN part IS NULL THEN 'unexpected part' WHEN row_no > first_row THEN 'listed twice' ELSE content_error END AS error
FROM f""")
def q01_listings(spark, sf):
    """Pages as listing rows: normalised fields, link parts, first error of each row."""
    p = table(spark, sf, "pages")
    link = F.concat(
        F.lit(HOST + "tk"), F.col("page_id").cast("string"),
        F.when(F.contains("url", F.lit("?")), F.concat(F.lit("?path=%2F"), F.col("page_id").cast("string"), F.lit("%20x&openfile="), F.col("page_id").cast("string")))
        .when(F.contains("url", F.lit("#")), "/download").otherwise(""),
    )
    rows = p.select(
        F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("sheet"), (F.col("page_id") + 2).alias("row_no"),
        F.array(
            F.concat(F.when(F.startswith("url", F.lit("https")), "Parte ").otherwise("PARTE "), F.regexp_extract("url", r"/(\d+)", 1)),
            F.concat(F.lit("**"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("** ")), link, F.lit("1"),
        ).alias("cells"),
    )
    return listings.listing_rows(rows).select("sheet", "row_no", "part", "title", "folder", "file_id", "download_url", "error")


def _versions(spark, sf):
    """Documents as fetched files, and the labelled ones as last time's manifest (toxic ones since changed)."""
    docs = table(spark, sf, "documents")
    fetched = docs.select(
        F.col("doc_id").cast("string").alias("part"), F.col("source").alias("title"), F.lit("u").alias("share_url"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "source",
    )
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("part"), "toxic").dropDuplicates(["part"])
    before = fetched.join(labels, "part").select(
        "part", F.lit("old").alias("title"), "share_url",
        F.when(F.col("toxic") == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("fetched_at"),
    )
    return fetched, before


VERSIONS = """
lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
v AS (
  SELECT d.doc_id, d.source, sha256(text) AS h, l.doc_id IS NOT NULL AS known,
    CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.toxic = 1 THEN 'changed' ELSE 'unchanged' END AS status
  FROM documents d LEFT JOIN lab l ON l.doc_id = d.doc_id)"""


@query("q02_content_version", sql=f"""
WITH {VERSIONS}
SELECT source, count(*) AS total, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'changed') AS "changed",
  count(*) FILTER (status = 'unchanged') AS "unchanged" FROM v GROUP BY 1""")
def q02_content_version(spark, sf):
    """New, changed and unchanged content per source, by content hash."""
    fetched, before = _versions(spark, sf)
    return files.fetch_totals(files.with_status(fetched, before), ("source",))


@query("q02_manifest", sql=f"""
WITH {VERSIONS}
SELECT CAST(doc_id AS VARCHAR) AS part, source AS title, h AS sha256, status <> 'unchanged' AS moved FROM v""")
def q02_manifest(spark, sf):
    """The manifest after the fetch: titles follow, only new content moves the fetch time."""
    fetched, before = _versions(spark, sf)
    now = dt.datetime(2026, 2, 1)
    after = files.next_manifest(fetched, before, now)
    return after.select("part", "title", "sha256", (F.col("fetched_at") == F.lit(now)).alias("moved"))


@query("q02_registry", sql="""
WITH d AS (SELECT DISTINCT sha256(text) AS h FROM documents),
r AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT h AS sha256 FROM d WHERE h NOT IN (SELECT h FROM r)""")
def q02_registry(spark, sf):
    """Content versions without a registered document, each once however many copies there are."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("sha256").distinct()
    return files.unregistered(docs, known).select("sha256")


@query("q02_sourced", sql="""
WITH n AS (SELECT c_custkey AS k, c_acctbal, c_mktsegment FROM customer),
x AS (
  SELECT k, c_acctbal < 0 AS offline, o.n IS NOT NULL AS fresh, c_mktsegment IN ('BUILDING', 'MACHINERY') AS kept
  FROM n LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = n.k)
SELECT CAST(k AS VARCHAR) AS part, (offline OR NOT fresh) AND kept AS from_cache,
  CASE WHEN fresh AND NOT offline THEN 'fresh' WHEN kept THEN 'kept' END AS title,
  CASE WHEN NOT kept AND (offline OR NOT fresh) THEN 'no download and no stored copy' END AS error FROM x""")
def q02_sourced(spark, sf):
    """Each requested part from its download, else from the stored copy, else an error."""
    c = table(spark, sf, "customer").withColumn("part", F.col("c_custkey").cast("string"))
    row = lambda df, t: df.select("part", F.lit(t).alias("title"), F.lit("u").alias("share_url"), F.lit("h").alias("sha256"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("part")).distinct()
    kept = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    asked = c.select("part", (F.col("c_acctbal") < 0).alias("offline"))
    return files.sourced(asked, row(orders, "fresh"), row(kept, "kept")).select("part", "from_cache", "title", "error")


@query("q03_lines", sql=rf"""
WITH l AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip("regexp_replace(x, '[ ' || chr(9) || ']+', ' ', 'g')")}), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, len(ls) AS n_lines, md5(array_to_string(ls, chr(10))) AS cleaned, md5({S.collapse("array_to_string(ls, chr(10))")}) AS collapsed FROM l""")
def q03_lines(spark, sf):
    """Documents cleaned line by line and as one line."""
    d = table(spark, sf, "documents").withColumn("clean", T.clean_block(F.col("text")))
    return d.select(
        "doc_id", F.when(F.col("clean") == "", 0).otherwise(F.size(F.split("clean", "\n"))).alias("n_lines"),
        F.md5("clean").alias("cleaned"), F.md5(T.collapse(F.col("clean"))).alias("collapsed"),
    )


LINES_PER_PAGE = 12


def page_blocks(documents):
    """Documents laid out as pages: running header, twelve lines of body, footer.

    Short lines become headings numbered by their length, so ids repeat; some stand alone above their
    title, some are ranges, some are divisions.
    """

    def laid(line):
        n = F.length(line)
        id_ = F.concat(F.lit("61."), n.cast("string"))
        return (
            F.when(n == 0, line)
            .when(n % 10 == 7, F.concat(F.lit("CAPÍTULO A — "), line))
            .when(n <= 12, F.concat(id_, F.lit("\n"), line))
            .when(n % 10 == 5, F.concat(id_, F.lit(" al 61.99 Reservado")))
            .when(n <= 60, F.concat(id_, F.lit(" "), line))
            .otherwise(line)
        )

    def bodies(lines):
        numbers = F.sequence(F.lit(1), F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int"))
        return F.transform(numbers, lambda p: F.array_join(F.transform(F.slice(lines, (p - 1) * LINES_PER_PAGE + 1, LINES_PER_PAGE), laid), "\n"))

    # A text is cut once, not once for each of its pages.
    page = documents.select(
        F.col("doc_id").cast("string").alias("content_hash"), "n_chars", F.posexplode(T.let(F.split("text", "\n"), bodies)).alias("place", "body")
    ).select("content_hash", "n_chars", (F.col("place") + 1).alias("pdf_page"), "body")
    p = F.col("pdf_page")
    footer = F.concat(
        F.lit("ADMINISTRACIÓN NACIONAL\n"), ((F.col("n_chars") + p) % 3 + 1).cast("string"), F.lit("º Edición\nmayo 2026\nDE AVIACIÓN CIVIL\n"),
        F.when(p % 2 == 0, F.concat(F.lit(" "), p.cast("string"), F.lit("\n"))).otherwise(""), F.lit("Enmienda "), p.cast("string"), F.lit("\n"),
    )
    header = F.concat(F.lit(fixed.CORPUS + " PARTE 61\nSUBPARTE B 2. "), p.cast("string"))
    block = lambda no, y, text: F.struct(
        F.lit(no).alias("block_no"), F.lit(0).alias("block_type"), F.lit(72.04).alias("x0"), F.lit(y).alias("y0"), F.lit(300.0).alias("x1"), F.lit(y + 1).alias("y1"), text.alias("text")
    )
    blocks = F.array(block(0, 10.0, header), block(1, 100.0, F.col("body")), block(2, 750.0, footer))
    return page.select("content_hash", "pdf_page", F.lit(800.0).alias("page_height"), F.inline(blocks))


PAGES = rf"""
dl AS (
  SELECT doc_id, n_chars, line, i, (i - 1) // {LINES_PER_PAGE} + 1 AS page FROM (
    SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
tl AS (
  SELECT *, CASE WHEN length(line) = 0 THEN line WHEN length(line) % 10 = 7 THEN 'CAPÍTULO A — ' || line
    WHEN length(line) <= 12 THEN '61.' || length(line) || chr(10) || line WHEN length(line) % 10 = 5 THEN '61.' || length(line) || ' al 61.99 Reservado'
    WHEN length(line) <= 60 THEN '61.' || length(line) || ' ' || line ELSE line END AS t FROM dl),
bl0 AS (
  SELECT doc_id, page, i, unnest(string_split(t, chr(10))) AS t, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM tl),
bl AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS n FROM bl0 WHERE regexp_matches(t, '\S')),
nx AS (SELECT *, coalesce(lead(t) OVER w, '') AS fol, regexp_matches(t, '^\s*\p{{Ll}}') AS low, count(*) OVER (PARTITION BY doc_id) AS size FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
st AS (SELECT *, coalesce(min(CASE WHEN NOT low THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), size) AS stop FROM nx),
st2 AS (SELECT *, coalesce(lead(stop, 1) OVER w, size) AS stop1, coalesce(lead(stop, 2) OVER w, size) AS stop2 FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
hd0 AS (
  SELECT doc_id, n AS pos, t, fol, stop1, stop2, regexp_matches(t, '^\s*61\.\d+ª?\s+al\s+61\.\d+ª?') OR (regexp_matches(t, '^\s*61\.\d+ª?\s*$') AND regexp_matches(fol, '(?i)^\s*al\b')) AS rng,
    regexp_extract(t, '^\s*(61\.\d+ª?)\s*$', 1) AS lone, regexp_extract(t, '^\s*(61\.\d+ª?)\s*(?:[–-]\s*|\s)(\S.*)$', 1) AS tid,
    regexp_extract(t, '^\s*(61\.\d+ª?)\s*(?:[–-]\s*|\s)(\S.*)$', 2) AS ttl FROM st2),
hd1 AS (
  SELECT *, lone <> '' AND regexp_matches(fol, '^\s*\p{{L}}') AND NOT regexp_matches(fol, '(?i)^\s*(CAP[IÍ]TULO|SUBPARTE|AP[EÉ]NDICE)\b') AS alone,
    tid <> '' AND regexp_matches(ttl, '^\s*\p{{Lu}}') AND NOT regexp_matches(ttl, '(?i)^\s*(CAP[IÍ]TULO|SUBPARTE|AP[EÉ]NDICE)\b') AS inl FROM hd0),
hd AS (
  SELECT doc_id, pos, CASE WHEN rng THEN NULL WHEN alone THEN lone ELSE tid END AS id, CASE WHEN rng THEN '' WHEN alone THEN fol ELSE ttl END AS first_line,
    CASE WHEN rng THEN pos + 1 WHEN alone THEN pos + 2 ELSE pos + 1 END AS tfrom, CASE WHEN rng THEN pos + 1 WHEN alone THEN greatest(stop2, pos + 2) ELSE stop1 END AS body_at
  FROM hd1 WHERE rng OR alone OR inl),
rn AS (SELECT *, CASE WHEN pos - lag(body_at) OVER w <= 1 THEN 0 ELSE 1 END AS brk, lead(pos) OVER w AS next_at FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rr AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM rn),
hx AS (
  SELECT *, (count(*) OVER (PARTITION BY doc_id, run) >= 3 AND pos <> max(pos) OVER (PARTITION BY doc_id, run))
    OR (id IS NOT NULL AND pos <> max(pos) OVER (PARTITION BY doc_id, id)) AS is_index, coalesce(next_at, body_at) AS upto FROM rr),
tt AS (
  SELECT hx.doc_id, hx.pos, {S.collapse("first_line || coalesce(' ' || string_agg(bl.t, ' ' ORDER BY bl.n), '')")} AS title
  FROM hx LEFT JOIN bl ON bl.doc_id = hx.doc_id AND bl.n >= hx.tfrom AND bl.n < hx.body_at WHERE id IS NOT NULL GROUP BY hx.doc_id, hx.pos, first_line),
ml AS (
  SELECT bl.doc_id, bl.n, bl.page, bl.t, h.pos AS h_at, h.is_index AS h_index, h.id AS h_id,
    last_value(h.pos IGNORE NULLS) OVER w AS l_at FROM bl LEFT JOIN hx h ON h.doc_id = bl.doc_id AND h.pos = bl.n
  WINDOW w AS (PARTITION BY bl.doc_id ORDER BY bl.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mk AS (
  SELECT ml.*, h_at IS NOT NULL AND NOT h_index AS opens, NOT (h_at IS NOT NULL AND NOT h_index) AND coalesce(lh.is_index AND ml.n < lh.upto, false) AS skipped,
    regexp_matches(t, '^\s*(CAP[IÍ]TULO|SUBPARTE|AP[EÉ]NDICE)\s+\S+\s+[—–-]') AS div FROM ml LEFT JOIN hx lh ON lh.doc_id = ml.doc_id AND lh.pos = ml.l_at),
op AS (
  SELECT *, last_value(CASE WHEN opens THEN CASE WHEN h_id IS NULL THEN -1 ELSE h_at END WHEN div AND NOT skipped THEN -1 END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM mk),
sl AS (
  SELECT op.doc_id, op.n, op.page, {S.strip("regexp_replace(op.t, '[ ' || chr(9) || ']+', ' ', 'g')")} AS t, cur, hx.id AS section
  FROM op JOIN hx ON hx.doc_id = op.doc_id AND hx.pos = op.cur WHERE NOT skipped AND NOT (div AND NOT opens)),
sp AS (SELECT doc_id, cur, section, page, string_agg(t, chr(10) ORDER BY n) AS text FROM sl GROUP BY 1, 2, 3, 4)"""


@query("q04_sections", sql=f"""
WITH {PAGES}
SELECT CAST(sp.doc_id AS VARCHAR) AS content_hash, count(DISTINCT cur) AS n_sections, count(*) AS n_pages,
  md5(string_agg(section || '|' || title || '|' || page || '|' || text, '#' ORDER BY cur, page)) AS content
FROM sp JOIN tt ON tt.doc_id = sp.doc_id AND tt.pos = sp.cur GROUP BY 1""")
def q04_sections(spark, sf):
    """Pages to sections: headings, index runs, repeated ids, divisions, wrapped titles, page texts."""
    corpus = J.parse_corpus(page_blocks(table(spark, sf, "documents")), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", ("section_pages",))
    sp = corpus["section_pages"]
    line = F.concat_ws("|", "section", "title", F.col("pdf_page").cast("string"), "text")
    rows = F.array_sort(F.collect_list(F.struct("section_ord", "pdf_page", line.alias("line"))))
    return sp.groupBy("content_hash").agg(
        F.countDistinct("section_ord").alias("n_sections"), F.count(F.lit(1)).alias("n_pages"),
        F.md5(F.array_join(F.transform(rows, lambda r: r["line"]), "#")).alias("content"),
    )


@query("q04_pages", sql=rf"""
WITH p AS (
  SELECT doc_id, n_chars, unnest(generate_series(1, CAST(ceil(len(string_split(text, chr(10))) / {LINES_PER_PAGE}) AS BIGINT))) AS page FROM documents),
e AS (SELECT doc_id, page, ['I', 'II', 'III'][(n_chars + page) % 3 + 1] AS edition,
    repeat('X', page // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][page % 10 + 1] AS amendment,
    CASE WHEN page % 2 = 0 THEN CAST(page AS VARCHAR) ELSE '2.' || page END AS label FROM p)
SELECT CAST(doc_id AS VARCHAR) AS content_hash, page AS pdf_page, edition, amendment, 'mayo 2026' AS "date", label AS printed_page FROM e""")
def q04_pages(spark, sf):
    """Printed label and version of every page, from its own footer or header."""
    pages = ST.pages(page_blocks(table(spark, sf, "documents")))
    return pages.select("content_hash", "pdf_page", "edition", "amendment", "date", "printed_page")


@query("q04_parts", sql=f"""
WITH p AS (
  SELECT doc_id, n_chars, unnest(generate_series(1, CAST(ceil(len(string_split(text, chr(10))) / {LINES_PER_PAGE}) AS BIGINT))) AS page FROM documents),
e AS (SELECT doc_id, ['I', 'II', 'III'][(n_chars + page) % 3 + 1] AS edition, page FROM p),
c AS (SELECT doc_id, edition, page AS amendment, count(*) AS n, min(page) AS first_page FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_page) AS rk, sum(n) OVER (PARTITION BY doc_id) AS pages FROM c)
SELECT CAST(doc_id AS VARCHAR) AS content_hash, '61' AS part, CAST(pages AS BIGINT) AS page_count, edition FROM r WHERE rk = 1""")
def q04_parts(spark, sf):
    """Code, page count and most common edition of every file; the first printed wins a tie."""
    parts = ST.parts(ST.pages(page_blocks(table(spark, sf, "documents"))))
    return parts.select("content_hash", "part", "page_count", "edition")


@query("q24_footer", sql="""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, month(o_orderdate) AS m, day(o_orderdate) AS d, year(o_orderdate) AS y FROM orders),
u AS (SELECT ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'] AS units,
  ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'] AS months)
SELECT o_orderkey, repeat('X', (o_custkey % 45 + 1) // 10) || units[(o_custkey % 45 + 1) % 10 + 1] AS edition,
  CASE WHEN o_custkey % 2 = 0 THEN repeat('X', m // 10) || units[m % 10 + 1] END AS amendment, d || ' ' || months[m] || ' ' || y AS "date",
  CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderkey % 500 AS VARCHAR) ELSE m || '.' || d END AS label,
  'Edición ' || repeat('X', (o_custkey % 45 + 1) // 10) || units[(o_custkey % 45 + 1) % 10 + 1]
    || CASE WHEN o_custkey % 2 = 0 THEN ' Enmienda ' || repeat('X', m // 10) || units[m % 10 + 1] ELSE '' END || ' (' || d || ' ' || months[m] || ' ' || y || ')' AS version
FROM o, u""")
def q24_footer(spark, sf):
    """Footers made from orders: edition and amendment in roman, date, printed label, version text."""
    months = F.array(*[F.lit(m) for m in fixed.MONTHS if m != "setiembre"])
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.year("o_orderdate").alias("y")
    )
    text = lambda c: c.cast("string")
    footer = F.concat(
        F.lit("ADMINISTRACIÓN NACIONAL\n"), text(F.col("o_custkey") % 45 + 1), F.lit("º Edición\n"), text(F.col("d")), F.lit(" "),
        F.initcap(F.element_at(months, F.col("m"))), F.lit(" "), text(F.col("y")), F.lit("\nDE AVIACIÓN CIVIL"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("\n "), text(F.col("o_orderkey") % 500))).otherwise(""), F.lit("\n"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Enmienda "), text(F.col("m")), F.lit("\n"))).otherwise(""),
    )
    header = F.concat(F.lit("APÉNDICE B "), text(F.col("m")), F.lit(". "), text(F.col("d")))
    v = o.select("o_orderkey", L.footer_version(footer).alias("v"), L.printed_label(footer, header).alias("label"))
    return v.select(
        "o_orderkey", "v.edition", "v.amendment", "v.date", "label", L.version_label(F.col("v.edition"), F.col("v.amendment"), F.col("v.date")).alias("version")
    )


def reference_pages(documents):
    """Documents as section pages whose lines carry references: to parts, to section lists, in wrapped clauses."""
    def laid(line, i):
        n = F.length(line)
        num = lambda k: (n % k + 1).cast("string")
        mark = F.lit(fixed.CORPUS + " ")
        added = (
            F.when(i % 4 == 0, F.concat(F.lit(" conforme a la "), mark, num(90), F.lit(" y "), mark, num(7)))
            .when(i % 4 == 1, F.concat(F.lit(" según las Secciones 61."), num(50), F.lit(" (a)(1) o 91. "), num(5)))
            .when(i % 4 == 2, F.concat(F.lit("\n("), F.lit("b"), F.lit(")\nSección 61."), num(50), F.lit(";")))
            .otherwise("")
        )
        return F.concat(line, added)

    text = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), laid), "\n")
    return documents.select(
        F.col("doc_id").cast("string").alias("content_hash"), F.lit("61").alias("part"), F.lit("61.7").alias("section"), F.lit(0).alias("section_ord"),
        F.lit("Título").alias("title"), F.lit(0).alias("page_index"), text.alias("text"),
    )


@query("q23_refs", sql=rf"""
WITH x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)),
ln0 AS (
  SELECT doc_id, i, 0 AS j, CASE i % 4 WHEN 0 THEN line || ' conforme a la {fixed.CORPUS} ' || (length(line) % 90 + 1) || ' y {fixed.CORPUS} ' || (length(line) % 7 + 1)
    WHEN 1 THEN line || ' según las Secciones 61.' || (length(line) % 50 + 1) || ' (a)(1) o 91. ' || (length(line) % 5 + 1) ELSE line END AS t, length(line) AS n FROM x
  UNION ALL SELECT doc_id, i, 1, '(b)', length(line) FROM x WHERE i % 4 = 2
  UNION ALL SELECT doc_id, i, 2, 'Sección 61.' || (length(line) % 50 + 1) || ';', length(line) FROM x WHERE i % 4 = 2),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS l FROM ln0),
fl AS (
  SELECT *, regexp_matches(t, '[.;:]\s*$') AS ends, regexp_matches(t, '^\s*\(?[a-z0-9]{{1,4}}\)\s*$') AS par FROM ln),
hit AS (
  SELECT doc_id, l, 0 AS k, CAST(n % 90 + 1 AS VARCHAR) AS tp, NULL AS ts FROM ln WHERE i % 4 = 0
  UNION ALL SELECT doc_id, l, 1, CAST(n % 7 + 1 AS VARCHAR), NULL FROM ln WHERE i % 4 = 0
  UNION ALL SELECT doc_id, l, 0, '61', '61.' || (n % 50 + 1) FROM ln WHERE i % 4 = 1 OR j = 2
  UNION ALL SELECT doc_id, l, 1, '91', '91.' || (n % 5 + 1) FROM ln WHERE i % 4 = 1),
first AS (
  SELECT doc_id, tp, ts, min(l) AS l FROM hit WHERE (ts IS NULL AND tp <> '61') OR ts <> '61.7' GROUP BY 1, 2, 3),
fr AS (
  SELECT f.*, (SELECT coalesce(max(b.l) + 1, 0) FROM fl b WHERE b.doc_id = f.doc_id AND b.l < f.l AND (b.ends OR b.par)) AS a,
    (SELECT min(e.l) FROM fl e LEFT JOIN fl g ON g.doc_id = e.doc_id AND g.l = e.l + 1 WHERE e.doc_id = f.doc_id AND e.l >= f.l AND (e.ends OR g.l IS NULL OR g.par)) AS z
  FROM first f)
SELECT CAST(fr.doc_id AS VARCHAR) AS content_hash, tp AS to_part, ts AS to_section, md5({S.strip("string_agg(fl.t, chr(10) ORDER BY fl.l)")}) AS clause
FROM fr JOIN fl ON fl.doc_id = fr.doc_id AND fl.l BETWEEN fr.a AND fr.z GROUP BY fr.doc_id, tp, ts""")
def q23_refs(spark, sf):
    """First reference per document and target with the clause around it."""
    refs = R.references(reference_pages(table(spark, sf, "documents")))
    return refs.select("content_hash", "to_part", "to_section", F.md5("text").alias("clause"))
