"""Page text to structure: page versions, sections, definitions.

Windows are keyed by content hash. One content hash is one landed file, read as one value of one
row, so such a group is bounded by a file and never grows with the corpus; copies of a file share
the hash and must be landed once (see ``sources.store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import labels as L
from fojas.functions import text as T


def _place(blocks: DataFrame, text: str, top: str) -> Column:
    in_footer_zone = F.col(top) > fixed.FOOTER_ZONE * F.col("page_height")
    return (
        F.when(F.col(text).rlike(fixed.HEADER), "header")
        .when(in_footer_zone & F.col(text).rlike(fixed.FOOTER), "footer")
        .otherwise("body")
    )


def classified(blocks: DataFrame) -> DataFrame:
    """Text blocks as header, footer or body; images are dropped."""
    texts = blocks.filter(F.col("block_type") == 0)
    return texts.withColumn("place", _place(texts, "text", "y0"))


def pages(blocks: DataFrame) -> DataFrame:
    """One row per page: printed label, version printed in the footer, code in the header.

    Pages with images only are pages too.
    """
    b = blocks.withColumn("place", F.when(F.col("block_type") == 0, _place(blocks, "text", "y0")))
    # A body block only says that its page exists; its text is left behind before rows are sorted into pages.
    b = b.select("content_hash", "pdf_page", "block_no", "place", F.when(F.col("place") != "body", F.col("text")).alias("text"))

    def joined(place: str, after: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("place") == place, F.struct("block_no", "text"))))
        return F.array_join(F.transform(rows, lambda r: F.concat(r["text"], F.lit(after))), "")

    header_code = F.when(F.col("place") == "header", F.regexp_extract("text", fixed.HEADER, 1))
    grouped = b.groupBy("content_hash", "pdf_page").agg(
        joined("footer", "\n").alias("footer"), joined("header", "").alias("header"),
        F.min_by(header_code, F.when(header_code.isNotNull(), F.col("block_no"))).alias("page_code"),
    )
    version = L.footer_version(F.col("footer"))
    return grouped.select(
        "content_hash", "pdf_page", "page_code", L.printed_label(F.col("footer"), F.col("header")).alias("printed_page"),
        version.alias("v"),
    ).select("content_hash", "pdf_page", "page_code", "printed_page", "v.edition", "v.amendment", "v.date")


def parts(page_rows: DataFrame) -> DataFrame:
    """One row per file: part code (first header), page count and the most common edition.

    The edition of a part is for logs; citations use the cited page's footer. Of equally common
    editions the one printed first wins.
    """
    heads = page_rows.groupBy("content_hash").agg(
        F.min_by("page_code", F.when(F.col("page_code").isNotNull(), F.col("pdf_page"))).alias("part"),
        F.count(F.lit(1)).cast("int").alias("page_count"),
    )
    editions = page_rows.filter(F.col("edition").isNotNull()).groupBy("content_hash", "edition", "amendment").agg(
        F.count(F.lit(1)).alias("n"), F.min("pdf_page").alias("first_page")
    )
    common = editions.groupBy("content_hash").agg(
        F.max_by(F.struct("edition", "amendment"), F.struct("n", -F.col("first_page"))).alias("e")
    )
    return heads.join(common, "content_hash", "left").select("content_hash", "part", "page_count", "e.edition", "e.amendment")


def _is_title(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*\p{Lu}") & ~c.rlike(fixed.DIVISION_WORD)


def body_lines(blocks: DataFrame, part_rows: DataFrame) -> DataFrame:
    """Non-blank body lines of every file in reading order, numbered from 0, with what headings are told by.

    ``head``: NULL for a line that cannot head a section, else id (NULL for a range), first_line, title_from and
    body_at. ``run_end``: for a line starting in lowercase the next one that does not; NULL for others. Both come
    from the neighbours of a line, so they are found while the file's lines are together.
    """
    body = classified(blocks).filter(F.col("place") == "body")
    rows = body.select(
        "content_hash", "pdf_page", "block_no", "x0", "y0", "x1", "y1", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")
    ).filter(T.nonblank(F.col("line")))
    # Read from the end, the last line so far that stops a run of lowercase ones is kept from row to row; a frame to the
    # end would be read anew for each. This one sort serves the numbers and the join too.
    from_end = Window.partitionBy("content_hash").orderBy(*[F.desc(c) for c in ("pdf_page", "block_no", "line_no")])
    upto = from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("lower", F.col("line").rlike(r"(?U)^\s*\p{Ll}"))
    told = told.withColumns({"place": F.row_number().over(from_end), "following": F.coalesce(F.lag("line").over(from_end), F.lit(""))})
    told = told.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("content_hash")).cast("int")).withColumn("n", F.col("size") - F.col("place"))
    # A title runs on over lines starting in lowercase: where that stops, from this line on.
    told = told.withColumn("stop", F.coalesce(F.last(F.when(~F.col("lower"), F.col("n")), ignorenulls=True).over(upto), F.col("size")))
    told = told.withColumns({f"stop{k}": F.coalesce(F.lag("stop", k).over(from_end), F.col("size")) for k in (1, 2)})
    named = told.join(part_rows.filter(F.col("part").isNotNull()).select("content_hash", "part"), "content_hash")

    sid = F.concat(F.regexp_replace("part", r"(?U)(\W)", r"\\$1"), F.lit(fixed.SECTION_SUFFIX))

    def pattern(*pieces) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])

    id_only = pattern(r"(?U)^\s*(", sid, r")\s*\z")
    id_title = pattern(r"(?U)^\s*(", sid, r")\s*(?:[–-]\s*|\s)(\S.*)\z")
    id_range = pattern(r"(?Uiu)^\s*", sid, r"\s+al\s+", sid, r"\b")
    # Codes hold no space, so a line without a number in its first word matches none of these patterns.
    pick = lambda p, g: F.when(F.col("numbered"), F.call_function("regexp_extract", F.col("line"), p, F.lit(g))).otherwise("")
    ranged = F.when(F.col("numbered"), F.call_function("regexp_like", F.col("line"), id_range)).otherwise(False)
    told = named.withColumn("numbered", F.col("line").rlike(r"(?U)^\s*\S+\.\d")).withColumns({
        "lone_id": pick(id_only, 1), "titled_id": pick(id_title, 1), "inline_title": pick(id_title, 2), "ranged": ranged,
    })
    is_range = F.col("ranged") | ((F.col("lone_id") != "") & F.col("following").rlike(r"(?Uiu)^\s*al\b"))
    alone = (F.col("lone_id") != "") & F.col("following").rlike(r"(?U)^\s*\p{L}") & ~F.col("following").rlike(fixed.DIVISION_WORD)
    inline = (F.col("titled_id") != "") & _is_title(F.col("inline_title"))
    ranges, lone = F.struct(  # a range only closes a section
        F.lit(None).cast("string").alias("id"), F.lit("").alias("first_line"), (F.col("n") + 1).alias("title_from"), (F.col("n") + 1).alias("body_at")
    ), F.struct(  # a lone id on the last line but one has its title there and no body line left
        F.col("lone_id").alias("id"), F.col("following").alias("first_line"), (F.col("n") + 2).alias("title_from"), F.greatest("stop2", F.col("n") + 2).alias("body_at")
    )
    titled = F.struct(F.col("titled_id").alias("id"), F.col("inline_title").alias("first_line"), (F.col("n") + 1).alias("title_from"), F.col("stop1").alias("body_at"))
    return told.select(
        "content_hash", "part", "n", "pdf_page", "line", "x0", "y0", "x1", "y1",
        F.when(is_range, ranges).when(alone, lone).when(inline, titled).alias("head"), F.when(F.col("lower"), F.col("stop")).alias("run_end"),
    )


def headings(lines: DataFrame) -> DataFrame:
    """Lines that head a section or, as a range of ids, only close one.

    Returns content_hash, at, id (NULL for a range), title, body_at, and whether the heading is an
    index entry instead: one of a run of three or more headings with at most a line between them, but
    not the last of the run; or an id that comes again later.
    """
    found = lines.filter(F.col("head").isNotNull()).select("content_hash", F.col("n").alias("at"), "head.*")
    # Text of wrapped title lines, per run of lowercase lines.
    low = lines.filter(F.col("run_end").isNotNull()).select("content_hash", F.col("run_end").alias("body_at"), "n", "line")
    runs = low.groupBy("content_hash", "body_at").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("run"))
    wrapped = found.join(runs, ["content_hash", "body_at"], "left")
    tail = F.transform(F.filter(F.coalesce("run", F.array()), lambda r: r["n"] >= F.col("title_from")), lambda r: r["line"])
    title = T.collapse(F.array_join(F.concat(F.array("first_line"), tail), " "))
    h = wrapped.select(
        "content_hash", "at", "id", "body_at",
        F.when(F.col("id").isNull(), "").otherwise(title).alias("title"),
    )
    by_place = Window.partitionBy("content_hash").orderBy("at")
    gap = F.col("at") - F.lag("body_at").over(by_place)
    h = h.withColumn("run", F.sum(F.when(gap <= 1, 0).otherwise(1)).over(by_place))
    by_run = Window.partitionBy("content_hash", "run")
    in_run = (F.count(F.lit(1)).over(by_run) >= fixed.MIN_INDEX_RUN) & (F.col("at") != F.max("at").over(by_run))
    again = F.col("id").isNotNull() & (F.col("at") != F.max("at").over(Window.partitionBy("content_hash", "id")))
    h = h.withColumn("next_at", F.lead("at").over(by_place))
    return h.select(
        "content_hash", "at", "id", "title", (in_run | again).alias("is_index"),
        F.coalesce("next_at", "body_at").alias("index_until"),
    )


def section_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Body lines with the section they belong to.

    A heading opens its section and is part of its text; a range or a division heading closes it;
    lines of index entries belong to nothing.
    """
    # Heads are set before their lines as rows of their own, so the lines are exchanged by file alone and stay there.
    h = heads.select(
        "content_hash", F.col("at").alias("n"), F.struct("at", "id", "title", "is_index", "index_until").alias("h")
    )
    order = Window.partitionBy("content_hash").orderBy("n", F.col("line").isNotNull())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.drop("head", "run_end").unionByName(h, allowMissingColumns=True)
    marked = marked.withColumn("last_head", F.last("h", ignorenulls=True).over(upto))
    opens = F.coalesce((F.col("last_head.at") == F.col("n")) & ~F.col("last_head.is_index"), F.lit(False))
    skipped = ~opens & F.coalesce(F.col("last_head.is_index") & (F.col("n") < F.col("last_head.index_until")), F.lit(False))
    divides = ~opens & ~skipped & F.col("line").rlike(fixed.DIVISION)
    marked = marked.withColumn("skipped", skipped).withColumn("divides", divides)
    marker = F.when(opens, F.struct(*[F.col(f"last_head.{f}").alias(f) for f in ("id", "title", "at")])).when(
        F.col("divides"),
        F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.col("n").alias("at")),
    )
    marked = marked.withColumn("open", F.last(marker, ignorenulls=True).over(upto))
    inside = F.col("line").isNotNull() & F.col("open.id").isNotNull() & ~F.col("skipped") & ~F.col("divides")
    return marked.filter(inside).select(
        "content_hash", "part", "n", "pdf_page", F.col("open.id").alias("section"), F.col("open.title").alias("title"),
        F.col("open.at").alias("section_ord"), "line", "x0", "y0", "x1", "y1",
    )


def _page_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a section or definition gathered per page: text and distinct boxes in order."""
    box = F.struct(*[F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("line"), box.alias("box"))))
    grouped = rows.groupBy(*keys, "pdf_page").agg(listed.alias("rows"))
    cleaned = F.filter(F.transform("rows", lambda r: T.clean_block(r["line"])), lambda t: t != "")
    return grouped.select(
        *keys, "pdf_page", F.array_join(cleaned, "\n").alias("text"),
        F.array_distinct(F.transform("rows", lambda r: r["box"])).alias("rects"),
    )


def with_versions(page_texts: DataFrame, page_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Page texts with their printed label and version, numbered within their section."""
    versions = page_rows.select("content_hash", "pdf_page", "printed_page", "edition", "amendment", "date")
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("pdf_page")) - 1  # numbered where the pages are, before the exchange
    return page_texts.withColumn("page_index", index).join(versions, ["content_hash", "pdf_page"], "left")


SECTION_KEYS = ["content_hash", "part", "section", "section_ord", "title"]
DEFINITION_KEYS = ["content_hash", "part", "section", "def_ord", "term"]


def sections_of_lines(lines: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Sections of numbered body lines, one row per section and page."""
    inside = section_lines(lines, headings(lines))
    return with_versions(_page_texts(inside, SECTION_KEYS), page_rows, SECTION_KEYS)


def section_pages(blocks: DataFrame) -> DataFrame:
    """Sections of every file, one row per section and page.

    Reads the blocks several times; ``plans.jobs.parse_corpus`` writes what is used twice instead.
    """
    page_rows = pages(blocks)
    return sections_of_lines(body_lines(blocks, parts(page_rows)), page_rows)


def sections(section_page_rows: DataFrame) -> DataFrame:
    """One row per section: pages in order, first and last page, text."""
    page = F.struct("page_index", "pdf_page", "printed_page", "edition", "amendment", "date", "text", "rects")
    grouped = section_page_rows.groupBy(*SECTION_KEYS).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return grouped.select(
        *SECTION_KEYS, "pages", F.element_at("pages", 1)["pdf_page"].alias("pdf_page_start"),
        F.element_at("pages", -1)["pdf_page"].alias("pdf_page_end"), F.array_join("pages.text", "\n").alias("text"),
    )


def definition_lines(page_lines: DataFrame, section_page_rows: DataFrame) -> DataFrame:
    """Lines of the definitions section with the definition they belong to.

    A definition starts at the page's left margin with a bold term up to a colon. Lines before the
    section's own heading and from the closing title on belong to none.
    """
    held = section_page_rows.filter(
        (F.col("part") == fixed.DEFINITIONS_PART) & (F.col("section") == fixed.DEFINITIONS_SECTION)
    ).groupBy("content_hash", "part").agg(F.min("pdf_page").alias("from_page"), F.max("pdf_page").alias("to_page"))
    placed = page_lines.withColumn("place", _place(page_lines, "block_text", "block_y0"))
    rows = placed.filter((F.col("place") == "body") & T.nonblank(F.col("text"))).join(held, "content_hash")
    rows = rows.filter(F.col("pdf_page").between(F.col("from_page"), F.col("to_page")))
    rows = rows.withColumn("line", T.collapse(F.col("text")))
    rows = rows.withColumn("margin", F.min("x0").over(Window.partitionBy("content_hash", "pdf_page")))
    order = Window.partitionBy("content_hash").orderBy("pdf_page", "block_no", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("line").rlike(r"(?U)^" + fixed.DEFINITIONS_SECTION.replace(".", r"\.") + r"\b")
    rows = rows.withColumn("started", F.coalesce(F.max(heading).over(earlier), F.lit(False)))
    rows = rows.withColumn("ended", F.max(F.col("started") & F.col("line").rlike(fixed.DEFINITIONS_END)).over(upto))
    term = F.regexp_extract("line", r"(?U)^\s*(\p{L}[^:]*):", 1)
    begins = (
        F.col("started") & (F.col("flags").bitwiseAND(fixed.BOLD_FLAG) != 0) & (term != "")
        & (F.col("x0") <= F.col("margin") + fixed.MARGIN_TOLERANCE)
    )
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    rows = rows.withColumn("opens", F.when(begins, F.struct(F.col("n").alias("def_ord"), T.collapse(term).alias("term"))))
    rows = rows.withColumn("d", F.last("opens", ignorenulls=True).over(upto))
    return rows.filter(F.col("started") & ~F.col("ended") & F.col("d").isNotNull()).select(
        "content_hash", "part", F.lit(fixed.DEFINITIONS_SECTION).alias("section"), "d.def_ord", "d.term", "n", "pdf_page", "line", "bbox.*"
    )


def definition_pages(page_lines: DataFrame, section_page_rows: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Definitions, one row per definition and page."""
    rows = definition_lines(page_lines, section_page_rows)
    return with_versions(_page_texts(rows, DEFINITION_KEYS), page_rows, DEFINITION_KEYS)


def definitions(definition_page_rows: DataFrame) -> DataFrame:
    page = F.struct("page_index", "pdf_page", "printed_page", "edition", "amendment", "date", "text", "rects")
    grouped = definition_page_rows.groupBy(*DEFINITION_KEYS).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return grouped.select(*DEFINITION_KEYS, "pages", F.array_join("pages.text", "\n").alias("text"))


def quality(part_rows: DataFrame, section_rows: DataFrame, definition_rows: DataFrame | None = None) -> DataFrame:
    """What is missing from each file: code, edition, sections, or enough definitions."""
    counts = section_rows.groupBy("content_hash").agg(F.countDistinct("section_ord").alias("n_sections"))
    q = part_rows.join(counts, "content_hash", "left")
    if definition_rows is None:
        q = q.withColumn("n_definitions", F.lit(None).cast("bigint"))
    else:
        q = q.join(
            definition_rows.groupBy("content_hash").agg(F.countDistinct("def_ord").alias("n_definitions")), "content_hash", "left"
        )
    holds = F.col("part") == fixed.DEFINITIONS_PART
    checked = definition_rows is not None
    return q.select(
        "content_hash", "part", F.coalesce("n_sections", F.lit(0)).alias("n_sections"),
        F.when(F.col("part").isNull(), "no part code in any header").when(F.col("edition").isNull(), "no edition in any footer")
        .when(F.col("n_sections").isNull(), "no sections")
        .when(F.lit(checked) & holds & (F.coalesce("n_definitions", F.lit(0)) < fixed.MIN_DEFINITIONS), "too few definitions")
        .alias("error"),
    )
