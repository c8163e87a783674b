"""From the pages a search read to sections, tree nodes and definitions, per question."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.operators.overlaps import overlapping


def page_reads(events: DataFrame) -> DataFrame:
    """(question_id, part, spec) of events that read pages; arguments are JSON or JSON in a string."""
    reads = events.filter((F.col("type") == fixed.PAGE_READ_TYPE) & (F.col("name") == fixed.PAGE_READ_NAME))
    plain = F.get_json_object("arguments", "$.pages")
    quoted = F.get_json_object(F.get_json_object("arguments", "$"), "$.pages")
    return reads.select("question_id", "part", F.coalesce(plain, quoted, F.lit("")).alias("spec"))


def ranges_read(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct (question_id, part, content_hash, from_page, to_page) read, within the pages a part has.

    ``parts``: loaded parts with content_hash and page_count. Ranges stay ranges, so a spec such as
    1-999999999 costs no more than one page, however many pages the part has.
    """
    span = F.filter(F.split(F.replace("spec", F.lit(" "), F.lit("")), ","), lambda x: x.rlike(r"^\d+(-\d*)?\z"))
    ranges = page_reads(events).select("question_id", "part", F.explode(F.array_distinct(span)).alias("r")).distinct()
    low = F.regexp_extract("r", r"^(\d+)", 1)
    high = F.coalesce(F.nullif(F.regexp_extract("r", r"-(\d+)\z", 1), F.lit("")), low)
    # a number beyond 38 digits is beyond every page
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS DECIMAL(38, 0))"), F.lit(2**62))
    loaded = parts.select("part", "content_hash", "page_count")
    joined = ranges.withColumns({"low": low, "high": high}).join(loaded, "part").select(
        "question_id", "part", "content_hash", F.greatest(number("low"), F.lit(1)).alias("a"), F.least(number("high"), F.col("page_count")).alias("b"),
    ).filter(F.col("a") <= F.col("b"))
    return joined.select("question_id", "part", "content_hash", F.col("a").cast("bigint").alias("from_page"), F.col("b").cast("bigint").alias("to_page")).distinct()


def _on_pages(read: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranges read with the rows (content_hash, pdf_page, ...) on their pages."""
    return overlapping(read, rows, ["content_hash"], ("from_page", "to_page"), ("pdf_page", "pdf_page"))


def sections_on_pages(read: DataFrame, section_pages: DataFrame) -> DataFrame:
    """Sections with any of the pages read."""
    held = section_pages.select("content_hash", "section_ord", "section", "pdf_page")
    return _on_pages(read, held).select("question_id", "part", "content_hash", "section_ord", "section").distinct()


def section_classes(section_pages: DataFrame, alike: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Sections on the same pages of a file as one, since whoever reads one of them reads all.

    Returns the classes in the shape of ``section_pages``, each named by the place of its first section, and
    (content_hash, section_ord, first_ord, last_ord, n_sections, ord_sum) with what they hold, by ``alike``, further
    columns of sections, if given. Totals over sections so need a row for each class that a question reads, not for
    each section. Definitions sections stay by themselves.
    """
    own = F.max(F.when(F.col("section") == fixed.DEFINITIONS_SECTION, F.col("section")))
    placed = section_pages.groupBy("content_hash", "section_ord", *alike).agg(F.array_sort(F.collect_set("pdf_page")).alias("pages"), own.alias("section"))
    held = placed.groupBy("content_hash", "pages", "section", *alike).agg(
        F.min("section_ord").alias("first_ord"), F.max("section_ord").alias("last_ord"), F.count(F.lit(1)).alias("n_sections"), F.sum("section_ord").alias("ord_sum")
    )
    held = held.withColumn("section_ord", F.min("first_ord").over(Window.partitionBy("content_hash", "pages", "section")))
    classes = held.select("content_hash", "section_ord", "section", "pages").distinct()
    return classes.select("content_hash", "section_ord", "section", F.explode("pages").alias("pdf_page")), held.drop("pages", "section")


def visited_nodes(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves covering a page read, as part:node."""
    leaves = nodes.filter("is_leaf").select("content_hash", "start_index", "end_index", "node_id", "preorder")
    met = overlapping(read, leaves, ["content_hash"], ("from_page", "to_page"), ("start_index", "end_index"))
    return met.select("question_id", "part", "content_hash", "preorder", F.concat_ws(":", "part", "node_id").alias("node")).distinct()


def node_sections(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Nodes with the sections that start on their pages, in document order."""
    starts = sections.select("content_hash", "section", "section_ord", F.col("pdf_page_start").alias("pdf_page"))
    spans = nodes.select("content_hash", "node_id", "start_index", "end_index")
    hits = overlapping(spans, starts, ["content_hash"], ("start_index", "end_index"), ("pdf_page", "pdf_page"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "section"))), lambda s: s["section"])
    return hits.groupBy("content_hash", "node_id").agg(listed.alias("sections"))


def flatten_trees(trees: DataFrame, root: str, levels: int = 16) -> DataFrame:
    """Nested trees (part, content_hash, tree as a JSON array) of any depth as node rows in preorder.

    Each round opens ``levels`` levels within a row and hands the nodes below them on, a row each, until none is
    left; rounds are written under ``root``, a folder all executors share. ``path`` holds the place on every
    level, and sorts a node before its children. A null tree has no nodes.
    """
    node = "struct<path:array<int>,parent_id:string,node:variant>"
    opened_node = "struct<path:array<int>,parent_id:string,node_id:string,title:string,start_index:int,end_index:int,is_leaf:boolean>"
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$.nodes", "array<variant>"), F.array().cast("array<variant>"))
    value = lambda x, k, t: F.variant_get(x, f"$.{k}", t).alias(k)

    def children(x: Column) -> Column:
        return F.transform(
            inner(x["node"]), lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), value(x["node"], "node_id", "string").alias("parent_id"), c.alias("node"))
        )

    def shown(x: Column) -> Column:
        n = x["node"]
        scalars = [value(n, k, t) for k, t in (("node_id", "string"), ("title", "string"), ("start_index", "int"), ("end_index", "int"))]
        return F.struct(x["path"].alias("path"), x["parent_id"].alias("parent_id"), *scalars, (F.size(inner(n)) == 0).alias("is_leaf"))

    top = F.variant_get(F.parse_json("tree"), "$", "array<variant>")
    first = F.transform(top, lambda c, i: F.struct(F.array(i).alias("path"), F.lit(None).cast("string").alias("parent_id"), c.alias("node")))
    frontier = trees.select("part", "content_hash", F.explode(first).alias("x"))
    done = None
    for turn in itertools.count():
        state = F.struct(F.array(F.col("x").cast(node)).alias("level"), F.array().cast(f"array<{opened_node}>").alias("done"))
        opened = F.aggregate(
            F.sequence(F.lit(1), F.lit(levels)), state,
            lambda s, _: F.struct(F.flatten(F.transform(s["level"], children)).alias("level"), F.concat(s["done"], F.transform(s["level"], shown)).alias("done")),
        )
        path = f"{root}/trees{turn:06d}"
        frontier.select("part", "content_hash", opened.alias("o")).select("part", "content_hash", "o.*").write.mode("overwrite").parquet(path)
        table = trees.sparkSession.read.parquet(path)
        rows = table.select("part", "content_hash", F.explode("done").alias("n")).select("part", "content_hash", "n.*")
        done = rows if done is None else done.unionByName(rows)
        frontier = table.filter(F.size("level") > 0).select("part", "content_hash", F.explode("level").alias("x"))
        if frontier.isEmpty():
            break
    preorder = F.row_number().over(Window.partitionBy("content_hash").orderBy("path")) - 1
    return done.withColumn("preorder", preorder).drop("path")


def retrieve(
    routes: DataFrame, events: DataFrame, parts: DataFrame, section_pages: DataFrame, definition_pages: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Sections and directly read definitions of every question, in prompt order.

    ``routes``: question_id, part, route_rank; only routed, loaded parts are searched. Where pages of
    the definitions section were read, the definitions on them stand in for the section.
    """
    routed = events.join(routes.select("question_id", "part"), ["question_id", "part"], "left_semi")
    read = ranges_read(routed, parts)
    found = sections_on_pages(read, section_pages)
    holders = definition_pages.select("content_hash").distinct().withColumn("holds", F.lit(True))
    marked = found.join(holders, "content_hash", "left")
    holder = F.coalesce(F.col("holds"), F.lit(False)) & (F.col("section") == fixed.DEFINITIONS_SECTION)
    # Sections are ordered by route, then by their place in the document: a sortable number, so that no
    # question has to be gathered to number them. Prompts number their own few documents later.
    rank = F.shiftleft(F.col("route_rank").cast("bigint"), 32) + F.col("section_ord")
    ranks = routes.select("question_id", "part", "route_rank")
    sections = (
        marked.filter(~holder).drop("holds").join(ranks, ["question_id", "part"])
        .withColumn("rank", rank).drop("route_rank")
    )
    opened = marked.filter(holder).select("question_id", "content_hash").distinct()
    defs = definition_pages.select("content_hash", "section", "def_ord", "term", "pdf_page")
    opened_pages = read.join(opened, ["question_id", "content_hash"], "left_semi")
    definitions = _on_pages(opened_pages, defs).select("question_id", "part", "content_hash", "section", "def_ord", "term").distinct()
    return sections, definitions


def with_attached(read: DataFrame, attached: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions of every question: those read first, then attached ones that were not read."""
    info = definitions.select("content_hash", "part", "section", "def_ord", "term").distinct()
    more = attached.withColumnRenamed("def_hash", "content_hash").join(info, ["content_hash", "def_ord"]).join(read.select("question_id", "content_hash", "def_ord"), ["question_id", "content_hash", "def_ord"], "left_anti")
    both = read.withColumn("source", F.lit(0)).withColumn("def_rank", F.col("def_ord")).unionByName(
        more.select("question_id", "part", "content_hash", "section", "def_ord", "term", "def_rank").withColumn("source", F.lit(1))
    )
    place = Window.partitionBy("question_id").orderBy("source", "def_rank")
    return both.withColumn("rank", F.row_number().over(place) - 1).drop("source", "def_rank")


def prompt_documents(
    sections: DataFrame, definitions: DataFrame, section_rows: DataFrame, definition_rows: DataFrame,
    references: DataFrame, urls: DataFrame,
) -> DataFrame:
    """Documents of every answer in prompt order: sections, then definitions.

    Carries page places and versions and the references to other parts, not the page texts: what
    grounding needs to resolve citations. ``urls``: part, source_url.
    """
    place = lambda p: F.struct(*[p[f].alias(f) for f in ("pdf_page", "printed_page", "edition", "amendment", "date")])
    light = section_rows.select("content_hash", "section_ord", "title", F.transform("pages", place).alias("pages"))
    refs = references.filter(F.col("to_section").isNull()).join(
        section_rows.select("content_hash", "section_ord", F.posexplode("pages").alias("page_index", "p")), ["content_hash", "section_ord", "page_index"]
    )
    ref = F.struct("to_part", *[F.col(f"p.{f}").alias(f) for f in ("pdf_page", "printed_page", "edition", "amendment", "date")], F.col("text").alias("text"))
    packed = refs.groupBy("content_hash", "section_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_index", "at", "item", ref.alias("ref")))), lambda r: r["ref"]).alias("refs")
    )
    kind = dict((f.name, f.dataType) for f in packed.schema.fields)["refs"]
    docs = (
        sections.join(light, ["content_hash", "section_ord"]).join(packed, ["content_hash", "section_ord"], "left")
        .select("question_id", F.lit(0).alias("kind"), "rank", "part", "section", "title", F.lit(None).cast("string").alias("term"), "pages", "refs")
    )
    defs = definitions.drop("part", "section", "term").join(
        definition_rows.select("content_hash", "def_ord", "part", "section", "term", F.transform("pages", place).alias("pages")), ["content_hash", "def_ord"]
    ).select(
        "question_id", F.lit(1).alias("kind"), "rank", "part", "section", F.lit(None).cast("string").alias("title"), "term", "pages",
        F.lit(None).cast(kind).alias("refs"),
    )
    order = Window.partitionBy("question_id").orderBy("kind", "rank")
    both = docs.unionByName(defs).join(urls.select("part", "source_url"), "part", "left")
    return both.select(
        F.col("question_id").alias("answer_id"), (F.row_number().over(order) - 1).cast("int").alias("document_index"),
        "part", "section", "title", "term", "source_url", "pages", "refs",
    )


def replayed(refs: DataFrame, parts: DataFrame, section_rows: DataFrame, definition_rows: DataFrame) -> DataFrame:
    """Recorded references (question_id, rank, part, section, term) as loaded rows.

    ``error`` names what is not loaded: the part, the section, or the term.
    """
    loaded = parts.select("part", "content_hash")
    s = section_rows.select("content_hash", "section", "section_ord").groupBy("content_hash", "section").agg(F.min("section_ord").alias("section_ord"))
    d = definition_rows.select("content_hash", "section", "term", "def_ord").groupBy("content_hash", "section", "term").agg(F.min("def_ord").alias("def_ord"))
    joined = refs.join(loaded, "part", "left").join(s, ["content_hash", "section"], "left").join(
        d.withColumnRenamed("term", "d_term"),
        (refs["term"] == F.col("d_term")) & (loaded["content_hash"] == d["content_hash"]) & (refs["section"] == d["section"]), "left",
    ).select(refs["question_id"], refs["rank"], refs["part"], refs["section"], refs["term"], loaded["content_hash"], "section_ord", "def_ord")
    return joined.withColumn(
        "error",
        F.when(F.col("content_hash").isNull(), F.concat(F.lit("part not loaded: "), "part"))
        .when(F.col("term").isNull() & F.col("section_ord").isNull(), F.concat(F.lit("no such section: "), "section"))
        .when(F.col("term").isNotNull() & F.col("def_ord").isNull(), F.concat(F.lit("no such definition: "), "term")),
    )
