"""Cross-references: which parts and sections a section's text points to, and the clause that does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T


def _only_heading(line: Column, heading: Column) -> Column:
    first = F.regexp_extract(line, r"(?U)\S+", 0)  # most lines are told by their first word
    own = F.array_except(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""), heading)
    return (first != "") & F.array_contains(heading, first) & (F.size(own) == 0)


def _line_marks(lines: Column, heading: Column) -> Column:
    """(ended, marks, closes) for every line: whether a clause ends with it, whether it is a paragraph mark, and whether
    a clause can only start after it."""
    found = F.transform(lines, lambda x: F.struct(x.rlike(fixed.CLAUSE_END).alias("ended"), x.rlike(fixed.PARAGRAPH_LINE).alias("marks"), x.alias("line")))
    return F.transform(found, lambda x: F.struct(
        x["ended"].alias("ended"), x["marks"].alias("marks"), (x["ended"] | x["marks"] | _only_heading(x["line"], heading)).alias("closes")
    ))


def _clause() -> Column:
    """The lines around a match, widened to its clause but never into the heading.

    Backwards up to a line that ends a clause, is a paragraph mark, or only repeats the heading;
    forwards to a line that ends the clause or stands before a paragraph mark. Uses the page's
    ``lines``, ``closes`` and ``ends``, and ``first`` and ``last``, the lines in which the match starts and ends.
    """
    first, last = F.col("first"), F.col("last")
    back = F.array_position(F.reverse(F.slice("closes", F.lit(1), first)), F.lit(True))
    start = F.when(back > 0, first - back + 1).otherwise(0)
    ahead = F.array_position(F.slice("ends", last + 1, F.size("lines")), F.lit(True))
    stop = last + ahead - 1
    taken = F.slice("lines", start.cast("int") + 1, (stop - start + 1).cast("int"))
    return T.strip(F.array_join(taken, "\n"))


def references(section_pages: DataFrame) -> DataFrame:
    """First reference per section and target, with its clause, in text order.

    ``section_pages``: content_hash, part, section, section_ord, title, page_index, text. Targets are
    other parts, and sections of any part but never the section itself.
    """
    heading = F.array_union(F.array("section"), F.filter(F.split("title", r"(?U)\s+"), lambda w: w != ""))
    split = section_pages.select(
        "content_hash", "part", "section", "section_ord", "page_index", "text", heading.alias("heading"), F.split("text", "\n").alias("lines")
    )
    marked = split.select(
        "content_hash", "part", "section", "section_ord", "page_index", "lines", _line_marks(F.col("lines"), F.col("heading")).alias("marked"),
        T.matches_at(F.col("text"), fixed.REFERENCE, grouped=False).alias("matches"),
    )
    # A clause ends with a line that says so, before a paragraph mark, and with the last line.
    following = F.slice("marked", F.lit(2), F.size("marked"))
    pages = marked.select(
        "content_hash", "part", "section", "section_ord", "page_index", "lines", "matches", F.col("marked.closes").alias("closes"),
        F.zip_with("marked", following, lambda x, y: y.isNull() | y["marks"] | x["ended"]).alias("ends"),
    )

    # The codes and ids of the match are those of its list: what comes before that holds none.
    target = "struct<to_part:string,to_section:string>"
    to_parts = lambda t: F.transform(T.codes_in(t), lambda code: F.struct(code, F.lit(None).cast("string")).cast(target))
    to_sections = lambda t: F.transform(T.section_ids_in(t), lambda s: F.struct(s["part"], F.concat_ws(".", s["part"], s["number"])).cast(target))
    targets = F.flatten(
        F.transform(
            "matches",
            lambda m: F.transform(
                F.when(m["text"].rlike(fixed.SECTION_HEAD), to_sections(m["text"])).otherwise(to_parts(m["text"])),
                lambda x, i: F.struct(
                    x["to_part"].alias("to_part"), x["to_section"].alias("to_section"), m["at"].alias("at"), i.alias("item"),
                    m["line"].alias("first"), (m["line"] + T.line_breaks(m["text"])).alias("last"),
                ),
            ),
        )
    )
    found = pages.select(
        "content_hash", "part", "section", "section_ord", "page_index", "lines", "closes", "ends",
        F.inline(targets),
    ).filter(
        (F.col("to_section").isNull() & (F.col("to_part") != F.col("part")))
        | (F.col("to_section").isNotNull() & (F.col("to_section") != F.col("section")))
    )
    # The clause is cut before the aggregation, so only it is shuffled and not the page; the first
    # per target is an aggregate, so repeats are combined before the shuffle.
    cut = found.select(
        "content_hash", "part", "section", "section_ord", "to_part", "to_section", "page_index", "at", "item", _clause().alias("clause")
    )
    first = cut.groupBy("content_hash", "part", "section", "section_ord", "to_part", "to_section").agg(
        F.min(F.struct("page_index", "at", "item", "clause")).alias("m")
    )
    return first.select(
        "content_hash", "part", "section", "section_ord", "to_part", "to_section", "m.page_index", "m.at", "m.item", F.col("m.clause").alias("text")
    )


def part_references(references: DataFrame) -> DataFrame:
    """References to other parts as a whole."""
    return references.filter(F.col("to_section").isNull())
