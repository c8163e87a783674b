"""Stage inputs derived from the given tables, so every query grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(documents: DataFrame) -> DataFrame:
    """Documents as answer texts: answer_id, lang, n_chars, source, text."""
    return documents.select(F.col("doc_id").cast("string").alias("answer_id"), "lang", "n_chars", "source", "text")


def turns(conversations: DataFrame) -> DataFrame:
    """Conversation turns in the shape of ``texts``."""
    answer_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return conversations.select(
        answer_id.alias("answer_id"), F.col("role").alias("lang"), F.length("text").cast("bigint").alias("n_chars"),
        F.col("role").alias("source"), "text",
    )


def document_lines(documents: DataFrame):
    """The non-blank lines of a document, as an array expression."""
    return F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")


def answer_content(documents: DataFrame):
    """The content blocks of one recorded answer per text: every second line is a cited span, the others are prose.

    Prose lines whose number divides by three open a list item. The language stands for the verdict:
    German texts cover nothing, French ones a part.
    """
    verdict = (
        F.when(F.col("lang") == "de", "ninguna - lo regula la Parte 67.")
        .when(F.col("lang") == "fr", "parcial - lo regula la Parte 67.")
        .otherwise("total")
    )

    def block(text, citations=None):
        none = F.lit(None).cast(
            "array<struct<type:string,cited_text:string,document_index:int,start_block_index:int,end_block_index:int>>"
        )
        return F.struct(F.lit("text").alias("type"), text.alias("text"), (none if citations is None else citations).alias("citations"))

    def citation(line, n):
        return F.array(
            F.struct(
                F.lit("content_block_location").alias("type"), line.alias("cited_text"),
                (n % 2).cast("int").alias("document_index"), (n % 3).cast("int").alias("start_block_index"),
                (n % 3 + 1).cast("int").alias("end_block_index"),
            )
        )

    def blocks(line, i):
        n = i + 1
        prose = block(F.concat(F.when(n % 3 == 0, "- ").otherwise(""), line))
        return F.array(F.when(n % 2 == 0, block(line, citation(line, n / 2))).otherwise(prose), block(F.lit("\n")))

    opening = block(F.concat(F.lit("COBERTURA: "), verdict, F.lit("\n\n")))
    return F.concat(F.array(opening), F.flatten(F.transform(document_lines(documents), blocks)))


def answer_responses(documents: DataFrame) -> DataFrame:
    """Recorded answers (see ``answer_content``) as raw JSON responses."""
    content = answer_content(documents).alias("content")
    raw = F.to_json(F.struct(F.lit("m").alias("model"), F.lit("end_turn").alias("stop_reason"), content))
    return documents.select("answer_id", raw.alias("raw"))


def answer_documents(documents: DataFrame) -> DataFrame:
    """Two retrieved sections per document, three pages each, both referring to part 67."""

    def page(p):
        return F.struct(
            (F.col("n_chars") % 50 + p).cast("int").alias("pdf_page"), p.cast("string").alias("printed_page"),
            F.lit("VI").alias("edition"), F.lit(None).cast("string").alias("amendment"), F.lit("mayo 2026").alias("date"),
        )

    pages = F.transform(F.sequence(F.lit(1), F.lit(3)), page)

    def section(index, part):
        p = page(F.lit(index + 1))
        ref = F.struct(
            F.lit("67").alias("to_part"), *[p[f].alias(f) for f in ("pdf_page", "printed_page", "edition", "amendment", "date")],
            F.concat(F.lit("bajo la 67; "), F.col("source")).alias("text"),
        )
        return F.struct(
            F.lit(index).alias("document_index"), F.lit(part).alias("part"),
            F.concat(F.lit(part + "."), F.col("answer_id")).alias("section"), F.col("source").alias("title"),
            F.lit(None).cast("string").alias("term"), F.concat(F.lit("https://example.org/"), F.lit(part)).alias("source_url"),
            pages.alias("pages"), F.array(ref).alias("refs"),
        )

    both = F.explode(F.array(section(0, "61"), section(1, "91"))).alias("d")
    return documents.select("answer_id", both).select("answer_id", "d.*")
