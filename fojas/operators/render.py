"""Answers as readers see them: blocks, numbered citations, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import labels as L
from fojas.functions import text as T


def layout(sentences: DataFrame) -> DataFrame:
    """Block number and kind (paragraph or list) and item number of every sentence of an answer.

    An item continues an open list or opens one; a paragraph mark, or the first sentence, opens a
    paragraph; any other sentence joins what is open.
    """
    order = Window.partitionBy("answer_id").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opener = (
        F.when(F.col("starts") == "item", F.lit("list"))
        .when((F.col("starts") == "paragraph") | (F.col("ord") == F.min("ord").over(Window.partitionBy("answer_id"))), F.lit("paragraph"))
    )
    s = sentences.withColumn("opener", opener)
    s = s.withColumn("kind", F.last("opener", ignorenulls=True).over(upto))
    opens = (F.col("opener") == "paragraph") | (
        (F.col("opener") == "list") & (F.coalesce(F.lag("kind").over(order), F.lit("paragraph")) == "paragraph")
    )
    s = s.withColumn("block", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(upto))
    s = s.withColumn("item", F.sum(F.coalesce(F.col("starts") == "item", F.lit(False)).cast("int")).over(upto))
    return s.drop("opener")


def _key(c: Column) -> Column:
    return F.struct(
        c["part"].alias("part"), c["section"].alias("section"), c["term"].alias("term"),
        c["pdf_page_start"].alias("a"), c["pdf_page_end"].alias("b"),
    )


def render(answers: DataFrame) -> DataFrame:
    """answer_id and the text shown: notice, status line, body with marks, numbered citations.

    An answer is one row, so numbering by first appearance is the position in a distinct array.
    """
    likely_cites = F.transform("likely_parts", lambda p: F.array(p["citation"]))
    groups = F.concat(F.transform("sentences", lambda s: s["citations"]), likely_cites)
    a = answers.withColumn("flat", F.flatten(groups))
    a = a.withColumn("keys", F.array_distinct(F.transform("flat", _key)))

    def marked(text: Column, cites: Column) -> Column:
        marks = F.array_distinct(F.transform(cites, lambda c: F.array_position("keys", _key(c))))
        shown = F.array_join(F.transform(marks, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
        return F.when(F.size(cites) > 0, F.concat(text, F.lit(" "), shown)).otherwise(text)

    def laid(s: Column) -> Column:
        lead = F.when(s["starts"] == "paragraph", "\n").when(s["starts"] == "item", "\n- ").otherwise(" ")
        return F.concat(lead, marked(s["text"], s["citations"]))

    body = F.regexp_replace(F.array_join(F.transform("sentences", laid), ""), "^ ", "")
    likely = F.transform(
        "likely_parts",
        lambda p: marked(
            T.fill_template(fixed.LIKELY_PART, part=p["part"], section=p["citation"]["section"]), F.array(p["citation"])
        ),
    )
    status = F.when(F.col("refused"), fixed.REFUSAL).when(F.col("incomplete"), fixed.INCOMPLETE)
    shown = F.array_join(F.concat(F.array(status, F.nullif(body, F.lit(""))), likely), " ")
    firsts = F.transform("keys", lambda k: F.element_at(F.filter("flat", lambda c: _key(c) == k), 1))
    lines = F.transform(firsts, lambda c, i: L.citation_line(i + 1, c))
    text = F.concat(
        F.lit(fixed.NOTICE + "\n\n"), shown,
        F.when(
            F.size("keys") > 0,
            F.concat(F.lit("\n\n" + fixed.CITATIONS_HEADER + "\n"), F.array_join(lines, "\n")),
        ).otherwise(""),
    )
    return a.select("answer_id", text.alias("text"))


def judged_text(answers: DataFrame) -> DataFrame:
    """The answer as a reader reads it, without citation marks."""
    status = F.when(F.col("refused"), fixed.REFUSAL).when(F.col("incomplete"), fixed.INCOMPLETE)
    likely = F.transform(
        "likely_parts", lambda p: T.fill_template(fixed.LIKELY_PART, part=p["part"], section=p["citation"]["section"])
    )
    parts = F.concat(F.array(status), F.col("sentences.text"), likely)
    return answers.select("answer_id", F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ").alias("text"))


def citation_index(citations: DataFrame, keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    """Per answer and cited section its distinct cited texts, both in order of first citation.

    Aggregates to distinct texts before the list is built, so repeats never reach one task.
    """
    texts = citations.groupBy(*keys, "part", "section", "cited_text").agg(
        F.min(F.struct("ord", "citation_ord")).alias("first_cited")
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_cited", "cited_text"))), lambda x: x["cited_text"])
    return texts.groupBy(*keys, "part", "section").agg(
        F.min("first_cited").alias("first_cited"), listed.alias("cited_texts")
    )
