"""Request rows for the model calls, as JSON. The calls are made elsewhere; their prompts are given.

A request must fit one call, so everything gathered into one here is bounded by that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import labels as L
from fojas.functions import text as T


def _message(content: Column, role: str = "user") -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _texts(pages: str | Column) -> Column:
    return F.transform(pages, lambda p: F.struct(F.lit("text").alias("type"), p["text"].alias("text")))


def prompt_blocks(sections: DataFrame, definitions: DataFrame, section_rows: DataFrame, definition_rows: DataFrame) -> DataFrame:
    """One document block per section, then per definition: a text per PDF page, title, version.

    ``sections`` and ``definitions``: question_id, rank and the keys of their rows. The version comes
    from the footer of the first page and is left out where that prints none.
    """
    context = lambda: F.nullif(
        L.footer_context(F.col("pages")[0]["edition"], F.col("pages")[0]["amendment"], F.col("pages")[0]["date"]), F.lit("")
    )

    def block(title: Column) -> Column:
        return F.struct(
            F.lit("document").alias("type"),
            F.struct(F.lit("content").alias("type"), _texts("pages").alias("content")).alias("source"),
            title.alias("title"), context().alias("context"), F.struct(F.lit(True).alias("enabled")).alias("citations"),
        )

    s = sections.select("question_id", "rank", "content_hash", "section_ord").join(section_rows, ["content_hash", "section_ord"])
    s_title = T.fill_template(fixed.CORPUS + " Parte {p} - Sección {s} {t}", p=F.col("part"), s=F.col("section"), t=F.col("title"))
    d = definitions.select("question_id", "rank", "content_hash", "def_ord").join(definition_rows, ["content_hash", "def_ord"])
    d_title = T.fill_template(fixed.CORPUS + " Parte {p} - Sección {s} - Definición: {t}", p=F.col("part"), s=F.col("section"), t=F.col("term"))
    return s.select("question_id", F.lit(0).alias("kind"), "rank", block(s_title).alias("block")).unionByName(
        d.select("question_id", F.lit(1).alias("kind"), "rank", block(d_title).alias("block"))
    )


def answer_requests(questions: DataFrame, blocks: DataFrame, model: str, system: str, max_tokens: int = 16000) -> DataFrame:
    """(question_id, request): documents in prompt order, then the question. No section, no request."""
    docs = blocks.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", F.to_json("block").alias("json")))), lambda x: x["json"]).alias("docs"),
        F.count_if(F.col("kind") == 0).alias("n_sections"),
    )
    asked = questions.join(docs.filter("n_sections > 0"), "question_id")
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.col("question").alias("text")))
    head = json.dumps({"model": model, "max_tokens": max_tokens, "system": system}, ensure_ascii=False)[:-1]
    request = F.concat(
        F.lit(head + ', "messages": [{"role": "user", "content": ['), F.array_join(F.concat("docs", F.array(text)), ","), F.lit("]}]}")
    )
    return asked.select("question_id", request.alias("request"))


def part_cards(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """What routing sees of each part: code, title, summary, titles of its top divisions.

    ``parts``: part, title, description.
    """
    tops = nodes.filter(F.col("parent_id").isNull()).groupBy("part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("preorder", "title"))), lambda n: n["title"]).alias("divisions")
    )
    return parts.join(tops, "part", "left").select(
        "part", "title", F.left(F.coalesce("description", F.lit("")), F.lit(fixed.MAX_SUMMARY_CHARS)).alias("summary"),
        F.coalesce("divisions", F.array().cast("array<string>")).alias("divisions"),
    )


def card_text() -> Column:
    return T.fill_template(
        '<parte codigo="{c}">\nTítulo: {t}\nResumen: {s}\nDivisiones: {d}\n</parte>',
        c=F.col("part"), t=F.col("title"), s=F.col("summary"), d=F.array_join("divisions", "; "),
    )


def catalog(cards: DataFrame) -> DataFrame:
    """All cards as one row: the text a routing prompt opens with and the codes it may answer."""
    rows = F.array_sort(F.collect_list(F.struct("part", card_text().alias("text"))))
    return cards.agg(
        F.struct(
            F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"),
            F.transform(rows, lambda r: r["part"]).alias("codes"), F.count(F.lit(1)).alias("n"),
        ).alias("catalog")
    )


def _schema(properties: list[tuple[str, Column]]) -> Column:
    return F.struct(
        F.struct(
            F.lit("json_schema").alias("type"),
            F.struct(
                F.lit("object").alias("type"), F.struct(*[c.alias(n) for n, c in properties]).alias("properties"),
                F.array(*[F.lit(n) for n, _ in properties]).alias("required"), F.lit(False).alias("additionalProperties"),
            ).alias("schema"),
        ).alias("format")
    )


def _request(model: str, system: str, max_tokens: int, messages: Column, output: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"),
            messages.alias("messages"), output.alias("output_config"),
        )
    )


STRING = lambda: F.struct(F.lit("string").alias("type"))


def routing_requests(questions: DataFrame, cards: DataFrame, model: str, system: str) -> DataFrame:
    """(question_id, request) over one catalog; none when there is a single part to choose from."""
    asked = questions.withColumn("catalog", catalog(cards).scalar()).filter(F.col("catalog.n") > 1)
    content = T.fill_template("<partes>\n{c}\n</partes>\n\nPregunta: {q}", c=F.col("catalog.text"), q=F.col("question"))
    items = F.struct(F.lit("string").alias("type"), F.col("catalog.codes").alias("enum"))
    output = _schema([("partes", F.struct(F.lit("array").alias("type"), items.alias("items")))])
    return asked.select("question_id", _request(model, system, 512, F.array(_message(content)), output).alias("request"))


def single_routes(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """Routes that need no call: with one part loaded, every question goes there."""
    asked = questions.withColumn("catalog", catalog(cards).scalar()).filter(F.col("catalog.n") == 1)
    return asked.select("question_id", F.col("catalog.codes")[0].alias("part"), F.lit(0).alias("route_rank"))


def routed(responses: DataFrame, cards: DataFrame) -> DataFrame:
    """(question_id, part, route_rank): known codes of routing responses, once each, in the model's order."""
    text = F.try_element_at(F.filter("content", lambda b: b["type"] == "text"), F.lit(1))["text"]
    codes = F.from_json(text, "partes ARRAY<STRING>")["partes"]
    named = responses.select("question_id", F.posexplode(codes).alias("at", "part"))
    known = named.join(cards.select("part"), "part", "left_semi")
    return known.groupBy("question_id", "part").agg(F.min("at").alias("route_rank"))


def routing_errors(responses: DataFrame) -> DataFrame:
    text = F.try_element_at(F.filter("content", lambda b: b["type"] == "text"), F.lit(1))["text"]
    return responses.filter(text.isNull()).select("question_id", F.lit("routing response has no text block").alias("error"))


def judge_requests(judged: DataFrame, model: str, system: str) -> DataFrame:
    """(case_id, request) from case_id, question, reference_answer and the answer's text."""
    content = T.fill_template(
        "<pregunta>\n{q}\n</pregunta>\n\n<referencia>\n{r}\n</referencia>\n\n<respuesta>\n{a}\n</respuesta>",
        q=F.col("question"), r=F.col("reference_answer"), a=F.col("text"),
    )
    verdicts = F.struct(F.lit("string").alias("type"), F.array(*[F.lit(v) for v in fixed.VERDICTS]).alias("enum"))
    output = _schema([("fundamento", STRING()), ("veredicto", verdicts)])
    return judged.select("case_id", _request(model, system, 1024, F.array(_message(content)), output).alias("request"))


def _case_prompt() -> Column:
    return T.fill_template(
        '<seccion parte="{p}" id="{s}" titulo="{t}">\n{x}\n</seccion>',
        p=F.col("part"), s=F.col("section"), t=F.col("title"), x=F.left("text", F.lit(fixed.MAX_CASE_SECTION_CHARS)),
    )


def _case_request(messages: Column, model: str, system: str) -> Column:
    return _request(model, system, 2048, messages, _schema([("pregunta", STRING()), ("respuesta_referencia", STRING())]))


def case_requests(sections: DataFrame, model: str, system: str) -> DataFrame:
    """(part, section, request): ask for a question and reference answer about a section's opening."""
    return sections.select("part", "section", _case_request(F.array(_message(_case_prompt())), model, system).alias("request"))


def retry_requests(again: DataFrame, model: str, system: str) -> DataFrame:
    """The second request for sections whose first question copied; told why.

    An answer that could not be read is simply asked again.
    """
    feedback = T.fill_template(fixed.RETRY_FEEDBACK, why=F.col("why"))
    first = _message(_case_prompt())
    told = F.array(first, _message(F.col("answer_text"), "assistant"), _message(feedback))
    messages = F.when(F.col("error").isNull(), told).otherwise(F.array(first))
    return again.select("part", "section", _case_request(messages, model, system).alias("request"))
