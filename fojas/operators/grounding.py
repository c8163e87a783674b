"""Grounding: model responses become answers whose claims are backed by what they cite.

One response is one row, so blocks, spans and token sets are row-local expressions; its pieces are rows
that meet spans and cited tokens in sweeps, in time that grows with the answer's length. The only
exchange is the join of responses with the documents they were written from; the sweeps, the layout
windows and the final aggregation run on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed, schemas
from fojas.functions import text as T

CITATION_FIELDS = (
    "part", "section", "title", "pdf_page_start", "pdf_page_end", "printed_page_start",
    "printed_page_end", "edition", "amendment", "date", "source_url", "cited_text", "term",
)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Raw JSON responses with their fields as columns."""
    body = F.from_json("raw", schemas.RESPONSE).alias("r")
    return responses.select("*", body).select(*responses.columns, "r.*")


def documents_by_answer(documents: DataFrame) -> DataFrame:
    """Each answer's documents as one array in prompt order (bounded by one prompt)."""
    fields = [c for c in documents.columns if c not in ("answer_id", "document_index")]
    packed = F.array_sort(F.collect_list(F.struct("document_index", *fields)))
    return documents.groupBy("answer_id").agg(packed.alias("docs"))


def _nth(items: Column, index: Column) -> Column:
    """The item at an index from 0; null for a negative index and beyond the end."""
    return F.try_element_at(items, F.when(index >= 0, index + 1))


def _citation(raw: Column, docs: Column) -> Column:
    """A raw citation resolved to its document and the pages its block range covers."""
    d = _nth(docs, raw["document_index"])
    first = _nth(d["pages"], raw["start_block_index"])
    last = _nth(d["pages"], F.least(raw["end_block_index"], F.size(d["pages"])) - 1)
    title = F.when(d["term"].isNull(), d["title"]).otherwise(
        T.fill_template(fixed.DEFINITION_TITLE, term=d["term"])
    )
    return F.struct(
        d["part"].alias("part"), d["section"].alias("section"), title.alias("title"),
        first["pdf_page"].alias("pdf_page_start"), last["pdf_page"].alias("pdf_page_end"),
        first["printed_page"].alias("printed_page_start"), last["printed_page"].alias("printed_page_end"),
        first["edition"].alias("edition"), first["amendment"].alias("amendment"), first["date"].alias("date"),
        d["source_url"].alias("source_url"), raw["cited_text"].alias("cited_text"), d["term"].alias("term"),
    )


def _citation_error(raw: Column, docs: Column) -> Column:
    d = _nth(docs, raw["document_index"])
    empty = (
        (raw["start_block_index"] < 0) | (raw["start_block_index"] >= F.size(d["pages"]))
        | (raw["end_block_index"] <= raw["start_block_index"])
    )
    return (
        F.when(
            ~raw["type"].eqNullSafe(fixed.CITATION_TYPE),
            F.concat(F.lit("unexpected citation type "), F.coalesce(raw["type"], F.lit("none"))),
        )
        .when(d.isNull(), F.lit("citation of an unknown document"))
        .when(empty, F.concat(F.lit("citation block range out of bounds for section "), d["section"]))
    )


def _spans(df: DataFrame) -> DataFrame:
    """Text, cited spans and coverage verdict of every response."""
    content_type = df.schema["content"].dataType
    content = F.coalesce("content", F.array().cast(content_type))
    df = df.withColumn("blocks", F.filter(content, lambda b: b["type"] == "text"))
    df = df.withColumn("full", F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), ""))
    df = df.withColumn("ends", T.running_ends(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit("")))))
    located = F.zip_with(
        "blocks", "ends",
        lambda b, e: F.struct(
            (e - F.length(F.coalesce(b["text"], F.lit("")))).alias("start"), e.alias("end"), b["citations"].alias("raw")
        ),
    )
    df = df.withColumn("located", F.filter(located, lambda s: F.size(F.coalesce(s["raw"], F.array())) > 0))
    df = df.withColumn(
        "spans",
        F.transform(
            "located",
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.transform(s["raw"], lambda c: _citation(c, F.col("docs"))).alias("cites"),
            ),
        ),
    )
    errors = F.flatten(F.transform("located", lambda s: F.transform(s["raw"], lambda c: _citation_error(c, F.col("docs")))))
    unreadable = F.when(F.col("content").isNull(), "response without content")
    df = df.withColumn("error", F.coalesce(unreadable, F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))))
    df = df.withColumn("opening", F.regexp_extract("full", fixed.COVERAGE_LINE, 0))
    verdict = F.lower(F.regexp_extract("full", fixed.COVERAGE_LINE, 1))
    readable = (
        (F.length("opening") > 0)
        & ~F.exists("spans", lambda s: s["start"] < F.length("opening"))
        & verdict.isin(*fixed.COVERAGES)
        & ~F.coalesce(F.col("stop_reason") == "refusal", F.lit(False))
        & F.col("has_sections")
        & F.col("error").isNull()
    )
    df = df.withColumn("coverage", F.when(readable, verdict))
    gap = F.nullif(T.strip(F.regexp_extract("full", fixed.COVERAGE_LINE, 2)), F.lit(""))
    df = df.withColumn("gap", F.when(F.col("coverage").isNotNull(), gap))
    backed = F.flatten(
        F.transform(
            "spans",
            lambda s: F.flatten(
                F.transform(s["cites"], lambda c: T.claim_tokens(F.concat_ws(" ", c["cited_text"], c["section"], c["part"])))
            ),
        )
    )
    return df.withColumn("support", F.array_distinct(backed))


def _pieces(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per piece of an answer between cuts that split no cited span, with the spans inside it.

    One sweep over the cuts and the starts of spans in order of place, so nothing is compared with
    everything: spans follow one another, so a cut splits one just when a span that began before it ends
    after it, and what begins after as many cuts lies in the same piece. An empty span between two pieces
    belongs to both. Answer-level columns ride on one row only.
    """
    body = F.length("opening")
    raws = F.when(F.col("coverage").isNotNull(), T.sentence_pieces(F.expr("substring(full, length(opening) + 1)")))
    df = df.withColumn("raws", raws).withColumn("cuts", T.running_ends(F.col("raws")))
    edge = lambda place, kind, n, raw, stop: F.struct(place.alias("place"), F.lit(kind).alias("kind"), n.alias("n"), raw.alias("raw"), stop.alias("stop"))
    cuts = F.transform(F.arrays_zip("raws", "cuts"), lambda x, n: edge(x["cuts"] + body, 0, n, x["raws"], F.lit(None).cast("int")))
    spans = F.transform("spans", lambda x, n: edge(x["start"], 1, n, F.lit(None).cast("string"), x["end"]))
    header = F.struct("model", "has_sections", "coverage", "gap", "error", "spans", "docs")
    edges = F.coalesce(F.concat(cuts, spans), F.slice(spans, 1, 0))
    rows = df.select(*keys, header.alias("header"), "support", F.posexplode_outer(edges).alias("row", "e"))
    rows = rows.select(*keys, *[F.when(F.coalesce("row", F.lit(0)) == 0, F.col(c)).alias(c) for c in ("header", "support")], "e.*")
    sweep = Window.partitionBy(*keys).orderBy("place", "kind", "n").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(sweep), F.lit(0))
    rows = rows.withColumn("cut", F.when((F.length("raw") > 0) & (reached <= F.col("place")), F.col("place")))
    rows = rows.withColumn("pos", F.count("cut").over(sweep)).withColumn("last_cut", F.max("cut").over(sweep))
    between = (F.col("kind") == 1) & (F.col("stop") == F.col("place")) & (F.col("last_cut") == F.col("place"))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("n", "raw"))))
    pieces = rows.groupBy(*keys, "pos").agg(
        F.first("header", ignorenulls=True).alias("header"), F.first("support", ignorenulls=True).alias("support"),
        F.nullif(F.array_join(F.transform(parts, lambda x: x["raw"]), ""), F.lit("")).alias("raw"),
        F.min(F.when(F.col("kind") == 0, F.col("place") - F.length("raw"))).alias("start"), F.max(F.when(F.col("kind") == 0, F.col("place"))).alias("end"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.col("n")))).alias("own"), F.array_sort(F.collect_list(F.when(between, F.col("n")))).alias("shared"),
    )
    following = F.lead("shared").over(Window.partitionBy(*keys).orderBy("pos"))
    return pieces.withColumn("span_ids", F.concat("own", F.coalesce(following, F.array().cast("array<int>")))).drop("own", "shared")


def _backed(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces with their ``text``, whether it has ``letters`` and whether it is ``kept``: all its claims backed.

    The tokens of the pieces and of the answer's cited texts meet by token within the answer, so each is
    looked at once.
    """
    raw = F.col("raw")
    marks = F.struct(
        T.nonblank(raw).alias("has_text"), raw.rlike(r"(?U)^\s*\n").alias("lead_break"), raw.rlike(r"(?U)\n\s*\z").alias("trail_break"), raw.rlike(fixed.BULLET).alias("bullet")
    )
    p = pieces.withColumns({"text": T.without_markup(raw), "marks": marks}).drop("raw")  # one text rides through the sorts
    claims = F.transform(F.coalesce(T.claim_tokens(F.col("text")), F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(False).alias("cited")))
    cited = F.transform(F.coalesce("support", F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(True).alias("cited")))
    rows = p.select(*keys, "pos", *[c for c in p.columns if c not in (*keys, "pos", "support")], F.posexplode_outer(F.concat(claims, cited)).alias("place", "t"))
    first = F.coalesce("place", F.lit(0)) == 0
    rows = rows.select(*keys, "pos", first.alias("first"), *[F.when(first, F.col(c)).alias(c) for c in ("header", "marks", "start", "end", "span_ids", "text")], "t.*")
    rows = rows.withColumn("missing", F.col("token").isNotNull() & ~F.max("cited").over(Window.partitionBy(*keys, "token")))
    own = Window.partitionBy(*keys, "pos").orderBy(F.col("first").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("missing", F.max("missing").over(own)).filter("first")
    letters = F.coalesce(F.col("text").rlike(fixed.LETTER), F.lit(False))
    return rows.withColumn("letters", letters).withColumn("kept", F.col("letters") & ~F.col("missing"))


def _laid_out(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Kept and dropped pieces with where each kept one starts (paragraph, item or running on)."""
    p = pieces.select(
        *keys, "pos", "start", "end", "text", "letters", "kept", "header", "span_ids", "marks.*",
    )
    order = Window.partitionBy(*keys).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_text = F.coalesce(F.max(F.when(F.col("has_text"), F.col("pos"))).over(before), F.lit(-1))
    last_break = F.coalesce(F.max(F.when(F.col("lead_break"), F.col("pos"))).over(upto), F.lit(-1))
    trailing = F.coalesce(F.last(F.when(F.col("has_text"), F.col("trail_break")), ignorenulls=True).over(before), F.lit(False))
    p = p.withColumn("breaks", (last_break > last_text) | trailing)
    p = p.withColumn("kept_before", F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0)))
    p = p.withColumn("item_mark", F.col("bullet") & (F.col("breaks") | (F.col("kept_before") == 0)))
    last_kept = F.coalesce(F.max(F.when(F.col("kept"), F.col("pos"))).over(before), F.lit(-1))
    item = F.coalesce(F.max(F.when(F.col("item_mark"), F.col("pos"))).over(upto), F.lit(-1)) > last_kept
    paragraph = F.coalesce(F.max(F.when(F.col("breaks"), F.col("pos"))).over(upto), F.lit(-1)) > last_kept
    p = p.withColumn(
        "starts",
        F.when(item, F.lit("item")).when(paragraph & (F.col("kept_before") > 0), F.lit("paragraph")),
    )
    p = p.withColumn(
        "previous", F.last(F.when(F.col("kept"), F.struct("end", "text")), ignorenulls=True).over(before)
    )
    runs_on = (
        F.col("starts").isNull() & (F.col("previous.end") == F.col("start")) & F.col("previous.text").rlike("[:;]\\z")
    )
    return p.withColumn(
        "text", F.when(F.col("letters") & F.coalesce(runs_on, F.lit(False)), F.col("text"))
        .when(F.col("kept"), T.capitalize(F.col("text"))).otherwise(F.col("text"))
    )


def _likely_parts(docs: Column, gap: Column, cited: Column) -> Column:
    """Parts the gap names that a retrieved section refers to, each from its best section."""
    named = T.part_codes(gap)

    def candidates(d: Column) -> Column:
        return F.transform(
            F.filter(F.coalesce(d["refs"], F.array()), lambda r: F.array_contains(named, r["to_part"])),
            lambda r: F.struct(
                F.when(F.array_contains(cited, F.struct(d["part"].alias("part"), d["section"].alias("section"))), 0)
                .otherwise(1).alias("uncited"),
                F.when(F.contains(gap, d["section"]), 0).otherwise(1).alias("unnamed"),
                d["document_index"].alias("rank"),
                r["to_part"].alias("part"),
                F.struct(
                    d["part"].alias("part"), d["section"].alias("section"), d["title"].alias("title"),
                    r["pdf_page"].alias("pdf_page_start"), r["pdf_page"].alias("pdf_page_end"),
                    r["printed_page"].alias("printed_page_start"), r["printed_page"].alias("printed_page_end"),
                    r["edition"].alias("edition"), r["amendment"].alias("amendment"), r["date"].alias("date"),
                    d["source_url"].alias("source_url"), r["text"].alias("cited_text"),
                    F.lit(None).cast("string").alias("term"),
                ).alias("citation"),
            ),
        )

    every = F.flatten(F.transform(F.filter(docs, lambda d: d["term"].isNull()), candidates))
    best = F.transform(named, lambda code: F.array_min(F.filter(every, lambda c: c["part"] == code)))
    return F.transform(
        F.filter(best, lambda b: b.isNotNull()),
        lambda b: F.struct(b["part"].alias("part"), b["citation"].alias("citation")),
    )


def ground(responses: DataFrame, documents: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Answers from parsed responses (see ``parse_responses``) and the documents they cite.

    Returns one row per response: model, refused, incomplete, coverage, gap, sentences, dropped,
    likely_parts, error. ``extra_keys`` tell apart several responses of one answer, such as the
    states of a response that is still arriving.
    """
    keys = ["answer_id", *extra_keys]
    # One exchange of the compact raw rows; join, windows and aggregation below all reuse it.
    responses = responses.repartition("answer_id")
    joined = responses.join(documents_by_answer(documents), "answer_id", "left")
    joined = joined.withColumn(
        "has_sections", F.coalesce(F.exists("docs", lambda d: d["term"].isNull()), F.lit(False))
    )
    laid = _laid_out(_backed(_pieces(_spans(joined), keys), keys), keys)
    grouped = laid.groupBy(*keys).agg(
        F.first("header", ignorenulls=True).alias("header"),
        F.array_sort(
            F.collect_list(F.when(F.col("kept"), F.struct("pos", "start", "end", "text", "starts", "span_ids")))
        ).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("letters") & ~F.col("kept"), F.struct("pos", "text")))).alias("unbacked"),
    )
    sentences = F.transform(
        "kept",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["starts"].alias("starts"),
            F.flatten(F.transform(s["span_ids"], lambda i: F.col("header.spans")[i]["cites"])).alias("citations"),
        ),
    )
    done = grouped.select(*keys, "header.*", sentences.alias("sentences"), F.col("unbacked.text").alias("dropped"))
    cited = F.array_distinct(
        F.flatten(
            F.transform(
                "sentences",
                lambda s: F.transform(
                    s["citations"], lambda c: F.struct(c["part"].alias("part"), c["section"].alias("section"))
                ),
            )
        )
    )
    done = done.withColumn("cited", cited)
    refused = F.col("coverage").isNull() | (F.col("coverage") == "ninguna") | (F.size("cited") == 0)
    done = done.withColumn("refused", F.when(F.col("error").isNull(), refused))
    likely = F.when(
        F.col("gap").isNotNull() & (F.col("coverage") != "total"),
        _likely_parts(F.col("docs"), F.col("gap"), F.col("cited")),
    )
    none = F.slice("sentences", 1, 0)
    return done.select(
        *keys,
        F.when(F.col("has_sections"), F.col("model")).alias("model"),
        "refused",
        (~F.col("refused") & (F.col("coverage") == "parcial")).alias("incomplete"),
        "coverage", "gap",
        F.when(F.col("refused"), none).otherwise(F.col("sentences")).alias("sentences"),
        "dropped",
        F.coalesce(likely, F.slice(_likely_parts(F.col("docs"), F.lit(""), F.col("cited")), 1, 0)).alias("likely_parts"),
        "error",
    )


def unanswerable(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions for which no section was retrieved: refused without asking a model."""
    sections = documents.filter(F.col("term").isNull()).select("answer_id")
    return questions.join(sections, "answer_id", "left_anti").select("answer_id", F.lit(True).alias("refused"))


def sentence_rows(answers: DataFrame, keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    return answers.select(*keys, F.posexplode("sentences").alias("ord", "s")).select(*keys, "ord", "s.*")


def citation_rows(answers: DataFrame, keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    rows = sentence_rows(answers, keys)
    return rows.select(*keys, "ord", F.posexplode("citations").alias("citation_ord", "c")).select(
        *keys, "ord", "citation_ord", "c.*"
    )


def cited_sections(answers: DataFrame, keys: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    """Sections each answer cites with the place of their first citation."""
    return (
        citation_rows(answers, keys)
        .groupBy(*keys, "part", "section")
        .agg(F.min(F.struct("ord", "citation_ord")).alias("first_cited"))
    )


def public_answers(answers: DataFrame) -> DataFrame:
    """What a reader is shown; coverage, gap and dropped claims stay in the logs."""
    return answers.select("answer_id", "sentences", "refused", "incomplete", "likely_parts")
