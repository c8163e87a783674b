"""Answers of a managed chat that carries inline citation tags, in the shape of our own answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?Us)\b{name}=([\"'])(.*?)\1", 2)


def _tag_key(tag: Column) -> Column:
    """struct<document, page, block> a tag names; page 0 where it names none."""
    short = F.startswith(tag, F.lit("<doc="))
    document = F.when(short, F.regexp_extract(tag, fixed.TAG, 1)).otherwise(_attribute(tag, "doc"))
    page = F.when(short, F.regexp_extract(tag, fixed.TAG, 2)).otherwise(F.split_part(_attribute(tag, "page"), F.lit("-"), F.lit(1)))
    block = F.when(short, F.regexp_extract(tag, fixed.TAG, 3)).otherwise(_attribute(tag, "block"))
    return F.struct(
        T.strip(document).alias("document"),
        F.coalesce(F.when(T.strip(page).rlike(r"^\d+\z"), T.strip(page)).try_cast("int"), F.lit(0)).alias("page"),
        F.nullif(T.strip(block), F.lit("")).alias("block"),
    )


def tagged(answers: DataFrame) -> DataFrame:
    """Prose without its tags, and every citation with the offset in the prose where it stands.

    A tag cites where it is; ``<cite ...>claim</cite>`` cites at its end; one never closed cites where
    the text ends.
    """
    a = answers.withColumn("found", F.regexp_extract_all("text", F.lit(fixed.TAG), F.lit(0)))
    a = a.withColumn("gaps", F.split("text", fixed.TAG)).withColumn("prose", F.array_join("gaps", ""))
    # Where the prose before each tag ends, not counting the spaces in front of the tag.
    walk = "struct<total: int, at: int, ends: array<int>>"

    def advance(acc: Column, gap: Column) -> Column:
        at = F.when(T.nonblank(gap), acc["total"] + F.length(T.rstrip(gap))).otherwise(acc["at"])
        return T.let(at, lambda x: F.struct(
            (acc["total"] + F.length(gap)).alias("total"), x.alias("at"), F.concat(acc["ends"], F.array(x)).alias("ends")
        ).cast(walk))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")).cast(walk)
    a = a.withColumn("offsets", F.aggregate("gaps", zero, advance, lambda acc: acc["ends"]))
    tags = F.zip_with("found", "offsets", lambda t, at: F.struct(t.alias("tag"), at.alias("at")))
    a = a.withColumn("tags", F.filter(F.transform(tags, lambda t, i: F.struct(t["tag"].alias("tag"), i.alias("i"), t["at"].alias("at"))), lambda t: t["tag"].isNotNull()))
    state = "struct<open: array<struct<tag: string, i: int, at: int>>, done: array<struct<at: int, tag: string>>>"

    def step(acc: Column, t: Column) -> Column:
        closing = t["tag"] == "</cite>"
        opening = F.startswith(t["tag"], F.lit("<cite")) & ~t["tag"].rlike(r"/>\z")
        held = F.size(acc["open"]) > 0
        # The position of the tag counts for order and place; the key is that of the tag it closes.
        done = lambda tag: F.concat(acc["done"], F.array(F.struct(t["at"].alias("at"), tag.alias("tag"))))
        popped = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        kept_open = F.when(closing, popped).when(opening, F.concat(acc["open"], F.array(t))).otherwise(acc["open"])
        kept_done = (
            F.when(closing & held, done(F.try_element_at(acc["open"], F.lit(-1))["tag"]))
            .when(closing | opening, acc["done"]).otherwise(done(t["tag"]))
        )
        return F.struct(kept_open.alias("open"), kept_done.alias("done")).cast(state)

    start = F.from_json(F.lit('{"open": [], "done": []}'), state.removeprefix("struct<").removesuffix(">").replace("open:", "open", 1).replace("done:", "done", 1))
    a = a.withColumn("walked", F.aggregate("tags", start.cast(state), step))
    end = F.length(T.rstrip(F.col("prose")))
    marks = F.concat(
        F.col("walked.done"), F.transform("walked.open", lambda t: F.struct(end.alias("at"), t["tag"].alias("tag"))),
    )
    keyed = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), _tag_key(m["tag"]).alias("key")))
    return a.select(*[c for c in answers.columns if c != "text"], "prose", keyed.alias("marks"))


def resolve(resolved: DataFrame, docs: DataFrame, section_pages: DataFrame) -> DataFrame:
    """Per answer its resolved tags: an array of key (document, page, block) and the citations it stands for.

    ``resolved``: answer_id, seq, document, page, block_id, doc_id, text; the last row of a key counts.
    ``docs``: doc_id, content_hash, part, source_url, page_count. A block cites the sections whose
    page text holds its first characters, or every section on the page when none does. Keys are
    resolved once per answer, however many tags name them.
    """
    block = F.when(F.coalesce("block_id", F.lit("")) != "", F.nullif(T.strip(F.col("block_id")), F.lit("")))
    keyed = resolved.select(
        "answer_id", "seq",
        F.struct(
            T.strip(F.coalesce("document", F.lit(""))).alias("document"), F.coalesce("page", F.lit(0)).alias("page"), block.alias("block")
        ).alias("key"),
        "doc_id", T.strip(F.coalesce("text", F.lit(""))).alias("block_text"),
    )
    last = keyed.groupBy("answer_id", "key").agg(F.max_by(F.struct("doc_id", "block_text"), "seq").alias("r"))
    hits = last.select("answer_id", "key", F.col("key.page").alias("pdf_page"), "r.doc_id", "r.block_text")
    placed = hits.join(docs, "doc_id").filter(F.col("pdf_page").between(F.lit(1), F.col("page_count")))
    pages = section_pages.select(
        "content_hash", "pdf_page", "section", "section_ord", "title", "text", "printed_page", "edition", "amendment", "date"
    )
    rows = placed.join(pages, ["content_hash", "pdf_page"])
    needle = F.left(F.lower(T.collapse(F.col("block_text"))), F.lit(fixed.BLOCK_PREFIX_CHARS))
    holds = (F.col("block_text") != "") & F.contains(F.lower(F.regexp_replace("text", r"(?U)\s+", " ")), needle)
    citation = F.struct(
        "part", "section", "title", F.col("pdf_page").alias("pdf_page_start"), F.col("pdf_page").alias("pdf_page_end"),
        F.col("printed_page").alias("printed_page_start"), F.col("printed_page").alias("printed_page_end"), "edition", "amendment",
        "date", "source_url", F.coalesce(F.nullif("block_text", F.lit("")), F.col("text")).alias("cited_text"),
        F.lit(None).cast("string").alias("term"),
    )
    per_key = rows.groupBy("answer_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("section_ord", holds.alias("holds"), citation.alias("c")))).alias("on_page")
    )
    pinned = F.filter("on_page", lambda x: x["holds"])
    chosen = F.when(F.size(pinned) > 0, pinned).otherwise(F.col("on_page"))
    cites = per_key.select("answer_id", F.struct("key", F.transform(chosen, lambda x: x["c"]).alias("cites")).alias("k"))
    return cites.groupBy("answer_id").agg(F.collect_list("k").alias("keyed"))


def map_answers(answers: DataFrame, resolved: DataFrame, docs: DataFrame, section_pages: DataFrame) -> DataFrame:
    """Tagged answers (answer_id, text, model) as answers with sentences and citations.

    A tag belongs to the sentence it ends. Sentences without a resolved citation are dropped; an
    answer without any other is a refusal.
    """
    a = tagged(answers).join(resolve(resolved, docs, section_pages), "answer_id", "left")
    cites_of = lambda m: F.try_element_at(F.filter("keyed", lambda k: k["key"].eqNullSafe(m["key"])), F.lit(1))["cites"]
    found = F.transform("marks", lambda m: F.struct(m["at"].alias("at"), cites_of(m).alias("cites")))
    a = a.withColumn("cited_marks", F.filter(found, lambda m: m["cites"].isNotNull()))
    a = a.withColumn("cut", T.sentence_pieces(F.col("prose"))).withColumn("stops", T.running_ends(F.col("cut")))
    ranges = F.zip_with(
        "cut", "stops", lambda p, e: F.struct(p.alias("raw"), (e - F.length(p)).alias("start"), e.alias("end"))
    )
    empty = F.array().cast(a.schema["cited_marks"].dataType)
    a = a.withColumn("cited_marks", F.coalesce("cited_marks", empty)).withColumn("ranges", ranges)

    def piece(r: Column) -> Column:
        inside = F.filter(
            "cited_marks",
            lambda m: ((r["start"] < m["at"]) & (m["at"] <= r["end"])) | ((r["start"] == 0) & (m["at"] == 0)),
        )
        text = T.strip(F.regexp_replace(r["raw"], fixed.SPACE_BEFORE_PUNCTUATION, "$1"))
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), text.alias("text"), F.lit(None).cast("string").alias("starts"),
            F.array_distinct(F.flatten(F.transform(inside, lambda m: m["cites"]))).alias("citations"),
        )

    pieces = F.filter(F.transform("ranges", piece), lambda p: p["text"].rlike(fixed.LETTER))
    a = a.withColumn("pieces", pieces)
    a = a.withColumn("sentences", F.filter("pieces", lambda p: F.size(p["citations"]) > 0))
    return a.select(
        "answer_id", "model", (F.size("sentences") == 0).alias("refused"), F.lit(False).alias("incomplete"), "sentences",
        F.transform(F.filter("pieces", lambda p: F.size(p["citations"]) == 0), lambda p: p["text"]).alias("dropped"),
    )
