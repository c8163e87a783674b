"""Building evaluation cases: which sections to ask about, which questions copy, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fojas import fixed
from fojas.functions import text as T

GRAM_KEYS = 16  # keys of the join over which the sections that hold one n-gram are dealt


def eligible(title: Column, text: Column) -> Column:
    """A section that states a rule: not reserved or repealed, and long enough."""
    return ~title.rlike(fixed.SKIP_TITLE) & (F.length(text) >= fixed.MIN_CASE_SECTION_CHARS)


def covered_sections(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(part, section) that already have a case or a candidate of any status."""
    from_cases = cases.select(F.inline("expected"))
    from_candidates = candidates.select(F.col("parte").alias("part"), F.col("seccion").alias("section"))
    return from_cases.unionByName(from_candidates).distinct()


def sample_sections(sections: DataFrame, covered: DataFrame, n: int, seed: str, group: str = "part") -> DataFrame:
    """Up to n eligible uncovered sections per part; the same seed gives the same sample.

    Sections are drawn by the smallest hash of seed and id, so the window keeps n rows per task
    before the shuffle.
    """
    pool = sections.filter(eligible(F.col("title"), F.col("text"))).join(covered, [group, "section"], "left_anti")
    draw = F.sha2(F.concat(F.lit(seed), F.col("section")), 256)
    order = Window.partitionBy(group).orderBy(draw, "section")
    return pool.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= n).drop("draw")


def copy_reason(question: Column, text: Column) -> Column:
    """Why a question reads like the section it was written from, NULL when it does not.

    The section is not looked at for a question too short to hold an n-gram.
    """
    asked = T.words(question)
    overlap = F.arrays_overlap(T.ngrams(asked, fixed.COPY_NGRAM), T.ngrams(T.words(text), fixed.COPY_NGRAM))
    shared = F.when(F.size(asked) >= fixed.COPY_NGRAM, overlap)
    return F.when(question.rlike(fixed.QUESTION_SECTION_ID), fixed.NAMES_SECTION).when(shared, fixed.COPIES_WORDS)


def shared_wording(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, section_id, shared): pairs with a common n-gram, when questions come unpaired.

    Rows meet by the hash of an n-gram and are compared by its text, which they carry, so no text is fetched again
    and a collision never makes a match. A section deals all its n-grams to one of ``GRAM_KEYS`` keys of each hash,
    questions go to all of them, so wording that half the sections hold is no hot key. Texts that are null or shorter
    than an n-gram share nothing; ids are unique.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, F.explode(F.array_distinct(T.ngrams(T.words(F.col("text")), fixed.COPY_NGRAM))).alias("gram"))
        return rows.withColumn("h", F.xxhash64("gram"))

    dealt = grams(sections, "section_id").withColumn("deal", F.pmod(F.xxhash64("section_id"), F.lit(GRAM_KEYS)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(GRAM_KEYS - 1).cast("bigint"))
    asked = grams(questions, "question_id").withColumnRenamed("gram", "asked").withColumn("deal", F.explode(every))
    hits = dealt.join(asked, ["h", "deal"]).filter(F.col("gram") == F.col("asked"))
    return hits.groupBy("question_id", "section_id").agg(F.count(F.lit(1)).cast("int").alias("shared"))


def parsed_candidates(responses: DataFrame) -> DataFrame:
    """Case-writing responses (with a ``content`` array) as question and reference answer, or an error."""
    text = F.try_element_at(F.filter("content", lambda b: b["type"] == "text"), F.lit(1))["text"]
    data = F.from_json(text, "pregunta STRING, respuesta_referencia STRING")
    df = responses.withColumn("answer_text", text).withColumn("data", data)
    question, reference = T.strip(F.col("data.pregunta")), T.strip(F.col("data.respuesta_referencia"))
    error = (
        F.when(F.col("answer_text").isNull(), "no text block")
        .when(question.isNull() | reference.isNull(), "missing fields")
        .when((question == "") | (reference == ""), "empty question or reference answer")
    )
    return df.select(
        *responses.columns, "answer_text", question.alias("question"), reference.alias("reference_answer"), error.alias("error")
    )


def judge_attempts(sections: DataFrame, responses: DataFrame) -> DataFrame:
    """Attempts joined to their sections with the reason each one fails, NULL when it can be kept."""
    parsed = parsed_candidates(responses)
    joined = parsed.join(sections.select("part", "section", "title", "text"), ["part", "section"])
    invalid = F.when(F.col("error").isNotNull(), F.concat(F.lit("respuesta inválida ("), "error", F.lit(")")))
    return joined.withColumn("why", F.coalesce(invalid, copy_reason(F.col("question"), F.col("text"))))


def candidates_from(attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged attempts as candidates, sections to ask again, and notes on those given up.

    Each section gets two attempts. The first good one is the candidate.
    """
    best = attempts.groupBy("part", "section").agg(
        F.min_by(F.struct(*attempts.columns), F.struct(F.col("why").isNotNull(), F.when(F.col("why").isNull(), F.col("attempt")).otherwise(-F.col("attempt")))).alias("a"),
        F.max("attempt").alias("tried"),
    )
    flat = best.select("a.*", "tried")
    good = flat.filter(F.col("why").isNull()).select(
        F.concat_ws("-", F.lit("gen"), "part", "section").alias("id"), F.col("part").alias("parte"),
        F.col("section").alias("seccion"), F.col("title").alias("seccion_title"), F.col("text").alias("seccion_text"),
        "question", "reference_answer", "model", F.lit(fixed.PENDING).alias("status"),
    )
    bad = flat.filter(F.col("why").isNotNull())
    again = bad.filter(F.col("tried") < 2)
    note = F.concat("part", F.lit(":"), "section", F.lit(": "), "why")
    return good, again, bad.filter(F.col("tried") >= 2).select("part", "section", note.alias("note"))


def to_cases(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "id", "question",
        F.array(F.struct(F.col("parte").alias("part"), F.col("seccion").alias("section"))).alias("expected"),
        "reference_answer", F.lit(False).alias("out_of_scope"), F.lit("generated").alias("source"),
    )


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending candidates with their decision applied: a accept, e edit and accept, r reject, s skip.

    ``decisions``: id, choice, question, reference_answer (NULL or blank keeps the text).
    """
    renamed = decisions.select(
        "id", F.lower(F.trim("choice")).alias("choice"), F.col("question").alias("new_question"),
        F.col("reference_answer").alias("new_reference"),
    )
    joined = candidates.join(renamed, "id", "left")
    open_ = F.col("status") == fixed.PENDING
    edited = open_ & (F.col("choice") == "e")

    def text(new: str, old: str) -> Column:
        return F.when(edited, F.coalesce(F.nullif(T.strip(F.col(new)), F.lit("")), F.col(old))).otherwise(F.col(old))

    status = (
        F.when(open_ & F.col("choice").isin("a", "e"), fixed.ACCEPTED)
        .when(open_ & (F.col("choice") == "r"), fixed.REJECTED)
        .otherwise(F.col("status"))
    )
    outcome = F.when(open_ & (F.col("choice") == "s"), "saltado").when(open_ & (status != fixed.PENDING), status)
    kept = [c for c in candidates.columns if c not in ("question", "reference_answer", "status")]
    return joined.select(
        *kept, text("new_question", "question").alias("question"), text("new_reference", "reference_answer").alias("reference_answer"),
        status.alias("status"), outcome.alias("outcome"),
    )


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(
        F.count_if(F.col("outcome") == fixed.ACCEPTED).alias("accepted"),
        F.count_if(F.col("outcome") == fixed.REJECTED).alias("rejected"),
        F.count_if(F.col("outcome") == "saltado").alias("skipped"),
        F.count_if(F.col("status") == fixed.PENDING).alias("pending"),
    )
