"""Pairs of texts with words in common, against sets of n-grams compared pair by pair."""

import random

from pyspark.sql import functions as F

from fojas import fixed
from fojas.operators import casekit as K

COMMON = "esta página se imprimió en papel de la casa"


def grams(text):
    words = (text or "").split()
    return {tuple(words[i : i + fixed.COPY_NGRAM]) for i in range(len(words) - fixed.COPY_NGRAM + 1)}


def plain(text):
    return (text or "").lower().replace("á", "a").replace("ó", "o")


def test_as_by_hand_with_wording_that_half_the_sections_hold(spark):
    draw = random.Random(5)
    word = lambda: draw.choice("sol luna mar rio monte valle nube viento".split())
    line = lambda n: " ".join(word() for _ in range(n))
    sections = [(i, line(30) + (f" {COMMON} " if i % 2 else " ") + line(5)) for i in range(120)] + [(120, None), (121, ""), (122, "sol luna")]
    questions = [(i, sections[i * 7][1][: 60 + i]) for i in range(15)] + [(15, COMMON.upper()), (16, None), (17, "mar " * 40), (18, "sol luna")]
    want = {(q, s): len(grams(plain(a)) & grams(plain(b))) for q, a in questions for s, b in sections}
    got = K.shared_wording(spark.createDataFrame(questions, "question_id INT, text STRING"), spark.createDataFrame(sections, "section_id INT, text STRING"))
    assert {(r.question_id, r.section_id): r.shared for r in got.collect()} == {k: n for k, n in want.items() if n}
    assert sum(1 for q, _ in want if q == 15 and want[q, _]) == 60


def test_sections_with_one_gram_are_dealt(spark):
    from pyspark.sql import functions as F

    deals = spark.range(4000).select(F.pmod(F.xxhash64("id"), F.lit(K.GRAM_KEYS)).alias("deal")).groupBy("deal").count().collect()
    assert len(deals) == K.GRAM_KEYS and max(r["count"] for r in deals) < 2 * 4000 / K.GRAM_KEYS


def test_no_rows(spark):
    none = spark.createDataFrame([], "question_id INT, text STRING")
    assert K.shared_wording(none, none.withColumnRenamed("question_id", "section_id")).count() == 0


def test_a_section_is_not_read_for_a_short_question(spark):
    short = spark.createDataFrame([("¿Cómo es?",), (" ",), (None,), ("uno dos tres cuatro cinco seis siete",)], "q string")
    unread = F.raise_error(F.concat(F.lit("read for "), F.coalesce("q", F.lit("null")))).cast("string")
    assert short.select(K.copy_reason(F.col("q"), unread)).collect() == [(None,)] * 4
    long = spark.createDataFrame([("Uno dos tres cuatro cinco seis siete ocho", "no uno dos tres cuatro cinco seis siete ocho más")], "q string, t string")
    assert long.select(K.copy_reason(F.col("q"), F.col("t"))).first()[0] == fixed.COPIES_WORDS
