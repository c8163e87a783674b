"""Editions of parts: validity intervals, as-of joins, and a corpus of several editions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fojas.operators import definitions as D
from fojas.operators import editions as E
from fojas.plans import jobs as J

HISTORY = "part STRING, sha256 STRING, fetched_at TIMESTAMP"


def day(n, hour=0):
    return dt.datetime(2030, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_intervals(spark):
    rows = [("5", "x", day(0)), ("5", "x", day(1)), ("5", "y", day(2)), ("5", "x", day(4)), ("6", "z", day(1)), ("6", None, day(3)), ("6", None, day(5)), ("6", "z", day(7)), ("7", None, day(0))]
    rows += [(None, "x", day(0)), ("8", "u", None), ("9", "a", day(1)), ("9", "b", day(1))]
    got = sorted((r.part, r.edition, r.content_hash, r.valid_from, r.valid_to) for r in E.intervals(spark.createDataFrame(rows, HISTORY)).collect())
    assert got == [
        ("5", 1, "x", day(0), day(2)), ("5", 2, "y", day(2), day(4)), ("5", 3, "x", day(4), None),
        ("6", 1, "z", day(1), day(3)), ("6", 2, "z", day(7), None), ("9", 1, "b", day(1), None),
    ]
    versions = E.intervals(spark.createDataFrame(rows, HISTORY))
    assert {r.part: r.content_hash for r in E.valid_at(versions).collect()} == {"5": "x", "6": "z", "9": "b"}
    assert {r.part: r.content_hash for r in E.valid_at(versions, day(3)).collect()} == {"5": "y", "9": "b"}


@pytest.mark.parametrize("unit", ["DAY", "HOUR"])
def test_as_of_equals_a_search_of_the_history(spark, unit):
    r = random.Random(7)
    history = [(f"p{r.randint(0, 3)}", r.choice(["a", "b", None]), day(r.randint(0, 9), r.randint(0, 30))) for _ in range(60)]
    asked = [(i, f"p{r.randint(0, 4)}", day(r.randint(-1, 14), r.randint(0, 30))) for i in range(200)] + [(900, None, day(1)), (901, "p1", None)]
    last = {}
    for p, h, t in history:
        last[p, t] = h if last.get((p, t)) is None else max(last[p, t], h or "")
    want = {i: (max(((u, h) for (q, u), h in last.items() if q == p and t and u <= t), default=(None, None), key=lambda x: x[0]))[1] for i, p, t in asked}
    df = spark.createDataFrame(asked, "i INT, part STRING, at TIMESTAMP")
    got = E.as_of(df, E.intervals(spark.createDataFrame(history, HISTORY)), "at", unit)
    assert {x.i: x.content_hash for x in got.collect()} == want and got.count() == len(asked)


def test_only_the_valid_edition_is_read_and_attached(spark):
    texts = [("s1", 1, "la torre y el muelle norte"), ("s2", 1, "la torre")]
    definitions = [
        ("d1", "1", "1.1", 0, "Torre", "Torre: la vieja", 3), ("d1", "1", "1.1", 1, "Muelle norte", "Muelle norte: (Ver torre).", 3), ("d1", "1", "1.1", 2, "Muelle", "Muelle: x", 3),
        ("d2", "1", "1.1", 0, "Muelle", "Muelle: (Ver torre).", 3), ("d2", "1", "1.1", 1, "Torre", "Torre: la nueva", 3),
    ]
    definitions = spark.createDataFrame(definitions, "content_hash STRING, part STRING, section STRING, def_ord INT, term STRING, text STRING, pdf_page INT")
    rows = spark.createDataFrame(texts, "content_hash STRING, section_ord INT, text STRING")
    terms = D.section_terms(rows, definitions, ("content_hash", "section_ord"))
    covered = {(r.content_hash, r.phrase, r.def_hash): r.covered for r in terms.collect()}
    # "muelle" is inside "muelle norte", which the second edition does not define
    assert covered["s1", "muelle", "d1"] and not covered["s1", "muelle", "d2"] and ("s2", "muelle", "d2") not in covered
    pages = spark.createDataFrame([(h, n, "61.1", p, "61") for h, n, p in (("s1", 1, 5), ("s2", 1, 6))], "content_hash STRING, section_ord INT, section STRING, pdf_page INT, part STRING")
    history = [("61", "s1", day(0)), ("61", "s2", day(9)), ("1", "d1", day(0)), ("1", "d2", day(5))]
    versions = E.intervals(spark.createDataFrame(history, HISTORY))
    corpus = {
        "parts": versions.select("part", "content_hash").withColumn("page_count", F.lit(9)), "section_pages": pages, "definition_pages": definitions.drop("text"),
        "definitions": definitions, "section_terms": terms,
    }
    events = spark.createDataFrame([("q", "61", 1, "tool_call", "get_page_content", '{"pages": "5-6"}')], "question_id STRING, part STRING, seq INT, type STRING, name STRING, arguments STRING")
    routes = spark.createDataFrame([("q", "61", 0)], "question_id STRING, part STRING, route_rank INT")
    for at, section, wanted in (
        (day(1), "s1", [("d1", "Muelle norte"), ("d1", "Torre")]), (day(6), "s1", [("d2", "Muelle"), ("d2", "Torre")]), (None, "s2", [("d2", "Torre")]),
    ):
        sections, attached = J.retrieve(corpus, routes, events, E.valid_at(versions, at))
        assert [r.content_hash for r in sections.collect()] == [section]
        assert [(r.content_hash, r.term) for r in attached.orderBy("rank").collect()] == wanted


def test_totals_are_those_of_all_sections_without_a_row_for_each(spark, tmp_path):
    words = ("torre", "muelle", "muelle norte", "faro", "boya", "dique", "grua", "noray", "ancla", "cabo", "vela")
    defined = [("d1", "1", "1.1", n, w, f"{w}: (Ver faro)." if n % 4 == 2 else f"{w}: x", 3) for n, w in enumerate(words)]
    definitions = spark.createDataFrame(defined, "content_hash STRING, part STRING, section STRING, def_ord INT, term STRING, text STRING, pdf_page INT")
    texts = [(h, n, " y ".join(words) if n % 60 == 1 else f"{words[n % 4]} y {words[n % 6]}" if n % 5 else "nada") for h in ("s1", "s2") for n in range(120)]
    rows = spark.createDataFrame(texts, "content_hash STRING, section_ord INT, text STRING")
    held = [(h, n, f"{h}.{n}", p, h) for h, n, _ in texts for p in {n % 4 + 1, (n * n) % 3 + 2}]
    pages = spark.createDataFrame(held, "content_hash STRING, section_ord INT, section STRING, pdf_page INT, part STRING")
    corpus = {
        "parts": spark.createDataFrame([("s1", "s1", 9), ("s2", "s2", 9)], "part STRING, content_hash STRING, page_count INT"), "section_pages": pages,
        "definition_pages": definitions.drop("text"), "definitions": definitions, "section_terms": D.section_terms(rows, definitions, ("content_hash", "section_ord")),
    }
    read = [("q", "s1", "1, 3-4"), ("q", "s2", "2"), ("r", "s2", "1-9, 2"), ("t", "s1", "5")]
    events = spark.createDataFrame([(q, p, 1, "tool_call", "get_page_content", f'{{"pages": "{x}"}}') for q, p, x in read], "question_id STRING, part STRING, seq INT, type STRING, name STRING, arguments STRING")
    routes = spark.createDataFrame([("q", "s2", 0), ("q", "s1", 1), ("r", "s2", 0), ("t", "s1", 0)], "question_id STRING, part STRING, route_rank INT")
    sections, attached = J.retrieve(corpus, routes, events)
    totals, short = J.retrieve_totals(corpus, routes, events, str(tmp_path))
    want = sections.groupBy("question_id").agg(F.count("*"), F.sum("section_ord"))
    assert sorted(totals.collect()) == sorted(want.collect()) and want.count() == 2
    listed = lambda df: sorted(tuple(r) for r in df.select("question_id", "rank", "content_hash", "def_ord", "term").collect())
    assert listed(short) == listed(attached) and len(listed(short)) > 15
    assert spark.read.parquet(f"{tmp_path}/alike").count() < sections.count() / 3
