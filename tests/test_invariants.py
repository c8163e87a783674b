"""Properties that hold for every text and every partitioning."""

import pytest
from pyspark.sql import functions as F

from fojas.functions import text as T
from fojas.operators import grounding as G
from fojas.queries import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return feeds.texts(spark.read.parquet(f"{SF}/documents.parquet"))


def test_pieces_make_up_the_text(documents):
    pieces = T.sentence_pieces(F.col("text"))
    ends = T.running_ends(pieces)
    bad = documents.filter((F.array_join(pieces, "") != F.col("text")) | (F.element_at(ends, -1) != F.length("text")))
    assert bad.count() == 0


def test_match_offsets_point_at_the_match(documents):
    found = documents.select("text", F.explode(T.matches_at(F.col("text"), r"\s([^\s]{3})\s")).alias("m"))
    here = F.expr("substring(text, m.at + 1, length(m.text))")
    assert found.count() > 0 and found.filter((here != F.col("m.text")) | (T.strip(F.col("m.text")) != F.col("m.group"))).count() == 0


@pytest.fixture(scope="module")
def answers(documents):
    return G.ground(G.parse_responses(feeds.answer_responses(documents)), feeds.answer_documents(documents))


def test_every_span_is_in_one_sentence_and_kept_claims_are_backed(answers):
    s = G.sentence_rows(answers).select("answer_id", "text", "citations")
    backed = s.groupBy("answer_id").agg(F.flatten(F.collect_list(F.transform("citations", lambda c: T.claim_tokens(
        F.concat_ws(" ", c["cited_text"], c["section"], c["part"]))))).alias("own"))
    assert answers.filter(F.size("dropped") > 0).count() > 0
    # A kept sentence's tokens come from citations of its answer, those of dropped sentences included.
    clean = answers.filter(F.size("dropped") == 0).select("answer_id")
    rows = s.join(backed, "answer_id").join(clean, "answer_id")
    assert rows.filter(F.size(F.array_except(T.claim_tokens(F.col("text")), F.flatten("own"))) > 0).count() == 0
    assert G.citation_rows(answers).groupBy("answer_id", "cited_text", "pdf_page_start").count().count() > 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitioning_does_not_matter(spark, documents, answers, partitions):
    digest = lambda df: df.select(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()[0]
    want = digest(answers)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        d = documents.repartition(int(partitions))
        assert digest(G.ground(G.parse_responses(feeds.answer_responses(d)), feeds.answer_documents(d))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_claim_words_are_tried_by_their_first_letter(spark):
    from itertools import pairwise

    from fojas import fixed

    depth, firsts = 0, []  # of the ways a scan tries at every place of a text, no two begin alike
    for before, c in pairwise(T._CLAIM_WORD[len("(?<![a-z])(?:") - 1 : -len("(?![a-z])")]):
        firsts += [c] if depth == 0 and before in ":|" else []
        depth += (c == "(") - (c == ")")
    assert sorted(set(firsts)) == sorted(firsts) and set(firsts) == {w[0] for w in (*fixed.NUMBER_WORDS, *fixed.MONTHS)}
    words = [*fixed.NUMBER_WORDS, *fixed.MONTHS]
    rows = [(f"El {w.upper()}, ({w}) x{w} {w}x {w}\u0301.", str(fixed.NUMBER_WORDS.get(w, w))) for w in words]
    rows += [(f"{w[:1]}\ufb01 {w}", str(fixed.NUMBER_WORDS.get(w, w))) for w in words]
    got = spark.createDataFrame(rows, "text string, want string").filter(~T.claim_tokens(F.col("text")).eqNullSafe(F.array("want")))
    assert got.collect() == []
