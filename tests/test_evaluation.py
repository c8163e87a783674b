import json

import pytest
from pyspark.sql import functions as F

from fojas import fixed, schemas
from fojas.functions import text as T
from fojas.operators import casekit as K
from fojas.operators import grounding as G
from fojas.operators import render as RN
from fojas.operators import requests as Q
from fojas.operators import scoring as SC
from test_grounding import LINK, SHELF, said, source

CASE = "id STRING, out_of_scope BOOLEAN, expected ARRAY<STRUCT<part: STRING, section: STRING>>"
REF = "case_id STRING, part STRING, section STRING"


#: name: (out of scope, expected sections, read sections, sections of attached definitions, answer)
#: where an answer is (refused, citations of each sentence shown, sentences dropped), or a failure's text.
RUN = {
    "whole": (False, ["3", "8"], ["8", "9"], ["3"], (False, [1, 0, 2], 0)), "third": (False, ["3", "4", "5"], ["4"], [], (False, [1], 2)),
    "elsewhere": (False, ["8"], ["9"], ["1"], (False, [0, 0], 1)), "shy": (False, ["8"], ["8"], [], (True, [], 1)), "unread": (False, ["2"], [], [], (False, [1], 0)),
    "foreign": (True, [], ["1"], [], (True, [], 0)), "foreign, answered": (True, [], [], [], (False, [3], 0)), "foreign, failed": (True, [], ["2"], [], "no reply"),
}


@pytest.fixture(scope="module")
def scored(spark):
    cases = spark.createDataFrame([(k, out, [("12", s) for s in want]) for k, (out, want, *_) in RUN.items()], CASE)
    read = spark.createDataFrame([(k, "12", s) for k, r in RUN.items() for s in r[2]], REF)
    defs = spark.createDataFrame([(k, "12", s) for k, r in RUN.items() for s in r[3]], REF)
    errors = spark.createDataFrame([(k, r[4]) for k, r in RUN.items() if isinstance(r[4], str)], "case_id STRING, error STRING")
    rows = [(k, r[4][0], [(["c"] * n,) for n in r[4][1]], ["d"] * r[4][2]) for k, r in RUN.items() if not isinstance(r[4], str)]
    answers = spark.createDataFrame(rows, "answer_id STRING, refused BOOLEAN, sentences ARRAY<STRUCT<citations: ARRAY<STRING>>>, dropped ARRAY<STRING>")
    return cases, errors, SC.retrieval_scores(cases, SC.retrieved_refs(read, defs)), SC.answer_scores(cases, answers)


def brute_scores(name):
    out, want, read, attached, answer = RUN[name]
    if isinstance(answer, str):
        return [None] * 5
    found = [s in read + attached for s in want]
    refused, shown, dropped = answer
    cited = sum(n > 0 for n in shown)
    grounding = None if refused else cited / (cited + dropped) if cited + dropped else 0.0
    return [any(found) if want else None, sum(found) / len(found) if want else None, grounding, refused == out, dropped]


@pytest.mark.parametrize("name", RUN)
def test_scores_of_a_case(scored, name):
    cases, errors, retrieval, answers = scored
    row = SC.case_scores(cases, errors, retrieval, answers).filter(F.col("case_id") == name).first()
    got = [row[k] for k in ("retrieval_hit", "retrieval_recall", "grounding", "refusal_correct", "n_dropped")]
    assert got == [pytest.approx(x) if isinstance(x, float) else x for x in brute_scores(name)]


def test_rates_of_a_run(scored):
    cases, errors, retrieval, answers = scored
    full = SC.run_aggregate(SC.case_scores(cases, errors, retrieval, answers)).first()
    score = {k: brute_scores(k) for k in RUN}
    inside, outside = [k for k in RUN if not RUN[k][0]], [k for k in RUN if RUN[k][0]]
    assert (full["cases"], full["in_scope"], full["out_of_scope"], full["errors"]) == (len(RUN), len(inside), len(outside), 1)
    assert full["dropped_claims"] == sum(s[4] or 0 for s in score.values())
    assert full["retrieval_hit_rate"] == pytest.approx(sum(bool(score[k][0]) for k in inside) / len(inside))
    assert full["retrieval_recall_mean"] == pytest.approx(sum(score[k][1] or 0 for k in inside) / len(inside))
    assert full["refusal_rate_out_of_scope"] == pytest.approx(1 / 3)
    assert full["false_refusal_rate_in_scope"] == pytest.approx(1 / 5)
    only = SC.run_aggregate(SC.case_scores(cases, errors, retrieval), "retrieval").first()
    assert only["retrieval_hit_rate"] == full["retrieval_hit_rate"]
    assert {only[k] for k in ("grounded_rate", "dropped_claims", "refusal_rate_out_of_scope", "false_refusal_rate_in_scope")} == {None}


def test_judged_mean_leaves_failed_calls_out(spark):
    blocks = lambda v: [("text", json.dumps({"fundamento": " r ", "veredicto": v}))]
    rows = [("a", blocks("correcta")), ("b", blocks("parcial")), ("c", blocks("quizás")), ("d", [("thinking", "x")]), ("e", [("text", "no json")])]
    responses = spark.createDataFrame(rows, "case_id STRING, content ARRAY<STRUCT<type: STRING, text: STRING>>")
    got = {r["case_id"]: (r["correctness"], r["rationale"], r["error"]) for r in SC.verdicts(responses).collect()}
    assert got["a"] == (1.0, "r", None) and got["b"][0] == 0.5
    assert got["c"][2] == "unknown verdict quizás" and got["d"][2] == "no text block" and got["e"][2] == "not a verdict"
    scores = spark.createDataFrame(
        [("a", False, None, 1.0, None), ("b", False, None, 0.5, None), ("c", False, None, None, "x"), ("d", False, "boom", None, None)],
        "case_id STRING, out_of_scope BOOLEAN, error STRING, correctness DOUBLE, judge_error STRING",
    )
    for name, kind in (("retrieval_hit", "boolean"), ("retrieval_recall", "double"), ("grounding", "double"), ("refusal_correct", "boolean"), ("n_dropped", "int")):
        scores = scores.withColumn(name, F.lit(None).cast(kind))
    agg = SC.run_aggregate(scores, "answer", judged=True).first()
    assert agg["correctness_mean"] == pytest.approx(0.5) and agg["judge_errors"] == 1


def test_routing_report(spark):
    cases = spark.createDataFrame([("a", ["61"], ["61", "91"]), ("b", ["91", "61"], ["61"])], "id STRING, expected ARRAY<STRING>, routed ARRAY<STRING>")
    rows = SC.routing_rows(cases)
    assert SC.routing_summary(rows).first().asDict() == {"accuracy": 0.5, "exact": 0.0}
    assert {r["part"]: r["recall"] for r in SC.routing_recall(rows).collect()} == {"61": 1.0, "91": 0.0}
    assert {r["id"]: (r["missing"], r["extra"]) for r in rows.collect()} == {"a": ([], ["91"]), "b": (["91"], [])}


def test_fingerprint_depends_on_the_set_only(spark):
    rows = [("a", "x"), ("b", "y"), ("c", "z")]
    df = lambda r, n: spark.createDataFrame(r, "id STRING, q STRING").repartition(n)
    a, b, c = (SC.fingerprint(x).first()[0] for x in (df(rows, 1), df(rows[::-1], 3), df(rows[:2] + [("c", "w")], 2)))
    assert a == b != c


def test_copy_reasons(spark):
    text = "El piloto debe acreditar la experiencia prevista en la sección según corresponda y vigente"
    rows = [
        ("¿Qué dice la 61.535?", text, fixed.NAMES_SECTION), ("che, debe acreditar la EXPERIENCIA prevista en la seccion según?", text, fixed.COPIES_WORDS),
        ("¿Qué experiencia necesito para volar?", text, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "q STRING, t STRING")
    assert [r[0] for r in df.select(K.copy_reason(F.col("q"), F.col("t"))).collect()] == [r[2] for r in rows]


def test_sampling_and_coverage(spark):
    long = "x" * 200
    sections = spark.createDataFrame(
        [("61", f"61.{i}", "Título", long) for i in range(8)] + [("61", "61.90", "Reservado", long), ("61", "61.91", "Corta", "x")], "part STRING, section STRING, title STRING, text STRING"
    )
    cases = spark.createDataFrame([("c", [("61", "61.0")])], "id STRING, expected ARRAY<STRUCT<part: STRING, section: STRING>>")
    cands = spark.createDataFrame([("61", "61.1")], "parte STRING, seccion STRING")
    covered = K.covered_sections(cases, cands)
    picked = lambda n, seed: sorted(r["section"] for r in K.sample_sections(sections, covered, n, seed).collect())
    assert picked(3, "s") == picked(3, "s") and len(picked(3, "s")) == 3
    assert picked(99, "s") == [f"61.{i}" for i in range(2, 8)]


def test_candidates_retry_and_review(spark):
    text = "uno dos tres cuatro cinco seis siete ocho nueve diez " * 5
    sections = spark.createDataFrame([("61", f"61.{i}", "T", text) for i in range(4)], "part STRING, section STRING, title STRING, text STRING")
    copy, free = "uno dos tres cuatro cinco seis siete ocho", "¿Qué hago?"
    reply = lambda q, r="ref": [("text", json.dumps({"pregunta": q, "respuesta_referencia": r}))]
    rows = [
        ("61", "61.0", 1, "m", reply(free)), ("61", "61.1", 1, "m", reply(copy)), ("61", "61.1", 2, "m", reply(free)),
        ("61", "61.2", 1, "m", reply(copy)), ("61", "61.2", 2, "m", reply(" ")), ("61", "61.3", 1, "m", reply(copy)),
    ]
    responses = spark.createDataFrame(rows, "part STRING, section STRING, attempt INT, model STRING, content ARRAY<STRUCT<type: STRING, text: STRING>>")
    good, again, notes = K.candidates_from(K.judge_attempts(sections, responses))
    assert sorted(r["id"] for r in good.collect()) == ["gen-61-61.0", "gen-61-61.1"]
    [retry] = Q.retry_requests(again, "m", "s").collect()
    messages = json.loads(retry["request"])["messages"]
    assert [m["role"] for m in messages] == ["user", "assistant", "user"] and fixed.COPIES_WORDS in messages[2]["content"]
    assert [r["note"] for r in notes.collect()] == ["61:61.2: respuesta inválida (empty question or reference answer)"]
    decisions = spark.createDataFrame([("gen-61-61.0", "E", "¿Nueva? ", " "), ("gen-61-61.1", "r", None, None)], "id STRING, choice STRING, question STRING, reference_answer STRING")
    reviewed = K.review(good, decisions)
    got = {r["id"]: (r["status"], r["question"], r["reference_answer"]) for r in reviewed.collect()}
    assert got == {"gen-61-61.0": (fixed.ACCEPTED, "¿Nueva?", "ref"), "gen-61-61.1": (fixed.REJECTED, free, "ref")}
    assert K.review_counts(reviewed).first().asDict() == {"accepted": 1, "rejected": 1, "skipped": 0, "pending": 0}
    assert K.to_cases(good).filter("id = 'gen-61-61.0'").first()["expected"] == [("61", "61.0")]


def test_requests(spark):
    page = lambda t, e="V": (0, 38, "2.27", e, None, "mayo 2026", t, [])
    pages = "ARRAY<STRUCT<page_index: INT, pdf_page: INT, printed_page: STRING, edition: STRING, amendment: STRING, date: STRING, text: STRING, rects: ARRAY<INT>>>"
    s = spark.createDataFrame([("h", "61", "61.5", 0, "Título", [page("uno"), page("dos")])], f"content_hash STRING, part STRING, section STRING, section_ord INT, title STRING, pages {pages}")
    d = spark.createDataFrame([("d", "1", "1.11", 7, "Noche", [page("Noche: x", None)])], f"content_hash STRING, part STRING, section STRING, def_ord INT, term STRING, pages {pages}")
    blocks = Q.prompt_blocks(
        spark.createDataFrame([("q", 0, "h", 0)], "question_id STRING, rank INT, content_hash STRING, section_ord INT"),
        spark.createDataFrame([("q", 0, "d", 7), ("z", 0, "d", 7)], "question_id STRING, rank INT, content_hash STRING, def_ord INT"), s, d,
    )
    asked = spark.createDataFrame([("q", '¿"VFR"?'), ("z", "nada")], "question_id STRING, question STRING")
    [row] = Q.answer_requests(asked, blocks, "m", "sys").collect()  # no section for z, so no request
    content = json.loads(row["request"])["messages"][0]["content"]
    assert [c.get("title") for c in content] == [f"{fixed.CORPUS} Parte 61 - Sección 61.5 Título", f"{fixed.CORPUS} Parte 1 - Sección 1.11 - Definición: Noche", None]
    assert [b["text"] for b in content[0]["source"]["content"]] == ["uno", "dos"]
    assert content[0]["context"] == "Edición V, mayo 2026" and "context" not in content[1] and content[2]["text"] == '¿"VFR"?'
    nodes = spark.createDataFrame([("61", "A", 0, None), ("61", "a1", 1, "0"), ("61", "B", 2, None)], "part STRING, title STRING, preorder INT, parent_id STRING")
    parts = spark.createDataFrame([("61", "Licencias", "d" * 2000), ("91", "Vuelo", None)], "part STRING, title STRING, description STRING")
    cards = Q.part_cards(parts, nodes)
    assert {r["part"]: (len(r["summary"]), r["divisions"]) for r in cards.collect()} == {"61": (1500, ["A", "B"]), "91": (0, [])}
    request = json.loads(Q.routing_requests(asked, cards, "m", "sys").first()["request"])
    assert request["output_config"]["format"]["schema"]["properties"]["partes"]["items"]["enum"] == ["61", "91"]
    one = cards.filter("part = '61'")
    assert Q.routing_requests(asked, one, "m", "sys").count() == 0
    assert [tuple(r) for r in Q.single_routes(asked, one).orderBy("question_id").collect()] == [("q", "61", 0), ("z", "61", 0)]
    answer = lambda codes: [("text", json.dumps({"partes": codes}))]
    replies = spark.createDataFrame([("q", answer(["91", "7", "61", "91"])), ("z", [("thinking", "x")])], "question_id STRING, content ARRAY<STRUCT<type: STRING, text: STRING>>")
    assert [r["part"] for r in Q.routed(replies, cards).orderBy("route_rank").collect()] == ["91", "61"]
    assert [r["question_id"] for r in Q.routing_errors(replies).collect()] == ["z"]
    judged = spark.createDataFrame([("c", "q", "r", "a")], "case_id STRING, question STRING, reference_answer STRING, text STRING")
    j = json.loads(Q.judge_requests(judged, "m", "sys").first()["request"])
    assert j["messages"][0]["content"] == "<pregunta>\nq\n</pregunta>\n\n<referencia>\nr\n</referencia>\n\n<respuesta>\na\n</respuesta>"


def test_render(spark):
    cases = {
        "items": said("Para retirar:\n- ", ("mostrar el carné", source(1), source(0)), ".\n- ", ("la ficha", source(0)), ".\n\nListo."),
        "gap": said(opening="COBERTURA: ninguna - lo dice la Parte 15.\n\n"), "silent": said("x", opening=None),
    }
    responses = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], schemas.RESPONSES)
    answers = G.ground(G.parse_responses(responses), spark.createDataFrame([(k, *d) for k in cases for d in SHELF], schemas.DOCUMENTS))
    out = {r["answer_id"]: r["text"] for r in RN.render(answers).collect()}
    assert out["items"].split("\n\n")[1] == "Para retirar:\n- Mostrar el carné. [1][2]\n- La ficha. [2]\nListo."
    assert f"[1] Parte 12, Sección 12.8 (Sala grande), página PDF 9 (página impresa c), Edición X Enmienda II (enero 2031) - {LINK}" in out["items"]
    assert out["gap"].split("\n\n")[1] == fixed.REFUSAL + " Lo que falta probablemente lo regula la Parte 15: la Sección 12.3 remite a ella. [1]"
    assert out["silent"] == fixed.NOTICE + "\n\n" + fixed.REFUSAL
    read = {r["answer_id"]: r["text"] for r in RN.judged_text(answers).collect()}
    assert read["items"] == "Para retirar: Mostrar el carné. La ficha. Listo."
    laid = RN.layout(G.sentence_rows(answers)).filter("answer_id = 'items'").orderBy("ord").collect()
    assert [(r["kind"], r["block"]) for r in laid] == [("paragraph", 1), ("list", 2), ("list", 2), ("paragraph", 3)]
    index = RN.citation_index(G.citation_rows(answers)).filter("answer_id = 'items'").orderBy("first_cited").collect()
    assert [(r["section"], r["cited_texts"]) for r in index] == [("12.8", ["lo citado"]), ("12.3", ["lo citado"])]
    asked = spark.createDataFrame([("items",), ("lost",)], "answer_id STRING")
    assert G.unanswerable(asked, spark.createDataFrame([("items", *SHELF[0])], schemas.DOCUMENTS)).first()["answer_id"] == "lost"
    assert set(G.public_answers(answers).columns) == {"answer_id", "sentences", "refused", "incomplete", "likely_parts"}


@pytest.mark.parametrize(
    "fn, text, expected",
    [
        (T.claim_tokens, "(a) Son tres (3) horas, 2.500 pies y 007 en Setiembre; (iv) veintidós", ["3", "2500", "7", "3", "setiembre", "22"]),
        (T.capitalize, '"hasta 2027', '"Hasta 2027'),
        (T.phrase, "Área de  Control (TMA) [x]", "área de control"),
        (T.words, "Ñandú straße 12", ["nandu", "stra", "e", "12"]),
        (T.words, "Nº 1º y 2ª, ﬁn x² №3 ①", ["no", "1o", "y", "2a", "fin", "x2", "no3", "1"]),
        (T.reflow, "co-\nrresponda;\n(b)\nsigue\nasí", "corresponda;\n(b) sigue así"),
        (T.clean_block, " a \t b \n\n c ", "a b\nc"),
        (T.sentence_pieces, "Sí. 61.520 va: bien.**\nFin", ["Sí.", " 61.520 va:", " bien.**", "\n", "Fin"]),
    ],
)
def test_text_functions(spark, fn, text, expected):
    got = spark.createDataFrame([(text,)], "t STRING").select(fn(F.col("t")).alias("x")).first()["x"]
    assert (sorted(set(got)) == sorted(set(expected))) if fn is T.claim_tokens else (got == expected)


def test_roman(spark):
    got = [r[0] for r in spark.range(1, 42).select(T.roman(F.col("id"))).collect()]
    assert got[:10] == ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"] and got[38:] == ["XXXIX", "XXXX", "XXXXI"]
