"""From pages to a scored answer, through every stage."""

import json

from pyspark.sql import functions as F

from fojas import fixed, schemas
from fojas.operators import render as RN
from fojas.plans import jobs as J
from fojas.plans import replay as RP
from test_structure import FOOT, blocks_of

MARK = fixed.CORPUS


def test_pages_to_scores(spark, tmp_path):
    body = f"Introducción\n61.001\nVuelo nocturno\nHacen falta tres (3) horas de vuelo nocturno.\nLo demás está en la {MARK} 67.\nTexto."
    blocks = blocks_of(spark, [([body], FOOT.format(n=10))], "h").unionByName(
        blocks_of(spark, [(["Introducción\n1.11\nDefiniciones\nVuelo nocturno: (Ver noche).\nNoche: Las horas.\nTexto."], FOOT.format(n=1))], "d", "1")
    )
    lines = [(1, 0, "1.11", True), (1, 1, "Vuelo nocturno: (Ver noche).", True), (1, 2, "Noche: Las horas.", True)]
    page_lines = spark.createDataFrame([("d", p, 1, n, 72.0, (72.0, 1.0, 2.0, 3.0), t, 16 if b else 0, 100.0, 800.0, t) for p, n, t, b in lines], schemas.PAGE_LINES)
    corpus = J.parse_corpus(blocks, str(tmp_path), page_lines=page_lines)
    assert sorted(r["section"] for r in corpus["sections"].collect()) == ["1.11", "61.001"]
    events = spark.createDataFrame([("q", "61", 1, "tool_call", "get_page_content", '{"pages": "1"}')], schemas.SEARCH_EVENTS)
    routes = spark.createDataFrame([("q", "61", 0)], "question_id STRING, part STRING, route_rank INT")
    sections, definitions = J.retrieve(corpus, routes, events)
    assert [r["term"] for r in definitions.orderBy("rank").collect()] == ["Vuelo nocturno", "Noche"]
    questions = spark.createDataFrame([("q", "¿De noche?")], "question_id STRING, question STRING")
    request = json.loads(J.answer_requests(corpus, questions, sections, definitions, "m", "s").first()["request"])
    assert len(request["messages"][0]["content"]) == 4
    raw = {
        "model": "m", "stop_reason": "end_turn",
        "content": [
            {"type": "text", "text": "COBERTURA: parcial - lo demás lo regula la Parte 67.\n\nHacen falta ", "citations": None},
            {"type": "text", "text": "3 horas de noche", "citations": [
                {"type": "content_block_location", "cited_text": "tres (3) horas", "document_index": 0, "start_block_index": 0, "end_block_index": 1},
                {"type": "content_block_location", "cited_text": "Noche: Las horas.", "document_index": 2, "start_block_index": 0, "end_block_index": 1}]},
            {"type": "text", "text": ". Vence en 2030.", "citations": None},
        ],
    }
    responses = spark.createDataFrame([("q", json.dumps(raw))], schemas.RESPONSES)
    urls = spark.createDataFrame([("61", "u61"), ("1", "u1")], "part STRING, source_url STRING")
    answers = J.answers(corpus, responses, sections, definitions, urls)
    [a] = answers.collect()
    assert [s["text"] for s in a["sentences"]] == ["Hacen falta 3 horas de noche."] and a["dropped"] == ["Vence en 2030."]
    assert [(c["section"], c["term"], c["printed_page_start"]) for c in a["sentences"][0]["citations"]] == [("61.001", None, "10"), ("1.11", "Noche", "1")]
    [likely] = a["likely_parts"]
    assert (likely["part"], likely["citation"]["cited_text"]) == ("67", f"Lo demás está en la {MARK} 67.")
    assert "la Sección 61.001 remite a ella. [1]" in RN.render(answers).first()["text"]
    cases = spark.createDataFrame([("q", False, [("61", "61.001"), ("1", "1.11")])], "id STRING, out_of_scope BOOLEAN, expected ARRAY<STRUCT<part: STRING, section: STRING>>")
    judged = spark.createDataFrame([("q", 1.0, "correcta", "r", None)], "case_id STRING, correctness DOUBLE, verdict STRING, rationale STRING, error STRING")
    results, rates = J.evaluate(cases, sections, definitions, answers, judged)
    assert results.first()["grounding"] == 0.5
    r = rates.first()
    assert (r["retrieval_recall_mean"], r["grounded_rate"], r["dropped_claims"], r["correctness_mean"]) == (1.0, 0.0, 1, 1.0)
    check_modes(spark, tmp_path, corpus, routes, events, responses, urls)


def check_modes(spark, tmp_path, corpus, routes, events, responses, urls):
    """A run in one go scores as retrieval alone and answers over its recording do; a question that found nothing is refused."""
    refs = "ARRAY<STRUCT<part: STRING, section: STRING>>"
    asked = [("q", "¿De noche?", False, [("61", "61.001")]), ("s", "¿Y el mar?", True, []), ("t", "¿Y la luna?", False, [("61", "61.001")])]
    cases = spark.createDataFrame(asked, f"id STRING, question STRING, out_of_scope BOOLEAN, expected {refs}")
    columns = ["case_id", "error", "retrieval_recall", "grounding", "refusal_correct", "n_dropped"]
    scores = lambda run: {r.case_id: tuple(r)[1:] for r in run[0].select(*columns).collect()}
    run = lambda stage, **more: scores(RP.run(corpus, cases, str(tmp_path / stage), stage, **more))
    full = run("full", responses=responses, urls=urls, routes=routes, events=events)
    assert full == {"q": (None, 1.0, 0.5, True, 1), "s": (None, None, None, True, 0), "t": (None, 0.0, None, False, 0)}
    alone = run("retrieval", routes=routes, events=events)
    assert alone == {k: (*v[:2], None, None, None) for k, v in full.items()}
    shapes = dict(f.split(": ", 1) for f in ("retrieved_secciones: ARRAY<STRUCT<parte: STRING, seccion: STRING>>", "definiciones: ARRAY<STRUCT<parte: STRING, seccion: STRING, term: STRING>>"))
    rows = [("q", "¿De noche?", None, [("61", "61.001")], [("1", "1.11", "Vuelo nocturno"), ("1", "1.11", "Noche")]), ("s", "¿Y el mar?", None, [], []), ("t", "¿Y la luna?", None, [], [])]
    recorded = spark.createDataFrame(rows, "id STRING, question STRING, error STRING, " + ", ".join(f"{k} {v}" for k, v in shapes.items()))
    loaded = corpus["parts"].select("part", "content_hash")
    replay = dict(responses=responses, urls=urls, recorded=recorded)
    assert run("answer", recorded_versions=loaded, **replay) == {k: (v[0], None, *v[2:]) for k, v in full.items()}
    moved = run("answer", recorded_versions=loaded.withColumn("content_hash", F.concat("content_hash", F.lit("x"))), **replay)
    assert moved["q"][0].startswith("part loaded in another version") and moved["s"][0] is None
    unanswered = run("answer", recorded_versions=loaded, responses=responses.limit(0), urls=urls, recorded=recorded)
    assert unanswered["q"][0] == "no answer" and unanswered["s"] == (None, None, None, True, 0)


def test_run_report_round_trip(spark, tmp_path):
    from fojas.operators import scoring as SC
    from fojas.operators import usage as U
    from fojas.sources import cases as C

    refs = "ARRAY<STRUCT<part: STRING, section: STRING>>"
    cases = spark.createDataFrame([("a", "¿a?", False, [("12", "3")]), ("b", "¿b?", True, []), ("c", "¿c?", False, [("12", "4")])], f"id STRING, question STRING, out_of_scope BOOLEAN, expected {refs}")
    answers = spark.createDataFrame([("a", "m1", False, [(["x"],)], [], None), ("b", "m2", True, [], [], None)], "answer_id STRING, model STRING, refused BOOLEAN, sentences ARRAY<STRUCT<citations: ARRAY<STRING>>>, dropped ARRAY<STRING>, error STRING")
    read = spark.createDataFrame([("a", "12", "3")], "question_id STRING, part STRING, section STRING")
    results, rates = J.evaluate(cases, read, read.limit(0), answers)
    assert {r.case_id: r.error for r in results.collect()} == {"a": None, "b": None, "c": "no answer"}
    usage = spark.createDataFrame([("a", "answer", 1, 10, 0, 0, 5, 0, 2.0), ("b", "answer", 1, 4, 0, 0, 1, 0, 1.0)], "exchange_id STRING, stage STRING, requests INT, input_tokens INT, cache_creation_input_tokens INT, cache_read_input_tokens INT, output_tokens INT, unmetered_requests INT, cost_usd DOUBLE")
    versions = spark.createDataFrame([("12", "h", "IX", None, False)], "parte STRING, content_hash STRING, edicion STRING, enmienda STRING, from_cache BOOLEAN")
    report = J.run_report(results, rates, U.run_costs(usage, cases), cases, answers, versions, "spark")
    row = report.first()
    assert (row.aggregate.cost_usd, row.aggregate.cost_usd_mean, row.aggregate.errors) == (3.0, 1.0, 1)
    assert row.pipeline.served_answer_models == ["m1", "m2"] and [c.id for c in row.cases] == ["a", "b", "c"]
    assert row.cases_sha256 == SC.fingerprint(cases).first()[0]
    C.write_report(report, str(tmp_path / "r"))
    back = C.read_reports(spark, str(tmp_path / "r"))
    status = C.replay_status(cases.withColumn("question", F.when(F.col("id") == "b", "other").otherwise(F.col("question"))), C.recorded_cases(back))
    assert {r.id: r.replay for r in status.collect()} == {"a": "ok", "b": "changed", "c": "errored"}


def test_prompt_documents_carry_page_versions_and_references(spark, tmp_path):
    from fojas.queries import QUERIES

    told = f"Lo que falta sobre los vuelos de noche se encuentra en la {MARK} 67."
    lines = ["Vuelo nocturno", *["Nada más hay que decir sobre los vuelos de noche en esta línea."] * 12, told]
    assert [len(x) % 10 in (5, 7) or 14 < len(x) <= 60 for x in lines] == [False] * 14  # a heading and plain lines
    documents = spark.createDataFrame([(7, 30, "\n".join(lines)), (8, 31, "\n".join(lines[:-1]))], "doc_id BIGINT, n_chars BIGINT, text STRING")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    a, b = QUERIES["q35_prompt_documents"](spark, str(tmp_path)).orderBy("answer_id").collect()
    assert (a.answer_id, a.document_index, a.part, a.section, a.title, a.source_url, a.n_pages) == ("7", 0, "61", "61.14", "Vuelo nocturno", "https://example.org/61", 2)
    assert [tuple(p) for p in a.pages] == [(1, "2.1", "II", "I", "mayo 2026"), (2, "2", "III", "II", "mayo 2026")]
    assert [tuple(p) for p in b.pages] == [(1, "2.1", "III", "I", "mayo 2026"), (2, "2", "I", "II", "mayo 2026")]
    assert [tuple(r) for r in a.refs] == [("67", 2, "2", "III", "II", "mayo 2026", told)] and b.refs is None
