"""Answers about the rules of an invented library, mapped from responses given part by part."""

import json

import pytest
from pyspark.sql import functions as F

from fojas import schemas
from fojas.operators import grounding as G

LOAN = "El socio lleva a su casa cuatro (4) libros durante veintiún días, y una revista por semana"
ROOM = "La sala grande abre desde el 2 de noviembre de 2031 con 80 mesas"
LINK = "https://biblioteca.example/12"


def sheet(n, label, edition="IX", amendment=None, date=None):
    return (n, label, edition, amendment, date)


#: Three documents of every prompt: loans, the reading room, and a defined term.
SHELF = [
    (0, "12", "12.3", "Préstamo", None, LINK, [sheet(4, "a"), sheet(5, "b")], [("15", *sheet(5, "b"), "véase la 15;")]),
    (1, "12", "12.8", "Sala grande", None, LINK, [sheet(9, "c", "X", "II", "enero 2031")], [("15", *sheet(9, "c", "X", "II", "enero 2031"), "según la 15.")]),
    (2, "20", "20.1", "Glosario", "Socio", None, [sheet(2, "ii", None)], []),
]


def source(doc, text="lo citado", at=0, upto=None, kind="content_block_location"):
    return dict(type=kind, document_index=doc, start_block_index=at, end_block_index=at + 1 if upto is None else upto, cited_text=text)


def said(*pieces, opening="COBERTURA: total\n\n", stop="end_turn"):
    """A response: plain strings, and (text, sources...) for what is cited."""
    blocks = [opening] if opening else []
    blocks += pieces
    content = [
        {"type": "text", "text": b, "citations": None} if isinstance(b, str) else {"type": "text", "text": b[0], "citations": list(b[1:])}
        for b in blocks
    ]
    return {"model": "m", "stop_reason": stop, "content": content}


def ground_all(spark, given, raw=None):
    rows = [(name, json.dumps(r)) for name, r in given.items()] + list((raw or {}).items())
    documents = spark.createDataFrame([(name, *d) for name, _ in rows for d in SHELF], schemas.DOCUMENTS)
    answers = G.ground(G.parse_responses(spark.createDataFrame(rows, schemas.RESPONSES)), documents)
    return {a["answer_id"]: a for a in answers.collect()}


BORROW = ("los socios se llevan libros", source(0, LOAN))
CLAIMS = {
    "Caben cuatro libros por socio.": True, "Caben 4 y la revista.": True, "Caben siete libros.": False, "Abre en noviembre.": True, "Abre en abril.": False,
    "Hay ochenta mesas.": True, "Hay 81 mesas.": False, "Abre el 2 de noviembre de 2031.": True, "Figura en la Sección 12.3.": True, "Figura en la Sección 12.4.": False,
}


@pytest.fixture(scope="module")
def answers(spark):
    given = {f"claim {c}": said("En general ", ("los socios se llevan libros", source(0, LOAN), source(1, ROOM)), f". {c}") for c in CLAIMS}
    given |= {
        "mixed": said("Depende del carné. Si lo tenés, ", BORROW, ". La multa es de 900 pesos. Por lo demás ", ("rige el horario de la sala", source(1, ROOM)), "."),
        "wrong inside": said("Se prestan ", ("nueve libros por socio", source(0, LOAN)), "."),
        "dots": said("Dice la Sección 12.3 (b)(2)(iv) ", ("que son cuatro. Y una revista", source(0, LOAN)), " por semana."),
        "steps": said("**Mirá.** Para retirar hace falta:\n\n1. ", ("mostrar el carné", source(0)), ". Nada más.\n2. ", ("firmar la ficha", source(0)), ".\n\nDespués ", ("se sale", source(0)), "."),
        "lost step": said("Para retirar:\n* ", ("mostrar el carné", source(0)), ".\n* Pagar 700 pesos. ", ("Y firmar la ficha", source(0)), "."),
        "quotes": said("Así se anuncia: ", ("«desde noviembre", source(1, ROOM)), " abre la sala». sin turnos. Cierra en 2044. ", ("pero se puede leer", source(1, ROOM)), "."),
        "bare": said("Claro que sí."),
        "afterwards": said("Hay que ", ("firmar", source(0)), ".\nCOBERTURA: total", opening=None),
        "cited opening": said(("COBERTURA: total", source(0)), ". Hay que ", ("firmar", source(0)), opening=None),
        "declined": said(opening=None, stop="refusal"),
        "term": said(("Quien no es socio no retira", source(0)), ", y socio ", ("es quien firmó la ficha", source(2, "Socio: quien firma")), "."),
        "two pages": said("Se puede ", ("retirar", source(0, LOAN, 0, 2)), "."),
        "half, cited": said("Se puede ", ("leer en la sala", source(1)), ".", opening="COBERTURA: parcial - hasta qué hora; está en la Parte 15.\n\n"),
        "none, ranked": said(opening="COBERTURA: ninguna - lo dice la Parte 15.\n\n"),
        "none, named": said(opening="COBERTURA: ninguna - la Sección 12.8 lleva a la Parte 15.\n\n"),
        "none, elsewhere": said(opening="COBERTURA: ninguna - lo dice la Parte 44.\n\n"),
        "none, but cited": said(("se retira", source(1)), ".", opening="COBERTURA: ninguna - la Parte 15.\n\n"),
        "kind": said(("Algo", source(0, kind="char_location")), "."), "beyond": said(("Algo", source(1, at=3)), "."), "backwards": said(("Algo", source(0, at=1, upto=1)), "."),
        "no such document": said(("Algo", source(6)), "."), "document -1": said(("Algo", source(-1)), "."), "page -1": said(("Algo", source(0, at=-1, upto=1)), "."),
    }
    for word in ("total", "parcial", "ninguna", "tal vez"):
        given[f"opens {word}"] = said("Se puede ", BORROW, ".", opening=f"COBERTURA: {word} - sin más\n\n" if word != "total" else "COBERTURA: total\n\n")
    return ground_all(spark, given, {"not json": "{{", "no content": '{"model": "m"}', "number": "17"})


def kept(answer):
    return [s["text"] for s in answer["sentences"]]


@pytest.mark.parametrize("claim", CLAIMS)
def test_a_claim_needs_its_numbers_months_and_sections_in_what_is_cited(answers, claim):
    answer = answers[f"claim {claim}"]
    assert (claim in kept(answer), claim in answer["dropped"]) == (CLAIMS[claim], not CLAIMS[claim])
    assert kept(answer)[0] == "En general los socios se llevan libros."


def test_sentences_without_claims_stay_uncited(answers):
    answer = answers["mixed"]
    assert [len(s["citations"]) for s in answer["sentences"]] == [0, 1, 1]
    assert kept(answer) == ["Depende del carné.", "Si lo tenés, los socios se llevan libros.", "Por lo demás rige el horario de la sala."]
    assert answer["dropped"] == ["La multa es de 900 pesos."]


def test_a_citation_does_not_excuse_another_number(answers):
    assert answers["wrong inside"]["refused"] and answers["wrong inside"]["dropped"] == ["Se prestan nueve libros por socio."]


def test_neither_section_numbers_nor_cited_text_are_cut(answers):
    assert kept(answers["dots"]) == ["Dice la Sección 12.3 (b)(2)(iv) que son cuatro. Y una revista por semana."]


def test_items_and_paragraphs(answers):
    assert [(s["starts"], s["text"]) for s in answers["steps"]["sentences"]] == [
        (None, "Mirá."), (None, "Para retirar hace falta:"), ("item", "Mostrar el carné."), (None, "Nada más."), ("item", "Firmar la ficha."), ("paragraph", "Después se sale."),
    ]


def test_what_follows_a_dropped_start_takes_its_place(answers):
    assert [(s["starts"], s["text"]) for s in answers["lost step"]["sentences"]] == [(None, "Para retirar:"), ("item", "Mostrar el carné."), ("item", "Y firmar la ficha.")]
    assert answers["lost step"]["dropped"] == ["Pagar 700 pesos."]


def test_sentences_begin_with_a_capital(answers):
    assert kept(answers["quotes"]) == ["Así se anuncia:", "«desde noviembre abre la sala».", "Sin turnos.", "Pero se puede leer."]


@pytest.mark.parametrize("name", ["bare", "afterwards", "cited opening", "declined", "none, but cited", "opens ninguna", "opens tal vez"])
def test_refusals_show_nothing(answers, name):
    assert answers[name]["refused"] and not answers[name]["sentences"]


def test_what_the_opening_line_says(answers):
    assert not answers["opens total"]["incomplete"] and answers["opens parcial"]["incomplete"]
    assert not answers["opens total"]["refused"] and not answers["opens parcial"]["refused"]
    assert answers["opens total"]["gap"] is None and answers["half, cited"]["gap"] == "hasta qué hora; está en la Parte 15."


def test_citations_carry_pages_and_versions(answers):
    [whole] = answers["two pages"]["sentences"][0]["citations"]
    assert [whole[f] for f in ("pdf_page_start", "pdf_page_end", "printed_page_start", "printed_page_end", "source_url")] == [4, 5, "a", "b", LINK]
    plain, term = answers["term"]["sentences"][0]["citations"]
    assert (plain["term"], plain["section"]) == (None, "12.3")
    assert [term[f] for f in ("part", "term", "title", "edition", "printed_page_start", "source_url")] == ["20", "Socio", "Definición de «Socio»", None, "ii", None]


@pytest.mark.parametrize(
    "name, message",
    [
        ("kind", "unexpected citation type char_location"), ("beyond", "out of bounds for section 12.8"), ("backwards", "out of bounds for section 12.3"), ("page -1", "out of bounds"),
        ("no such document", "unknown document"), ("document -1", "unknown document"), ("not json", "without content"), ("no content", "without content"), ("number", "without content"),
    ],
)
def test_defects_are_error_rows_and_no_refusals(answers, name, message):
    assert message in answers[name]["error"] and answers[name]["refused"] is None


@pytest.mark.parametrize("name, section", [("half, cited", "12.8"), ("none, ranked", "12.3"), ("none, named", "12.8"), ("none, but cited", "12.8")])
def test_the_part_where_an_answer_is_likely(answers, name, section):
    [found] = answers[name]["likely_parts"]
    assert found["part"] == "15" and found["citation"]["section"] == section


def test_parts_that_nothing_refers_to_are_not_likely(answers):
    assert answers["none, elsewhere"]["likely_parts"] == []


def test_answers_without_documents_refuse(spark):
    nothing = spark.createDataFrame([], schemas.DOCUMENTS)
    rows = spark.createDataFrame([("q", json.dumps(said("Se puede ", "todo.")))], schemas.RESPONSES)
    [answer] = G.ground(G.parse_responses(rows), nothing).select("answer_id", "refused", F.size("sentences").alias("n")).collect()
    assert answer.asDict() == {"answer_id": "q", "refused": True, "n": 0}


def cut_by_hand(pieces, opening="COBERTURA: total\n\n"):
    """(start, end, cited texts) of the sentences of an answer without claims, every place compared with every span."""
    full, spans = opening, []
    for p in pieces:
        text = p if isinstance(p, str) else p[0]
        if not isinstance(p, str):
            spans.append((len(full), len(full) + len(text), [c["cited_text"] for c in p[1:]]))
        full += text
    cuts = []
    for i in range(len(opening) + 1, len(full) + 1):
        before, after = full[:i], full[i : i + 1]
        ends = before[-1] in ".!?:;" or (len(before) > 2 and before[-3] in ".!?:;" and before[-2:] in ("**", "__"))
        if (ends and (not after or after.isspace()) or before[-1] == "\n") and not any(a < i < b for a, b, _ in spans):
            cuts.append(i)
    cuts = sorted({*cuts, len(full)})
    out = []
    for a, b in zip([len(opening), *cuts], cuts):
        if any(c.isalpha() for c in full[a:b]):
            out.append((a, b, [t for x, y, cited in spans if a <= x and y <= b for t in cited]))
    return out if any(cited for _, _, cited in out) else []


def test_spans_meet_pieces_as_if_all_were_compared(spark):
    import random

    given = {}
    for seed in range(60):
        r = random.Random(seed)
        bits = ["hay libros", ". ", "!", " ", "\n", "- ", "la sala: ", "**mesa.** ", "", "y sillas. Y luz", ";"]
        given[f"r{seed}"] = [r.choice(bits) if r.random() < 0.6 else (r.choice(bits), *[source(0, f"c{r.randint(0, 99)} x") for _ in range(r.randint(1, 2))]) for _ in range(r.randint(1, 25))]
    got = ground_all(spark, {k: said(*v) for k, v in given.items()})
    for k, pieces in given.items():
        # citations such as c7 carry no claim: only numbers on their own do
        mine = [(s["start"], s["end"], [c["cited_text"] for c in s["citations"]]) for s in got[k]["sentences"]]
        assert mine == cut_by_hand(pieces), (k, pieces)


def test_an_answer_of_thousands_of_citations(spark):
    pieces = [x for i in range(3000) for x in ((f"La regla {i} vale {i} días", source(i % 2, f"regla {i} de {i} días")), f". Y cuesta {i + 5000}. ")]
    [a] = ground_all(spark, {"many": said(*pieces)}).values()
    assert [len(s["citations"]) for s in a["sentences"]] == [1] * 3000 and len(a["dropped"]) == 3000
    assert a["sentences"][2999]["text"] == "La regla 2999 vale 2999 días." and a["dropped"][7] == "Y cuesta 5007."
