import re

import pytest
from pyspark.sql import functions as F

from fojas import fixed, schemas
from fojas.functions import labels as L
from fojas.functions import text as T
from fojas.operators import refs as R
from fojas.operators import structure as S
from fojas.queries.corpus import page_blocks

MARK = fixed.CORPUS


def blocks_of(spark, pages, content_hash="h", code="61"):
    """pages: list of (list of body texts, footer)."""
    rows = []
    for p, (bodies, footer) in enumerate(pages, 1):
        items = [(f"{MARK} PARTE {code}", 10.0), *[(b, 100.0 + i) for i, b in enumerate(bodies)]]
        if footer:
            items.append((footer, 750.0))
        rows += [(content_hash, p, 800.0, i, 0, 72.04, y, 300.0, y + 1, t) for i, (t, y) in enumerate(items)]
        rows.append((content_hash, p, 800.0, 99, 1, 0.0, 0.0, 1.0, 1.0, "image"))
    return spark.createDataFrame(rows, schemas.PAGE_BLOCKS)


FOOT = "ADMINISTRACIÓN NACIONAL\nVI Edición\nmayo 2026\nDE AVIACIÓN CIVIL\n {n}\nEnmienda I"


@pytest.fixture(scope="module")
def parsed(spark):
    index = "61.001\nDefiniciones\n61.005\nVigencia de las\nlicencias\n61.010\nOtra\n61.015 al 61.020 Reservado"
    body1 = "CAPÍTULO A — GENERALIDADES\nIntroducción\n61.001\nDefiniciones\n(a) Texto   uno.\nTexto dos.\n61.005 Vigencia de las\nlicencias\nconforme a la\n" + MARK + " 67; y\n(b)\notra cosa."
    body2 = "sigue aquí la Sección 61. 001 y 61.010.\nCAPÍTULO B — OTRO\nsuelto\n61.010\ninformación sobre vuelos\nTexto.\n61.015 al 61.020 Reservado\nnada"
    return blocks_of(spark, [([index], None), ([body1], FOOT.format(n=1)), ([body2], FOOT.format(n=2).replace("VI", "IV"))])


def test_pages_and_parts(parsed):
    rows = {r["pdf_page"]: r for r in S.pages(parsed).collect()}
    assert rows[1]["edition"] is None and rows[1]["printed_page"] is None
    assert (rows[2]["edition"], rows[2]["amendment"], rows[2]["date"], rows[2]["printed_page"]) == ("VI", "I", "mayo 2026", "1")
    [part] = S.parts(S.pages(parsed)).collect()
    assert part.asDict() == {"content_hash": "h", "part": "61", "page_count": 3, "edition": "VI", "amendment": "I"}


def test_sections(parsed):
    got = {r["section"]: r for r in S.sections(S.section_pages(parsed)).collect()}
    assert set(got) == {"61.001", "61.005", "61.010"}
    assert got["61.001"]["text"] == "61.001\nDefiniciones\n(a) Texto uno.\nTexto dos."
    assert got["61.005"]["title"] == "Vigencia de las licencias conforme a la"
    assert (got["61.005"]["pdf_page_start"], got["61.005"]["pdf_page_end"]) == (2, 3)
    assert got["61.005"]["text"].endswith("otra cosa.\nsigue aquí la Sección 61. 001 y 61.010.")
    assert got["61.010"]["title"] == "información sobre vuelos" and got["61.010"]["text"].endswith("Texto.")
    assert got["61.010"]["pages"][0]["rects"] == [(72.0, 100.0, 300.0, 101.0)]


def test_references(parsed):
    rows = R.references(S.section_pages(parsed)).orderBy("section_ord", "page_index", "at", "item").collect()
    got = [(r["section"], r["to_part"], r["to_section"], r["page_index"]) for r in rows]
    assert got == [("61.005", "67", None, 0), ("61.005", "61", "61.001", 1), ("61.005", "61", "61.010", 1)]
    assert rows[0]["text"] == f"{MARK} 67; y"  # the line before only repeats the title
    assert rows[1]["text"] == "sigue aquí la Sección 61. 001 y 61.010."


def test_quality(spark, parsed):
    bare = blocks_of(spark, [(["77.1\nTítulo\nTexto."], None)], "n", "77")
    both = parsed.unionByName(bare)
    pages = S.pages(both)
    got = {r["content_hash"]: r["error"] for r in S.quality(S.parts(pages), S.section_pages(both)).collect()}
    assert got == {"h": None, "n": "no edition in any footer"}


@pytest.mark.parametrize(
    "footer, expected",
    [
        ("ADMINISTRACIÓN NACIONAL\nI Edición\nmayo 2026\nDE AVIACIÓN CIVIL\nEnmienda 1\n", ("I", "I", "mayo 2026")),
        ("5º Edición\n24 Septiembre 2024\n", ("V", None, "24 septiembre 2024")),
        ("nada", None),
    ],
)
def test_footer(spark, footer, expected):
    v = spark.createDataFrame([(footer,)], "f STRING").select(L.footer_version(F.col("f")).alias("v")).first()["v"]
    assert v == expected


def named_parts(r):
    """A reference made by the grammar, head, codes and joiners, and the codes it names."""
    codes = [r.choice([str(r.randint(1, 999)), "".join(r.choices("BCFGHJKMQWXZ", k=r.randint(2, 3)))]) for _ in range(r.randint(1, 4))]
    head = r.choice([f"{MARK} ", f"{MARK} Parte ", f"{MARK}  Partes ", "Parte ", "las partes ", "la PARTE "])
    text = head + codes[0]
    for c in codes[1:]:
        text += r.choice([", ", " y ", " o ", " ó ", ","]) + r.choice(["", f"{MARK} ", "Parte "]) + c
    return text, codes


def unnamed_parts(r):
    """What looks like a reference and names no part."""
    n, m = r.randint(1, 99), r.randint(1, 99)
    return r.choice([f"Sección {n}.{m}", f"partes {n}.{m}", f"{MARK} {n}{m:03d}", f"{MARK} {n}abc", f"parte {r.choice(fixed.NOT_PART_CODES)}", f"{n} {MARK}", f"apartes {n}", "parte qx"])


def test_part_codes(spark):
    r = __import__("random").Random(41)
    rows, want = [], {}
    for i in range(300):
        text, codes = "", []
        for _ in range(r.randint(0, 4)):
            some, own = named_parts(r) if r.random() < 0.6 else (unnamed_parts(r), [])
            text += f"Véase {some}; "
            codes += [c for c in own if c not in codes]
        rows.append((i, text))
        want[i] = list(dict.fromkeys(codes))
    found = spark.createDataFrame(rows, "i INT, t STRING").select("i", T.part_codes(F.col("t")).alias("c")).collect()
    assert [x for x in found if x.c != want[x.i]] == []


def test_definitions(spark):
    heading = blocks_of(spark, [(["1.11\nDefiniciones\nNoche: x"], FOOT.format(n=1)), (["Pista: y"], FOOT.format(n=2))], "d", "1")
    lines = [
        # page, block, line, x0, text, bold
        (1, 1, 0, 72.0, "1.11", True), (1, 1, 1, 72.0, "Definiciones", True), (1, 2, 0, 72.0, "Noche (N): Las horas", True),
        (1, 2, 1, 72.0, "Sin negrita: sigue", False), (1, 2, 2, 90.0, "Nieve seca: sangría", True), (2, 1, 0, 73.0, "hasta el alba.", False),
        (2, 1, 1, 72.0, "Pista: Área", True), (2, 1, 2, 72.0, "5: no es término", True), (2, 2, 0, 72.0, "SUBPARTE C — SIGLAS", True), (2, 2, 1, 72.0, "Tarde: fuera", True),
    ]
    rows = [("d", p, b, n, x, (x, 1.0, 2.0, 3.0), t, 16 if bold else 0, 100.0, 800.0, t) for p, b, n, x, t, bold in lines]
    page_lines = spark.createDataFrame(rows, schemas.PAGE_LINES)
    pages = S.pages(heading)
    got = S.definitions(S.definition_pages(page_lines, S.section_pages(heading), pages)).orderBy("def_ord").collect()
    assert [(r["term"], [p["pdf_page"] for p in r["pages"]]) for r in got] == [("Noche (N)", [1, 2]), ("Pista", [2])]
    assert got[0]["text"] == "Noche (N): Las horas\nSin negrita: sigue\nNieve seca: sangría\nhasta el alba."
    assert got[1]["text"] == "Pista: Área\n5: no es término"
    q = S.quality(S.parts(pages), S.section_pages(heading), S.definition_lines(page_lines, S.section_pages(heading)))
    assert q.first()["error"] == "too few definitions"


def test_headings_of_a_long_file_take_linear_time(spark):
    import time

    def seconds(n):
        body = "\n".join(f"61.{i:03d}\nTítulo {i}" if i % 50 == 0 else f"línea {i} de texto" for i in range(n))
        df = blocks_of(spark, [([body], FOOT.format(n=1))])
        parsed = S.sections_of_lines(S.body_lines(df, S.parts(S.pages(df))), S.pages(df))
        started = time.time()
        parsed.write.format("noop").mode("overwrite").save()
        return time.time() - started

    seconds(500)
    assert seconds(16_000) < 8 * max(1.0, seconds(4_000))


def test_line_texts_are_exchanged_once_for_sections(spark, parsed, tmp_path):
    """Headings are told by marks that lines carry, and sections found where the file's lines are."""
    pages = S.pages(parsed)
    S.body_lines(parsed, S.parts(pages)).write.parquet(str(tmp_path / "lines"))
    sections = S.sections_of_lines(spark.read.parquet(str(tmp_path / "lines")), pages)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = sections._jdf.queryExecution().explainString(mode)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)", plan)
    assert len(moved) > 1 and len([m for m in moved if re.search(r"\bline#", m)]) == 1


def test_lines_are_cut_at_every_break(spark):
    texts = ["", "\n", "a", "a\nb\n", "a\r\nb", "\r\r\n\n", *[f"x{b}y\n{b}" for b in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"], "a\x1fb\u2027c\u00a0"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING").select("t", T.lines(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in rows] == [*[re.split(T.LINE_BREAKS, t) for t in texts], None]


def test_texts_and_footers_are_searched_once(spark):
    """A text is cut once for all of its pages, and each pattern looks at a footer once, however often its match is used."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([(1, 30, "\n".join("abc" for _ in range(30))), (2, 0, ""), (3, None, None)], "doc_id INT, n_chars INT, text STRING")
    blocks = page_blocks(docs)
    assert plan(blocks).count("split(") == 1
    assert sorted((r["content_hash"], r["pdf_page"], r["text"].count("abc")) for r in blocks.filter("block_no = 1").collect()) == [("1", 1, 12), ("1", 2, 12), ("1", 3, 6), ("2", 1, 0)]
    footers = spark.createDataFrame([("5º Edición\nEnmienda 12\n",), ("V Edición\nEnmienda ii\n",), (None,)], "f STRING")
    version = footers.select(L.footer_version(F.col("f")).alias("v"))
    assert [plan(version).count(p) for p in (fixed.EDITION, fixed.EDITION_NUMBER, fixed.AMENDMENT, fixed.FOOTER_DATE)] == [1] * 4
    assert [r["v"] for r in version.collect()] == [("V", "XII", None), ("V", "II", None), None]


def test_references_search_a_page_twice(spark):
    """Both kinds of reference in one search and one cut, and lines found without a pass over them for each reference."""
    text = "  según RAAC\nParte 91 y 67;\n(b)\nSecciones 61. 3 (a)(1) o 91.5\nsigue PARTES 7, LA\n\xa0fin. Sección 61.9\n\n "
    schema = "content_hash STRING, part STRING, section STRING, section_ord INT, title STRING, page_index INT, text STRING"
    refs = R.references(spark.createDataFrame([("h", "61", "61.7", 0, "fin de", 0, text), ("g", "61", "61.7", 0, "x", 0, None)], schema))
    got = sorted((r["to_part"], r["to_section"] or "", r["at"], r["text"]) for r in refs.collect())
    long = "Secciones 61. 3 (a)(1) o 91.5\nsigue PARTES 7, LA\n\xa0fin. Sección 61.9"
    first = "según RAAC\nParte 91 y 67;"
    assert got == [
        ("61", "61.3", 32, long), ("61", "61.9", 87, long), ("67", "", 8, first), ("7", "", 68, long), ("91", "", 8, first), ("91", "91.5", 32, long),
    ]
    plan = refs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RAAC") <= 4  # twice in the pattern, and two uses of it


def test_strip(spark):
    cases = ["", " ", "\n \t", "a", " a\n b \x85", "\U0001f600 ", " x y", None, "a" * 5000 + " " * 5000 + "."]
    rows = spark.createDataFrame([(c,) for c in cases], "c STRING")
    assert [r[0] for r in rows.select(T.strip(F.col("c"))).collect()] == [c if c is None else c.strip() for c in cases]
