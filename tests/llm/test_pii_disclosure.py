import hashlib
import re

from fojas.llm import pii_disclosure as P
from tests.llm.helpers import DOCS, awkward, prose

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    "a@b.c_d@e.f x@@y.z é1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "+1 (234) 567-8901 4111 1111 1111 1111 4111-1111-1111-1112 😀 a.b@c-d.e.f. +123",
    "a@b.c@d.e 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 99 12--34", "4111111111111111 4111111111111111 00000000000000000 +12345678", "9" * 5000 + "a" * 5000 + "@" + ".c" * 900 + " b@c" + ".d" * 5000,
    "1.2.3 1.2.3.999 +1+2345678901", "x" * 300,
]


def test_base_spans_equal_the_patterns(spark):
    rows = awkward() + [(i, t, None, None, 0) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS start", "'x' AS kind", "2 AS n", "3 AS th")
    got = P.listed(docs, P.find(docs)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *(sum(s[0] == k for s in base(r[1])) for k in BASE), hashlib.sha256(written(base(r[1])).encode()).hexdigest(), written(base(r[1]))) for r in rows)
    assert sorted((str(r.id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == want


def test_terms_beside_one_entity_are_marked_everywhere(spark):
    rows = [(i, f"{prose(i, 12)} Zorblatt wrote jo@ex.org {prose(100 + i, 12)}", None, None, 0) for i in range(8)]
    rows += [(50, "nothing but ZORBLATT here", None, None, 0), (51, "zorblatts is another word", None, None, 0)]
    rows += [(100 + i, f"{prose(500 + i, 20)} common wrote", None, None, 0) for i in range(400)]
    rows += [(2000 + i, f"common {i}@ex.org wrote", None, None, 0) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    found = P.find(docs)
    got = {r.id: r.spans for r in P.listed(docs, found).collect()}
    assert got[50] == "term:12:20" and got[51] == ""
    assert all("term" in got[i] for i in range(8)) and all(got[i] == "" for i in range(100, 500))
    clean = {r.id: r.clean_text for r in P.sanitised(docs, found).collect()}
    assert clean[50] == "nothing but [TERM] here" and clean[51] == rows[9][1]
    assert "[TERM]" in clean[3] and "[EMAIL]" in clean[3] and "jo@" not in clean[3]


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert P.listed(none, P.find(none)).collect() == []


def test_terms_far_from_the_entity_are_counted_with_it(spark):
    rows = [(i, f"Qualbert opens {prose(i, 60)} and ends jo@ex.org", None, None, 0) for i in range(5)]
    rows += [(10 + i, f"{'Vimpel' if i % 3 else prose(30 + i, 40)} {prose(50 + i, 30 * (i % 3))} vimpel al@ex.org", None, None, 0) for i in range(6)]
    rows += [(20 + i, f"Dunkorb {prose(70 + i % 4, 20)} ed@ex.org", None, None, 0) for i in range(8)]  # four texts only
    rows += [(40, "qualbert, dunkorb, vimpel", None, None, 0)] + [(41, "qualbert, too", None, None, 0)] * 9
    rows += [(100 + i, prose(500 + i, 20), None, None, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.term, r.entity): (r.n_together, r.n_term) for r in P.revealing_terms(docs, P.base_matches(docs), 5, 0.7, 4.0).collect()}
    assert got[("qualbert", "email:jo@ex.org")] == (5, 7)
    assert got[("vimpel", "email:al@ex.org")] == (6, 7)
    assert not any(term == "dunkorb" for term, _ in got)


def test_a_true_five_of_texts_is_five(spark):
    rows = [(1000 * g + i, f"name{g}x {prose(1000 * g + i, 6)} p{g}@ex.org", None, None, 0) for g in range(300) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.term for r in P.revealing_terms(docs, P.base_matches(docs), 5, 0.8, 4.0).collect()}
    assert {f"name{g}x" for g in range(300)} <= got
