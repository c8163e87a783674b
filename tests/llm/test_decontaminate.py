import re

import numpy as np
import pytest

from fojas.llm import decontaminate as D
from fojas.llm.fm_index import FMIndex, suffix_array
from tests.llm.helpers import DOCS, awkward, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for j in range(max(1, len(w) - width + 1) if w else 0):
            win = w[j : j + width]
            for i in range(len(own) - len(win) + 1):
                if own[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items():
    return [(i, prose(i, 25)) for i in range(8)] + [(8, "Kurz und GUT"), (9, None), (10, ""), (None, prose(3, 25)), (11, prose(5, 25)), (100, prose(6, 12))]


@pytest.fixture(scope="module")
def rows(items):
    out = awkward()
    for i in range(60):
        a = items[i % 8][1].split()
        cut = a[i % 5 : i % 5 + 8 + i % 9]
        out.append((i, f"{prose(300 + i, 20)}, {' '.join(cut).upper()}! {prose(600 + i, 15)} " + ("kurz, und gut" if i % 4 == 0 else ""), "en", "s", 1))
    out += [(200 + i, items[2][1], "en", "s", 1) for i in range(30)]
    return out


def test_equals_brute_force(spark, rows, items):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS clean_text", "1 AS n_hit", "1 AS item_id")
    got = sorted(D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect(), key=str)
    usable = [x for x in items if x[0] is not None and x[1]]
    want = [(r[0], *brute(r[1], usable, 10)) for r in rows]
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.n_hit == sum(s.stop - s.start for s in r.spans)


def test_cleaned_texts_hold_no_window(spark, rows, items):
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("id", "doc_id")
    table = spark.createDataFrame(items, "item_id long, text string")
    clean = D.cleaned(docs, table)
    assert clean.columns == docs.columns
    assert D.decontaminate(clean.withColumnRenamed("doc_id", "id"), table).filter("n_hit > 0").count() == 0
    usable = [x for x in items if x[0] is not None and x[1]]
    before = {(r[0], r[1]) for r in rows if brute(r[1], usable, 10)[1] == 0}
    assert before <= {(r.doc_id, r.text) for r in clean.collect()}


def test_empty_tables(spark, rows, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in D.decontaminate(spark.createDataFrame(rows, DOCS), none).collect())
    assert D.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_too_large_a_benchmark_is_refused(spark, rows):
    with pytest.raises(ValueError, match="characters"):
        D.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, "abc def")], "item_id long, text string"), max_item_chars=3)


def test_index_finds_what_a_scan_finds():
    r = np.random.default_rng(1)
    for size, letters in ((0, 3), (1, 3), (50, 2), (3000, 3), (3000, 60)):
        text = np.append(r.integers(0, letters + 1, size), 0)
        index = FMIndex(text)
        for m in (1, 2, 5):
            phrases = r.integers(1, letters + 3, (40, m))
            which, lo, hi = index.search(phrases)
            got = {(w, p) for w, a, b in zip(which, lo, hi) for p in index.locate(np.arange(a, b)).tolist()}
            want = {(w, p) for w in range(40) for p in range(len(text) - m + 1) if (text[p : p + m] == phrases[w]).all()}
            assert got == want


def test_suffixes_are_in_order():
    text = np.array([1, 2, 1, 2, 0, 1, 2, 1, 2, 0, 2, 0])
    order = suffix_array(text).tolist()
    own = lambda p: [(0, sum(text[:j] == 0)) if text[j] == 0 else (text[j], 0) for j in range(p, len(text))]
    key = lambda p: [(-1, x[1]) if x[0] == 0 else x for x in own(p)]
    assert order == sorted(range(len(text)), key=key)
