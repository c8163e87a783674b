import random

import pytest

from fojas.llm import lang_centroid as L
from tests.llm.helpers import DOCS, awkward

ENDINGS = {"aa": ["schung", "keitz", "undw"], "bb": ["eaux", "oire", "ènt"], "cc": ["ción", "ñol", "dades"]}


def text(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiou" if j % 2 else "bdlmnprst") for j in range(r.randint(1, 5))) + r.choice(ENDINGS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, i), lang, "s", 1) for i, lang in enumerate(random.Random(1).choices(list(ENDINGS), k=400))]
    return spark.createDataFrame(rows + awkward(), DOCS)


@pytest.fixture(scope="module")
def model(docs):
    return L.fold_train(docs.withColumnRenamed("id", "doc_id"), per_language=50)


def test_held_out_accuracy(docs, model):
    found = L.predict(docs.selectExpr("*", "1 AS score", "2 AS lang_pred"), model).filter(L.held_out("id"))
    truth = docs.filter("id < 400").select("id", "lang")
    both = found.join(truth, "id").collect()
    assert len(both) > 80
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)
    assert not any(r.rejected for r in both)
    assert all(0 <= r.score <= 1 for r in both)


def test_letterless_texts_are_undetermined_and_other_rows_stay(docs, model):
    got = L.predict(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.id: r for r in got}
    for i in (1000, 1001, 1002, 1005):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)


def test_far_text_is_rejected(spark, model):
    rows = [(1, "զքռ ծժղ " * 120, None, None, 0), (2, text("bb", 9999), None, None, 0)]
    got = {r.id: r.rejected for r in L.predict(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got == {1: True, 2: False}


def test_short_far_texts_are_rejected_and_short_near_ones_stay(spark, model):
    far = "эта строка написана другими буквами и потому далека от всего известного "
    rows = [(i, far[i:] + far[:i], None, None, 0) for i in range(20)]
    rows += [(100 + i, text(lang, 500 + i, words), None, None, 0) for i, (lang, words) in enumerate((x, n) for x in ENDINGS for n in (3, 5, 10, 20))]
    got = {r.id: r.rejected for r in L.predict(spark.createDataFrame(rows, DOCS), model).collect()}
    assert all(got[i] for i in range(20)) and not any(got[i] for i in got if i >= 100)


def test_a_few_junk_rows_do_not_set_the_bound(spark):
    clean = [(i, text("bb", i), "bb", "s", 1) for i in range(300)]
    junk = [(1000 + i, "".join(random.Random(i).choices("zxqjkw", k=500)), "bb", "s", 1) for i in range(3)]
    far = [(1, "էսպես գրված տող " * 30, None, None, 0)]
    with_junk = L.train(spark.createDataFrame(clean + junk, DOCS))
    assert [r.rejected for r in L.predict(spark.createDataFrame(far, DOCS), with_junk).collect()] == [True]


def test_a_language_of_few_texts_has_the_bound_of_others(spark):
    rows = [(i, text("bb", i), "bb", "s", 1) for i in range(100)] + [(200 + i, text("aa", i), "aa", "s", 1) for i in range(5)]
    model = L.train(spark.createDataFrame(rows, DOCS))
    assert L.np.isfinite(model.least[:, 8]).all() and set(model.langs) == {"aa", "bb"}


@pytest.mark.parametrize("stretch", [1, 5, 64])
def test_counts_in_stretches_are_those_of_the_whole(monkeypatch, stretch):
    texts = [t.encode() for t in ("", "a", "día", "é ñ 12 ab", text("cc", 3), "x" * 100, text("bb", 4, 9))]
    whole = L.gram_counts(texts)
    monkeypatch.setattr(L, "STRETCH", stretch)
    assert (L.gram_counts(texts) == whole).all() and whole.sum() > 0


def test_same_model_from_other_partitions(docs, model):
    again = L.fold_train(docs.repartition(7).withColumnRenamed("id", "doc_id"), per_language=50)
    assert again.langs == model.langs
    assert abs(again.centroids - model.centroids).max() < 1e-5


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    model = L.train(none)
    assert [r.lang_pred for r in L.predict(spark.createDataFrame([(1, "abc", None, None, 0)], DOCS), model).collect()] == ["und"]
    assert L.predict(none, model).collect() == []


def test_copies_are_one_text_of_the_sample(spark):
    rows = [(i, text("bb", i), "bb", "s", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    first = docs.orderBy(L.F.xxhash64("text", L.F.lit(1))).first()  # the copies of this one would fill the sample
    more = docs.unionByName(spark.createDataFrame([(1000 + i, first.text, "bb", "s", 1) for i in range(500)], DOCS))
    once, again = (sorted(r.text for r in L.sampled(d, 1, 50).collect()) for d in (docs, more))
    assert len(set(once)) == 50 and once == again
    copies = L.train(spark.createDataFrame([(i, first.text, "bb", "s", 1) for i in range(100)], DOCS), per_language=50)
    assert not L.np.isfinite(copies.least).any()
