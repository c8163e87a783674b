"""The pipeline on rows with planted cases, stage by stage and as a whole."""

import pytest

import corpus_pipeline as P
from fojas.llm import decontaminate, mix_flow
from tests.llm.helpers import DOCS, edited, near_components, prose
from tests.llm.test_lang_centroid import text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = [(i, text("bb", i, 80 + i % 60), "bb", f"src{i % 4}", 1) for i in range(120)]
    rows += [(200 + i, text("cc", 1000 + i, 90), "cc", "src1", 1) for i in range(60)]
    rows += [(300 + i, rows[i][1], "bb", "src2", 1) for i in range(6)]  # exact copies
    rows += [(310 + i, edited(rows[10 + i][1], 0.01, i), "bb", "src2", 1) for i in range(6)]  # near copies
    rows += [(320 + i, rows[20 + i][1] + " " + prose(i, 30) + " " + rows[30][1], "bb", None, 1) for i in range(5)]  # benchmark passages
    rows += [(400, None, None, None, None), (401, "", "bb", "src0", 0), (402, "?! 12", "bb", "src0", 5), (1, rows[1][1], "bb", "src1", 1), (None, text("bb", 777), "bb", "src0", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("id", "doc_id").selectExpr("*", "'clash' AS rejected", "1 AS copies", "2 AS shard")
    docs.write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame([(i, prose(i, 30)) for i in range(5)], "item_id long, text string").write.parquet(f"file://{top}/benchmark.parquet")
    return f"file://{top}"


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = docs.collect()
        if name != "sharded":
            assert docs.columns == P.COLUMNS
        kept[name] = {r.doc_id for r in after}
        if name == "language":
            assert {r.doc_id for r in before} - kept[name] == {400, 401, 402}
        if name == "near_duplicates":
            want = near_components([(r.doc_id, r.text) for r in {r.doc_id: r for r in before}.values()], 5, 80)
            assert sorted(x for x in (r.doc_id for r in after) if x is not None) == sorted(i for i, (_, c) in want.items() if i == c)
            assert None in kept[name]
        if name == "decontaminated":
            items = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert decontaminate.decontaminate(docs.withColumnRenamed("doc_id", "id"), items).filter("n_hit > 0").count() == 0
            old = {r.doc_id: r.text for r in before}
            assert all(r.text == old[r.doc_id] for r in after if not 320 <= (r.doc_id or 0) < 325)
            assert all(r.n_chars == len(r.text) for r in after if 320 <= (r.doc_id or 0) < 325)
        if name == "mixed":
            sized = [(r.source, len(r.text.split())) for r in before]
            sums = {}
            for s, n in sized:
                sums[s] = sums.get(s, 0) + n
            order = sorted(sums, key=lambda s: (s is None, s or ""))
            want = mix_flow.quotas_by_weight({s: sums[s] for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
            for s in order:
                assert abs(sum(len(r.text.split()) for r in after if r.source == s) - want[s]) <= 0.03 * want[s] + 60
        if name == "sharded":
            assert len(after) == len(before)
            for shard in range(P.SHARDS):
                own = sorted(r.slot for r in after if r.shard == shard)
                assert own == list(range(len(own)))


def test_run_is_the_stages_in_turn(spark, folder):
    rows = P.run(spark, folder).collect()
    assert len(rows) > 150 and {r.shard for r in rows} <= set(range(P.SHARDS))


def test_texts_that_share_an_id_are_judged_each_by_its_own(spark):
    own = [prose(i, 40) for i in range(4)]
    rows = [(1, own[0], "en", "s", 1), (2, own[1], "en", "s", 1), (2, own[0], "en", "s", 1), (2, own[1], "en", "s", 1), (3, own[2], "en", "s", 1), (3, own[3], "en", "s", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("id", "doc_id").selectExpr("*", "'x' AS id", "1 AS th", "2 AS kept", "3 AS row")
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, own[0]), (2, own[1]), (3, own[2]), (3, own[3]), (4, None)], key=str)


def test_stages_take_other_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS id", "1 AS size", "2 AS th", "3 AS sources", "4 AS score", "5 AS spans", "6 AS copy")
    for name, stage in P.STAGES:
        assert stage(spark, docs, folder).count() > 0, name
        assert stage(spark, docs.limit(0), folder).collect() == [], name
