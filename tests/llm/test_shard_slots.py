import zlib

from fojas.llm import shard_slots as S
from tests.llm.helpers import DOCS, awkward, prose


def test_rows_sizes_and_places(spark, tmp_path):
    rows = awkward() + [(i, prose(i, 5 + i % 70), "en", "s", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS v_slot", "3 AS shard")
    got = S.shard_documents(docs, 7, f"file://{tmp_path}/map").collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.id), r.size, r.text_crc32) for r in got) == want
    for shard in range(7):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    slots = {}
    for r in got:
        assert slots.setdefault(r.v_slot, r.shard) == r.shard


def test_near_equal_bytes(spark, tmp_path):
    rows = [(i, prose(i, 5 + i % 90), None, None, 0) for i in range(3000)]
    got = S.shard_documents(spark.createDataFrame(rows, DOCS), 10, f"file://{tmp_path}/map").collect()
    total = [sum(r.size for r in got if r.shard == s) for s in range(10)]
    assert max(total) <= 1.02 * sum(total) / 10


def test_rebalancing_edits_the_map(spark, tmp_path):
    rows = [(i, prose(i, 30), None, None, 0) for i in range(3000)]
    docs, path = spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/map"
    before = {r.id: r.shard for r in S.shard_documents(docs, 4, path).collect()}
    after = S.shard_documents(docs, 5, path).collect()
    moved = [r for r in after if before[r.id] != r.shard]
    assert all(r.shard == 4 for r in moved) and 0.15 < len(moved) / len(rows) < 0.25
    version, mapping = S.load_map(spark, path)
    assert version == 2 and set(mapping.values()) == set(range(5))
    assert set(S.load_map(spark, path, 1)[1].values()) == set(range(4))
    fewer = S.rebalanced(mapping, {s: 1 for s in mapping}, 3)
    assert set(fewer.values()) == {0, 1, 2} and all(fewer[s] == mapping[s] for s in mapping if mapping[s] < 3)


def test_empty_table(spark, tmp_path):
    assert S.shard_documents(spark.createDataFrame([], DOCS), 3, f"file://{tmp_path}/map").collect() == []
