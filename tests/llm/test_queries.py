"""Every query over documents takes a table with other columns, named as those the operators use inside."""

import pytest

from fojas.llm.queries import QUERIES
from tests.llm.helpers import DOCS, awkward, prose

CLASHES = ("id", "th", "n", "g", "i", "h", "k", "size", "line", "lines", "part", "place", "spans", "shard", "v_slot", "key", "rep", "kind", "kept", "items", "score", "rejected", "path", "first", "x")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("clashes")
    rows = awkward() + [(i, prose(i % 20, 30 + i % 9) + f"\ntoken = {i}abcdefgh", ["en", "de"][i % 2], f"s{i % 3}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("id", "doc_id")
    items = spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string")
    out = []
    for name, extra in (("plain", []), ("more", [f"'{c}' AS {c}" for c in CLASHES])):
        docs.selectExpr("*", *extra).write.parquet(f"file://{top}/{name}/documents.parquet")
        items.selectExpr("*", *extra).write.parquet(f"file://{top}/{name}/benchmark.parquet")
        out.append(f"file://{top}/{name}")
    return out


@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] not in ("op1", "op2", "op3", "op9", "op12")])
def test_other_columns_change_nothing(spark, folders, name):
    plain, more = [sorted((tuple(r) for r in QUERIES[name](spark, f).collect()), key=str) for f in folders]
    assert plain == more and len(plain) == 70


@pytest.mark.parametrize("name", ["op3_flow_mix", "op9_slot_shards"])
def test_other_columns_are_no_error(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).count() == 70
