"""Ranges against ranges, compared with trying all pairs."""

import random

import pytest

from fojas.operators import retrieval as R
from fojas.operators.overlaps import overlapping


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    r = random.Random(seed)

    def ranges(n, widest):
        out = []
        for i in range(n):
            a = r.randint(0, 3000)
            out.append((i, r.choice("xyz"), a, a + r.choice([0, 0, r.randint(0, 40), r.randint(0, widest), -1])))
        return out + [(900, None, 1, 5), (901, "x", None, 5), (902, "x", -4, 5), (903, "only" + str(n), 0, 9), (904, "y", 3, None)]

    left, right = ranges(120, 2**40), ranges(80, 2000)
    pairs = overlapping(
        spark.createDataFrame(left, "l INT, k STRING, a BIGINT, b BIGINT"), spark.createDataFrame(right, "r INT, k STRING, c BIGINT, d BIGINT"), ["k"], ("a", "b"), ("c", "d")
    )
    usable = lambda x: x[1] is not None and x[2] is not None and x[3] is not None and 0 <= x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if usable(x) and usable(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((p.l, p.r) for p in pairs.collect()) == want
    assert pairs.columns == ["k", "l", "a", "b", "r", "c", "d"]


def test_a_billion_pages(spark):
    huge = 10**9
    events = [("q", "5", 1, "tool_call", "get_page_content", '{"pages": "3-99999999999999999999999999999999999999999999, 7"}'), ("p", "5", 2, "tool_call", "get_page_content", '{"pages": "999999999"}')]
    events = spark.createDataFrame(events, "question_id STRING, part STRING, seq INT, type STRING, name STRING, arguments STRING")
    parts = spark.createDataFrame([("5", "h", huge)], "part STRING, content_hash STRING, page_count INT")
    read = R.ranges_read(events, parts)
    assert sorted((r.question_id, r.from_page, r.to_page) for r in read.collect()) == [("p", huge - 1, huge - 1), ("q", 3, huge), ("q", 7, 7)]
    nodes = [("h", "0", 0, 1, huge, False), ("h", "1", 1, 1, 2, True), ("h", "2", 2, 3, huge - 2, True), ("h", "3", 3, huge - 1, huge, True)]
    nodes = spark.createDataFrame(nodes, "content_hash STRING, node_id STRING, preorder INT, start_index INT, end_index INT, is_leaf BOOLEAN")
    assert sorted((r.question_id, r.node) for r in R.visited_nodes(read, nodes).collect()) == [("p", "5:3"), ("q", "5:2"), ("q", "5:3")]
    sections = spark.createDataFrame([("h", "5.1", 0, 1), ("h", "5.2", 1, 500_000_000), ("h", "5.3", 2, huge)], "content_hash STRING, section STRING, section_ord INT, pdf_page_start INT")
    assert {r.node_id: r.sections for r in R.node_sections(nodes, sections).collect()} == {"0": ["5.1", "5.2", "5.3"], "1": ["5.1"], "2": ["5.2"], "3": ["5.3"]}
