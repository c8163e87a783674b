import random


from fojas.llm import mix_flow as M

ROWS = "id long, size long, sources array<string>, p_ string, copies long"


def test_route_fills_overlapping_sources():
    # the pattern of both sources must leave the first to the pattern that has nothing else
    flow = M.route([10, 10], [[0, 1], [0]], [10, 10], 1)
    assert flow == [{0: 0, 1: 10}, {0: 10}]


def test_route_repeats_only_where_fresh_words_are_short():
    flow = M.route([10, 10], [[0], [1]], [15, 5], 2)
    assert flow == [{0: 15}, {1: 5}]
    assert M.route([0, 5], [[0], []], [7, 1], 3) == [{0: 0}, {}]


def brute_targets(sizes, weights, share, most):
    """Passes over the excess, as the rule is told."""
    out, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            out[s] += left * weights[s] / total
        left = sum(max(0.0, out[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if out[s] >= most * sizes[s] - 1e-12:
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def test_targets_stop_at_twice_the_source():
    r = random.Random(4)
    for _ in range(30):
        sizes = {f"s{i}": r.randint(0, 1000) for i in range(r.randint(1, 8))}
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
        got, want = M.quotas_by_weight(sizes, weights, 1.5, 2.0), brute_targets(sizes, weights, 1.5, 2.0)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_mix_meets_quotas_and_agrees_between_runs(spark):
    r = random.Random(5)
    rows = [(i, int(r.paretovariate(1.2) * 20), r.choice([["a"], ["b"], ["a", "b"], ["c"], [None]]), "x", 9) for i in range(3000)]
    rows += [(7, 50, ["a"], "x", 1), (7, 50, ["a"], "x", 1), (None, 5, ["b"], None, 0), (5001, None, ["a"], None, 0), (5002, -4, ["a"], None, 0), (5003, 10, None, None, 0), (5004, 10, [], None, 0)]
    docs = spark.createDataFrame(rows, ROWS)
    quotas = {"a": 20000.0, "b": 30000.0, "c": 10000.0, None: 500.0}
    out = M.mix(docs, quotas).collect()
    assert len(out) == len(rows)
    assert all(x.taken <= 2 * max(0, x.size or 0) and x.taken == x.copies * max(0, x.size or 0) for x in out)
    taken = {}
    for x in out:
        taken[tuple(sorted(map(str, x.sources or [])))] = taken.get(tuple(sorted(map(str, x.sources or []))), 0) + x.taken
    sizes = {}
    for x in rows:
        sizes[tuple(sorted(map(str, x[2] or [])))] = sizes.get(tuple(sorted(map(str, x[2] or []))), 0) + max(0, x[1] or 0)
    assert abs(taken[("c",)] - min(10000, 2 * sizes[("c",)])) <= 0.01 * 10000
    assert abs(taken[("None",)] - 500) <= 25
    both = taken[("a",)] + taken[("b",)] + taken[("a", "b")]
    assert abs(both - min(50000, 2 * (sizes[("a",)] + sizes[("b",)] + sizes[("a", "b")]))) <= 0.02 * 50000
    again = M.mix(docs.repartition(5), quotas).collect()
    assert sorted((str(x.id), x.copies) for x in out) == sorted((str(x.id), x.copies) for x in again)


def test_empty_table_and_no_quota(spark):
    none = spark.createDataFrame([], ROWS)
    assert M.mix(none, {"a": 5.0}).collect() == []
    one = spark.createDataFrame([(1, 10, ["a"], "", 3)], ROWS)
    assert [x.taken for x in M.mix(one, {}).collect()] == [0]
    assert [x.taken for x in M.mix(one, {"a": 100.0}).collect()] == [20]


def test_word_count(spark):
    got = spark.createDataFrame([("a b\tc d",), ("",), (None,), ("  ",)], "t string").select(M.word_count("t")).collect()
    assert [r[0] for r in got] == [3, 0, 0, 0]


def test_source_targets_order_null_last(spark):
    rows = spark.createDataFrame([(None, 100), ("b", 100), ("B", 100), ("a", 100)], "source string, size long")
    got = M.source_targets(rows)
    assert list(got) == ["B", "a", "b", None]
    assert [round(t, 6) for _, t in got.values()] == [200.0, 66.666667, 133.333333, 200.0] or abs(sum(t for _, t in got.values()) - 600) < 1e-6


def test_long_documents_are_passed_over(spark):
    rows = [(1000 * s + i, 30_000 if i == 350 else 200, [f"s{s}"], "", 0) for s in range(12) for i in range(351)]
    # the rows of one id are taken together, and so passed over together
    rows += [(100_000 + i, 100, ["twin"], "", 0) for i in range(200)] + [(200_000, 100, ["twin"], "", 0)] * 60
    out = M.mix(spark.createDataFrame(rows, ROWS), {**{f"s{s}": 35_000.0 + s * 3_000 for s in range(12)}, "twin": 19_000.0}).collect()
    taken = {}
    for x in out:
        taken[x.sources[0]] = taken.get(x.sources[0], 0) + x.taken
    assert all(abs(taken[f"s{s}"] - 35_000 - s * 3_000) <= 100 for s in range(12))
    assert abs(taken["twin"] - 19_000) <= 50 and len({x.copies for x in out if x.id == 200_000}) == 1
