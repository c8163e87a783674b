import re

import numpy as np

from fojas.llm import line_hash as L
from tests.llm.helpers import DOCS, awkward, prose

BLANK = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in BLANK.sub("", line))


def brute(rows, shortest=10):
    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < shortest or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = awkward()
    for i in range(150):
        text = [prose(i, 6), "Subscribe to our NEWSLETTER", f"  {prose(i // 3, 5)}\t", "short", "", prose(i // 50, 4).upper(), "éàü ñandú ôß", "éàü ñandú ôß"]
        rows.append((i, "\n".join(text[i % 3 :]), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS line", "2 AS shard", "3 AS h1", "4 AS lines")
    got = sorted((tuple(r) for r in L.dedupe_lines(docs).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_a_line_of_every_document_goes_through_the_arrays(spark):
    rows = [(i, "\n".join([prose(i, 4), "the one line of all", prose(i % 40, 4), "a third line" if i % 3 else prose(i, 5), "the one line of all"]), "en", "s", 1) for i in range(1500)]
    got = sorted((tuple(r) for r in L.dedupe_lines(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_nothing_repeats_and_empty_table(spark):
    assert L.dedupe_lines(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(i, prose(i, 9), None, None, 0) for i in range(5)]
    assert all(r.n_dropped == 0 for r in L.dedupe_lines(spark.createDataFrame(rows, DOCS)).collect())


def test_perfect_hash_is_minimal_and_survives_storage():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        h1, h2 = r.integers(0, 2**63, (2, n), dtype=np.uint64)
        shard = L.Shard.from_bytes(L.Shard.of(h1, h2, np.arange(n), np.arange(n) + 7).to_bytes())
        if n:
            slots = shard.index.slots(L.mix(h1 ^ L.mix(h2)))
            assert sorted(slots.tolist()) == list(range(n))
        known, counts, firsts = shard.probe(h1, h2)
        assert known.all() and (counts == np.arange(n)).all() and (firsts == np.arange(n) + 7).all()
        others = r.integers(0, 2**63, (2, 1000), dtype=np.uint64)
        assert not shard.probe(*others)[0].any()


def test_keys_that_never_part_are_listed():
    keys = np.arange(5, dtype=np.uint64)
    index = L.PerfectHash([], np.sort(keys))
    assert index.slots(keys).tolist() == [0, 1, 2, 3, 4]
    assert index.slots(np.array([99], np.uint64)).tolist() == [-1]
