import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fojas.llm import merkle_manifest as M
from tests.llm.helpers import DOCS, awkward, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*[value(v) for v in (doc_id, source, lang, n_chars, text)])


def climb(digests, fanout):
    """The root of a list of digests, and for each of them what stands left and right of it, level by level."""
    paths, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for j, p in enumerate(place):
            first = p - p % fanout
            paths[j].append(("".join(level[first:p]), "".join(level[p + 1 : first + fanout])))
            place[j] = p // fanout
        level = [sha(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf_of(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in order}
    root, tops = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops):
        for (_, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1]):
            h = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                h = leaf_of(*r[:4], r[4] + 1)
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((r[0], leaf, trees[g][0], root, sha(*[x + y for x, y in path + top]), h, h == root))
    return sorted(out, key=str)


def got(spark, rows, fanout, tampered):
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("id", "doc_id").selectExpr("*", "1 AS g", "2 AS i", "3 AS n", "'x' AS h", "4 AS id", "5 AS path", "6 AS root", "7 AS left")
    return sorted((tuple(r) for r in M.verified(docs, tampered, fanout).collect()), key=str)


def seventh():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_equals_brute_force(spark, fanout):
    rows = awkward() + [(i, prose(i, 3 + i % 9), ["en", "de", None, "", "é", "en"][i % 6], f"s{i % 4}", i) for i in range(90)]
    rows += [(7, prose(i, 4), "en", None, None) for i in range(5)] + [(8, "same", "en", "s", 2**63 - 1)] * 6 + [(500, "alone", "zz", None, 1)]
    assert got(spark, rows, fanout, seventh()) == brute(rows, fanout)


@pytest.mark.parametrize("n", [1, 9])
def test_one_group_of_few(spark, n):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
    assert got(spark, rows, 2, seventh()) == brute(rows, 2)


def test_any_change_is_seen(spark):
    rows = [(i, prose(i, 5), ["en", "fr"][i % 2], "s", i) for i in range(20)]
    found = got(spark, rows[::-1], 2, F.col("doc_id") % 3 == 0)
    assert all(r[-1] == (r[0] % 3 != 0) for r in found) and found[0][3] == brute(rows, 2)[0][3]
    others = [rows[:-1], rows + [(20, "", "en", None, 0)], [(0, "other", "en", "s", 0), *rows[1:]], [(0, rows[0][1], "fr", "s", 0), *rows[1:]]]
    assert len({brute(o, 2)[0][3] for o in others} | {found[0][3]}) == 5


def test_empty_table(spark):
    assert got(spark, [], 2, seventh()) == []


def test_a_run_needs_two(spark):
    with pytest.raises(ValueError):
        M.Tree(spark.createDataFrame([], "g string, i long, n long, h string"), 1)
