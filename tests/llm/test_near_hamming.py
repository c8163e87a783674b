import itertools

import numpy as np
import pytest

from fojas.llm import near_hamming as N
from tests.llm.helpers import DOCS, awkward, edited, near_components, prose


@pytest.fixture(scope="module")
def rows():
    out = awkward(9000)
    for g in range(12):
        base = prose(50 + g, 60 + 20 * g)
        out += [(100 * g + j + 1, edited(base, share, 1000 * g + j), "en", "s", 1) for j, share in enumerate([0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2])]
    out += [(5000 + i, prose(999, 50) + " " + prose(2000 + i, 60), "en", "s", 1) for i in range(40)]  # one passage in all
    out += [(6000 + i, edited(prose(77, 300), 0.02, i), "en", "s", 1) for i in range(60)]  # a group of near copies
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_all_pairs(spark, rows, k):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "2 AS component", "3 AS rep", "4 AS key")
    got = N.near_duplicates(docs, k=k).collect()
    assert len(got) == len(rows)
    want = near_components([(r[0], r[1]) for r in rows], k, 80)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_every_pair_under_the_threshold_shares_a_key():
    r = np.random.default_rng(0)
    masks = N.index_masks()
    for errors in (0, 5, 20, N.MAX_ERRORS):
        for _ in range(50):
            a = r.integers(0, 256, N.POSITIONS, dtype=np.uint8)
            b = a.copy()
            for p in r.choice(N.POSITIONS, errors, replace=False):
                b[p] ^= r.integers(1, 256)
            keys = N.signature_keys(np.stack((a, b)), masks)
            assert (keys[0] == keys[1]).any()


def test_masks_leave_out_the_allowed_errors():
    masks = N.index_masks(12, 3, 7)
    assert len(masks) == 3 * len(list(itertools.combinations(range(4), 2)))


def test_blocks_and_deals_change_nothing(spark, rows, monkeypatch):
    """Many members of a bucket that hardly link: held in blocks of three, passing in fives."""
    more = rows + [(7000 + i, edited(prose(78, 200), 0.04, i), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(more, DOCS)
    want = near_components([(r[0], r[1]) for r in more], 5, 80)
    seen = []
    dealt = N._dealt
    monkeypatch.setattr(N, "_dealt", lambda r: seen.append(dealt(r).cache()) or seen[-1])
    monkeypatch.setattr(N, "HELD", 3)
    monkeypatch.setattr(N, "PASSING", 5)
    monkeypatch.setattr(N, "STRETCH", 7)
    got = {r.id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect() if r.id is not None}
    assert got == want
    most = seen[0].agg({"block": "max", "deal": "max"}).first()
    assert most[0] > 1 and most[1] > 1


def test_each_pair_of_a_bucket_meets_once(spark, monkeypatch):
    monkeypatch.setattr(N, "HELD", 4)
    monkeypatch.setattr(N, "PASSING", 6)
    rows = [(1, i, i >= 9, 21, 30) for i in range(30)]  # nine in the largest component
    dealt = N._dealt(spark.createDataFrame(rows, "key long, rep long, outside boolean, n_outside long, n_members long")).collect()
    met = []
    for task in {(r.block, r.deal) for r in dealt}:
        own = [r for r in dealt if (r.block, r.deal) == task]
        held, passing = [r.rep for r in own if r.held], [r.rep for r in own if not r.held]
        met += [tuple(sorted(p)) for p in itertools.product(held, passing)]
        met += [tuple(sorted(p)) for p in itertools.combinations(held, 2)] if task[1] == 0 else []
    assert sorted(met) == [p for p in itertools.combinations(range(30), 2) if p[1] >= 9]
