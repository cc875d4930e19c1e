"""Exact top pairs against counting every pair, with narrow and wide groups."""

import random
from collections import Counter
from itertools import combinations

import pytest

from fogon.operators.cooccurrence import top_pairs


def brute(rows, k):
    groups = {}
    for g, i in rows:
        groups.setdefault(g, set()).add(i)
    counts = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return [(a, b, n) for (a, b), n in ranked[:k]]


def run(spark, rows, k, wide, fold=False):
    df = spark.createDataFrame(rows, "g int, i int")
    return [tuple(r) for r in top_pairs(df, "g", "i", k, wide, fold).collect()]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("fold", [False, True])
def test_random_baskets_without_wide_groups(spark, seed, fold):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), rng.randrange(12)) for _ in range(250)]
    assert run(spark, rows, 5, 100, fold) == brute(rows, 5)


@pytest.mark.parametrize("seed", range(6))
def test_random_baskets_with_wide_groups(spark, seed):
    rng = random.Random(100 + seed)
    rows = [(rng.randrange(12), rng.randrange(15)) for _ in range(110)]
    assert run(spark, rows, 5, 4) == brute(rows, 5)


def test_one_basket_holds_most_rows(spark):
    rows = [(0, i) for i in range(400)] + [(g, g % 7) for g in range(1, 60)]
    rows += [(g, (g * 3) % 11) for g in range(1, 60)]
    assert run(spark, rows, 5, 10) == brute(rows, 5)


def test_every_basket_wide_and_every_pair_met_once(spark):
    rows = [(0, i) for i in range(9)] + [(1, i) for i in range(20, 31)]
    assert run(spark, rows, 5, 3) == brute(rows, 5)


def test_wide_groups_only_decide_the_order(spark):
    rows = [(g, i) for g in range(3) for i in range(g, 14)] + [(9, 1), (9, 2), (10, 3), (10, 4)]
    assert run(spark, rows, 5, 5) == brute(rows, 5)


def test_fewer_pairs_than_asked_for(spark):
    rows = [(0, 1), (0, 2), (1, 5)]
    assert run(spark, rows, 5, 100) == [(1, 2, 1)]
    assert run(spark, [(0, 1), (1, 2)], 5, 100) == []


@pytest.mark.parametrize("k", [1, 5, 400])
def test_many_wide_baskets_that_share_items(spark, k):
    # Every item lies in two of twenty wide baskets, one item in all of them.
    rng = random.Random(8)
    rows = [(g, i) for i in range(600) for g in rng.sample(range(20), 2)] + [(g, 1000) for g in range(20)]
    rows += [(100 + i % 40, i) for i in range(0, 600, 7)]
    assert run(spark, rows, k, 10) == brute(rows, k)


def test_wide_baskets_write_no_pairs(spark, monkeypatch):
    # 20 baskets of 300 items hold 448,500 pairs; only each block pair's best leave a task.
    from fogon.operators import cooccurrence

    rows = [(g, (g * 150 + i) % 3000) for g in range(20) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int")
    seen = []
    monkeypatch.setattr(cooccurrence, "BLOCK", 512)
    monkeypatch.setattr(
        cooccurrence, "_ranked", lambda pairs, k, ranked=cooccurrence._ranked: (seen.append(pairs.count()), ranked(pairs, k))[1]
    )
    got = [tuple(r) for r in top_pairs(df, "g", "i", 5, 64).collect()]
    assert got == brute(rows, 5)
    assert max(seen) <= 21 * 5


def test_blocks_are_counted_apart(spark, monkeypatch):
    from fogon.operators import cooccurrence

    monkeypatch.setattr(cooccurrence, "BLOCK", 7)
    monkeypatch.setattr(cooccurrence, "GROUPS_AT_ONCE", 3)
    rng = random.Random(4)
    rows = [(rng.randrange(14), rng.randrange(40)) for _ in range(260)]
    assert run(spark, rows, 9, 5) == brute(rows, 9)
