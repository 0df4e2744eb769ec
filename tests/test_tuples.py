"""Tuples of outputs, combinations and subsets against itertools."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netmine.operators import grouping, model, search
from netmine.session import saved


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_tuples(spark, k):
    rng = random.Random(k)
    edges = {}
    for g in range(3):
        for a, b in itertools.combinations(range(14), 2):
            if rng.random() < 0.45 or a == 0:  # 0 pairs with all
                edges[g, a, b] = rng.randint(1, 8) / 8
    pair = spark.createDataFrame([(*e, s) for e, s in edges.items()], "grp int, out_a int, out_b int, input_overlap double")
    want = {}
    for g in range(3):
        for t in itertools.combinations(range(14), k):
            if all((g, a, b) in edges for a, b in itertools.combinations(t, 2)):
                want[g, *t] = round(sum(edges[g, a, b] for a, b in itertools.combinations(t, 2)) / (k * (k - 1) // 2), 6)
    got = {tuple(r)[:-1]: r.mean_overlap for r in grouping.tuples(pair, k, saved).collect()}
    assert got == want and (want or k == 5)
    assert grouping.tuples(pair.limit(0), k, saved).count() == 0


def test_a_star_extends_to_nothing(spark):
    """One output that pairs with 500 others, which pair with none: no chain of two pairs is made."""
    pair = spark.createDataFrame([(0, 0, i, 1.0) for i in range(1, 501)], "grp int, out_a int, out_b int, input_overlap double")
    assert grouping.tuples(pair, 3, saved).count() == 0 and grouping.tuples(pair, 2, saved).count() == 500


@pytest.mark.parametrize("n, k", [(5, 1), (5, 5), (4, 5), (9, 5), (30, 3), (12, 6)])
def test_combinations(spark, n, k):
    items = [f"i{x:02}" for x in range(n)]
    rows = spark.createDataFrame([(x,) for x in items + items[:2] + [None]], "t string")
    got = [tuple(r) for r in search.combinations(rows, "t", k).collect()]
    assert sorted(got) == list(itertools.combinations(items, k))


def test_large_numbers_are_unranked_right(spark):
    import math

    for n, k in ((100_000, 3), (60, 12), (2_000_000, 2)):
        top = math.comb(n, k) - 1
        rows = spark.createDataFrame([(top,), (top // 2,), (0,)], "number long")
        for r in search._unranked(rows, k).collect():
            places = [r[f"p{i}"] for i in range(1, k + 1)]
            assert sorted(set(places)) == places and sum(math.comb(p, i) for i, p in enumerate(places, 1)) == r.number
            assert r.number < top or places == list(range(n - k, n))
    with pytest.raises(ValueError):
        search._numbers(spark, 1 << 60)


def test_subsets_of_more_than_ten_keys(spark):
    keys = [f"0b{i:04b}" for i in range(12)]
    cells = spark.createDataFrame([(f"C{k}_X{d}", k) for k in keys for d in (1, 2)], "name string, p_key string")
    mined = spark.createDataFrame([(k,) for k in keys], "p_key string")
    got = {(tuple(r["keys"]), tuple(r["cells"])) for r in search.subsets(cells, mined, [], most=12).collect()}
    want = set()
    for n in range(1, 13):
        for t in itertools.combinations(keys, n):
            want |= {(t, tuple(sorted(f"C{k}_X1" for k in t))), (t, tuple(sorted(f"C{k}_X{d}" for k in t for d in (1, 2))))}
    assert got == want
    drawn = search.subsets(cells, mined, []).collect()
    sizes = [len(r["keys"]) for r in drawn]
    assert sizes.count(1) == 24 and len({tuple(r["keys"]) for r in drawn}) == 12 + search.DRAWN
    assert search.subsets(cells.limit(0), mined, []).count() == 0


def test_ranked_scores_over_borders(spark):
    rows = [(f"c{i:03}", float(i % 7)) for i in range(100)]
    ranked = model.ranked_scores(spark.createDataFrame(rows, "combo string, gain double"), "gain")
    assert {r.combo: r["rank"] for r in ranked.collect()} == {c: i for i, (c, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert "Window" not in ranked._jdf.queryExecution().toString()
