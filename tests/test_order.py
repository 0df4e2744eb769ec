"""Ranks and running sums over range partitions against one sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from netmine.operators.order import numbered, running


@pytest.mark.parametrize("partitions, spread", [(1, False), (5, False), (16, True)])
def test_ranks_and_sums_with_ties(spark, partitions, spread):
    rng = random.Random(partitions)
    rows = [(i, rng.choice([1, 1, 1, 2, 9, None]), rng.randint(-5, 10**12)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, k int, v long").repartition(3)
    got = numbered(table, [F.col("k").desc_nulls_last()], "no", "total", partitions, spread).collect()
    assert sorted(r.no for r in got) == list(range(300)) and {r.total for r in got} == {300}
    by_no = sorted(got, key=lambda r: r.no)
    keys = [-1 if r.k is None else r.k for r in by_no]
    assert keys == sorted(keys, reverse=True)
    sums = {r.id: int(r.before) for r in running(table, [F.col("k").asc_nulls_first(), F.col("id")], {"before": "v"}, partitions, spread).collect()}
    held, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        want[i] = held
        held += v
    assert sums == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "k int, v long")
    assert numbered(none, [F.col("k")], "no", "total").count() == 0 and running(none, [F.col("k")], {"s": "v"}).count() == 0
