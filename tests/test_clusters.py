"""Relations between clusters against loops over all pairs; hot cells, copies, long chains."""

import random

import pytest
from pyspark.sql import functions as F

from netmine.operators import clusters
from netmine.session import saved


def drawn(rng, n, cells):
    """Clusters with cells, some of which most clusters have, and copies."""
    sets = {i: {rng.choice([0, 1, 2]) if rng.random() < 0.4 else rng.randint(3, cells) for _ in range(rng.randint(1, 5))} for i in range(n)}
    return sets | {n + i: set(sets[i]) for i in range(0, n, 9)} | {2 * n + 1: {0}, 2 * n + 2: {-1}}


def rows(spark, sets):
    return spark.createDataFrame([(c, x) for c, xs in sets.items() for x in xs], "cluster long, cell long")


@pytest.mark.parametrize("hot", [3, 20, 10_000])
def test_neighbour_counts(spark, hot):
    rng = random.Random(hot)
    sets = drawn(rng, 120, 60)
    keys = {c: f"k{c % 4}" for c in sets}
    key = spark.createDataFrame(list(keys.items()), "cluster long, p_key string")
    near = {c: [d for d in sets if d != c and sets[c] & sets[d]] for c in sets}
    got = {r.cluster: r.n for r in clusters.neighbour_counts(rows(spark, sets), saved, hot=hot).collect()}
    assert got == {c: len(x) for c, x in near.items() if x}
    asked = key.where("p_key = 'k1'")
    by_key = {(r.cluster, r.p_key): r.n for r in clusters.neighbour_counts(rows(spark, sets), saved, key, asked, hot).collect()}
    want = {(c, k): n for c in sets if keys[c] == "k1" for k in set(keys.values()) if (n := sum(keys[d] == k for d in near[c]))}
    assert by_key == want


def test_overlap_ratio_and_pairs(spark):
    sets = drawn(random.Random(2), 60, 30)
    keys = {c: f"k{c % 3}" for c in sets}
    key = spark.createDataFrame(list(keys.items()), "cluster long, p_key string")
    near = {c: {keys[d] for d in sets if d != c and sets[c] & sets[d]} for c in sets}
    want = {}
    for a in set(keys.values()):
        own = [c for c in sets if keys[c] == a]
        for b in set(keys.values()) - {a}:
            if n := sum(b in near[c] for c in own):
                want[a, b] = round(n / len(own), 6)
    assert {(r.key_a, r.key_b): r.overlap_ratio for r in clusters.overlap_ratio(rows(spark, sets), key).collect()} == want
    pairs = {(r.a, r.b): r.shared for r in clusters.overlap_pairs(rows(spark, sets), saved, block=4).collect()}
    assert pairs == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_containment(spark):
    sets = drawn(random.Random(7), 90, 25)
    got = sorted((r["sub"], r["sup"]) for r in clusters.contained(rows(spark, sets), saved).collect())
    assert got == sorted((a, b) for a in sets for b in sets if sets[a] < sets[b]) and len(got) > 50
    assert clusters.contained(rows(spark, {1: {2}}).limit(0), saved).count() == 0


def test_containment_of_a_hot_cell_makes_no_pairs(spark):
    """600 sets with one cell in common and one of their own, and copies of the common one: each is probed under its own cell."""
    sets = [(i, [0, i + 1], 2) for i in range(600)] + [(1000, [0], 1)]
    table = spark.createDataFrame(sets, "id long, cells array<long>, size int")
    assert clusters.containment_candidates(table).count() == 600
    members = {i: {0, i + 1} for i in range(600)} | {1000 + i: {0} for i in range(3)}
    assert clusters.contained(rows(spark, members), saved).count() == 1800


@pytest.mark.parametrize("one_task", [0, 50, 1 << 20])
def test_components_of_chains(spark, one_task):
    """A chain through all ids in no order, a star, single clusters; written rounds replace each other."""
    rng = random.Random(one_task)
    order = rng.sample(range(400), 400)
    member = [(c, k) for k in range(399) for c in order[k : k + 2]] + [(1000 + i, 5000) for i in range(50)] + [(2000, 6000)]
    calls = []

    def counted(df, instead=None):
        calls.append(instead is not None)
        return saved(df, instead)

    got = {r.cluster: r.component for r in clusters.components(spark.createDataFrame(member, "cluster long, cell long").repartition(7), counted, one_task).collect()}
    assert got == {c: 0 for c in range(400)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000}
    assert all(calls[1:]) and len(calls) < 40
    empty = spark.createDataFrame([], "cluster long, cell long")
    assert clusters.components(empty, saved, one_task).count() == 0


def test_positions_over_partition_borders(spark):
    counts = [(f"k{i:03}", i % 5) for i in range(200)]
    got = {r.key: (r.rank_no, r.rank_norm) for r in clusters.positions(spark.createDataFrame(counts, "key string, cnt int"), "cnt", "key").collect()}
    want = sorted(counts, key=lambda r: (-r[1], r[0]))
    assert got == {k: (i, round(i / 199, 6)) for i, (k, _) in enumerate(want)}
    plan = clusters.positions(spark.createDataFrame(counts, "key string, cnt int"), "cnt", "key")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_overlap_ratio_passes_no_lists_on(spark):
    """Rows of fixed width are shuffled, with more keys than one long has bits."""
    sets = {c: {c % 11, 11 + c % 7} for c in range(300)}
    keys = {c: f"k{c % 150}" for c in sets}
    got = clusters.overlap_ratio(rows(spark, sets), spark.createDataFrame(list(keys.items()), "cluster long, p_key string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "array_distinct" not in plan
    near = {c: {keys[d] for d in sets if sets[c] & sets[d]} for c in sets}
    own = {k: [c for c in sets if keys[c] == k] for k in set(keys.values())}
    want = {(a, b): round(n / len(own[a]), 6) for a in own for b in own if a != b and (n := sum(b in near[c] for c in own[a]))}
    assert {(r.key_a, r.key_b): r.overlap_ratio for r in got.collect()} == want and len(want) > 1000


@pytest.mark.parametrize("block", [4, 10_000])
def test_pairs_with_sizes(spark, block):
    sets = drawn(random.Random(4), 60, 30)
    pairs = clusters.overlap_pairs(clusters.sized(rows(spark, sets)), saved, block)
    got = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in pairs.collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_partitions_follow_the_members(spark, monkeypatch):
    """What one task counts does not grow with the input."""
    monkeypatch.setattr(clusters, "COUNTED", 50)
    sets = {c: {c % 7, 7 + c % 5} for c in range(500)}
    master = spark.createDataFrame([(x, x, f"m{x % 3}") for x in range(12)], "cell long, area int, master string")
    key = spark.createDataFrame([(c, "k") for c in sets], "cluster long, p_key string")
    got = clusters.attributes(rows(spark, sets), master)
    assert got.rdd.getNumPartitions() >= 20
    assert {r.cluster: (r.n_cells, r.total_area, r.n_masters, r.max_area) for r in got.collect()} == {c: (2, sum(x), len({y % 3 for y in x}), max(x)) for c, x in sets.items()}
    share = {(r.p_key, r.master): r.m1 for r in clusters.presence(rows(spark, sets), key, master.select("cell", "master")).collect()}
    assert share == {("k", f"m{i}"): round(sum(any(y % 3 == i for y in x) for x in sets.values()) / 500, 6) for i in range(3)}


def test_narrow_clusters_count_each_other_without_lists(spark, monkeypatch):
    """Clusters that share one cell, two cells, and two cells with more than NARROW others; a wide one among them."""
    monkeypatch.setattr(clusters, "NARROW", 4)
    sets = {1: [1, 2, 3], 2: [1, 2, 3], 3: [3, 4], 4: [5, 6], 5: [6], 6: list(range(1, 7)), 7: [99], **{10 + i: [7, 8, 9 + i] for i in range(6)}, 20: [7, 8, 3], 21: [9]}
    member = rows(spark, sets)
    want = {a: sum(1 for b in sets if b != a and set(sets[a]) & set(sets[b])) for a in sets}
    assert {r.cluster: r.n for r in clusters.neighbour_counts(member, saved).collect()} == {a: n for a, n in want.items() if n}
    twice = clusters._met_twice(member.groupBy("cluster").agg(F.collect_list("cell").alias("light")).withColumn("heavy", F.array().cast("array<long>")), [])
    assert sorted(sorted(r.clusters) for r in twice.collect()) == [[1, 2]] * 3 + [[10, 11, 12, 13, 14, 15, 20]]


def test_components_deal_members_out_once(spark, monkeypatch):
    """Repeated members are no harm, and edges come from one exchange of the members."""
    member = rows(spark, {1: [1], 2: [1, 1, 2], 3: [2], 9: [5], 8: [5], 7: [6]})
    plans, labels = [], clusters._labels
    monkeypatch.setattr(clusters, "_labels", lambda edges, *more: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or labels(edges, *more))
    assert {r.cluster: r.component for r in clusters.components(member, saved).collect()} == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8, 7: 7}
    assert plans[0].count("Exchange hashpartitioning") == 1
