"""Pattern mining over clusters: frequency, roll-up, rank, overlap, containment, coverage.

A cluster table has `cluster` and `cell`; members are a set, so repeats are
dropped where they would count.  Pairs of clusters are made only where pairs are asked
for; counts of neighbours, ratios and containment come from cells and sets of cells.
A cell of more than HOT clusters is never joined with itself as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netmine.operators.order import numbered

#: Clusters of a cell beyond which it is hot: its clusters are counted by their hot cells, and pairs are made in blocks of so many.
HOT = 2048
#: Cells of a narrow cluster, and how many narrow clusters may have the same two cells: their neighbours are counted without lists.
NARROW = 16
#: Members that one task counts, or makes pairs of.
COUNTED = 1 << 17
#: Edges that one task joins into components without another round.
ONE_TASK = 1 << 20


def members(rows: DataFrame, cluster: str, cell: str) -> DataFrame:
    return rows.select(F.col(cluster).alias("cluster"), F.col(cell).alias("cell")).distinct()


def tasks(member: DataFrame) -> int:
    """Partitions in which a task counts about COUNTED members, so that its memory does not grow with them."""
    return max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-member.count() // COUNTED))


def frequency(keyed: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """p_key, count and label; the label is the smallest (area, name) master of that key, else New."""
    counts = keyed.groupBy("p_key").agg(F.count("*").alias("cnt"))
    if library is None:
        return counts
    best = library.groupBy("p_key").agg(F.min(F.struct("area", "name")).alias("m")).select("p_key", F.col("m.name").alias("master"))
    return counts.join(best, "p_key", "left").select("p_key", "cnt", F.coalesce("master", F.lit("New")).alias("label"))


def least_cost(relation: DataFrame) -> DataFrame:
    """For each p_key the representatives with the fewest erased inverters, ties kept; one split for each pair."""
    cheapest = relation.select("p_key", "np_key", "ei", "eo", F.min(F.col("ei") + F.col("eo")).over(Window.partitionBy("p_key")).alias("least"))
    split = cheapest.where("ei + eo = least").groupBy("p_key", "np_key").agg(F.min(F.struct("ei", "eo")).alias("s"))
    return split.select("p_key", "np_key", "s.ei", "s.eo")


def roll_up(counts: DataFrame, relation: DataFrame) -> DataFrame:
    """Every p_key adds its count to each of its representatives; without one it stands for itself."""
    joined = counts.join(least_cost(relation), "p_key", "left")
    return joined.groupBy(F.coalesce("np_key", "p_key").alias("np_key")).agg(F.sum("cnt").alias("cnt"))


def positions(rows: DataFrame, count: str, key: str) -> DataFrame:
    """rank_no from 0 by count descending and key, rank_norm = rank_no / (N - 1), 0 if N is 1."""
    ranked = numbered(rows, [F.col(count).desc(), F.col(key).asc()], total="__n")
    return ranked.withColumn("rank_norm", F.when(F.col("__n") > 1, F.round(F.col("rank_no") / (F.col("__n") - 1), 6)).otherwise(F.lit(0.0))).drop("__n")


def grouped_roll_up(counts: DataFrame, relation: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups by library label where a representative has one, else by its key; a p_key counts once in a group."""
    joined = counts.join(relation.select("p_key", "np_key"), "p_key").join(labels.withColumnRenamed("p_key", "np_key"), "np_key", "left")
    one = joined.select("p_key", "cnt", "np_key", F.coalesce("label", "np_key").alias("grp")).groupBy("p_key", "cnt", "grp").agg(F.min("np_key").alias("np_key"))
    return one.groupBy("grp").agg(F.min("np_key").alias("np_key"), F.sum("cnt").alias("cnt"), F.count("*").alias("n_classes"))


def sized(member: DataFrame) -> DataFrame:
    """The members with the number of cells that their cluster has."""
    return member.withColumn("size", F.count("*").over(Window.partitionBy("cluster")).cast("int"))


def overlap_pairs(member: DataFrame, saved: Callable, block: int = HOT) -> DataFrame:
    """a < b and the number of cells they share; of sized members also size_a and size_b, so that no pair is joined with anything.

    A member takes the greater clusters of its cell along as one array, and pairs are made and counted where all arrays
    of a cluster have met.  The clusters of a hot cell, one with more than `block` clusters, are dealt into blocks, each
    of which meets the whole cell, so a hot cell is as many tasks as it has blocks.
    """
    sizes = ["size"] if "size" in member.columns else []
    hot = saved(member.groupBy("cell").agg(F.count("*").alias("k")).where(F.col("k") > block).select("cell", F.ceil(F.col("k") / block).cast("int").alias("n")))
    dealt = member.join(hot, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    posted = dealt.select("cell", F.pmod(F.xxhash64("cluster"), "n").cast("int").alias("block"), F.struct("cluster", *sizes).alias("x"))
    posted = posted.groupBy("cell", "block").agg(F.array_sort(F.collect_list("x")).alias("every"))
    own = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("cluster").alias("a"), *[F.col(c).alias(f"{c}_a") for c in sizes])
    met = own.join(posted, ["cell", "block"]).withColumn("b", F.filter("every", lambda x: x["cluster"] > F.col("a"))).where(F.size("b") > 0)
    packed = met.select("a", *[f"{c}_a" for c in sizes], F.col("b.cluster").alias("b"), *[F.col(f"b.{c}").alias(f"{c}_b") for c in sizes])
    packed = packed.repartition(tasks(member), "a")  # by number of members, as the arrays are small beside the pairs made of them
    each = packed.select("a", *[f"{c}_a" for c in sizes], F.inline(F.arrays_zip("b", *[f"{c}_b" for c in sizes])))
    return each.groupBy("a", "b", *[f"{c}_{side}" for c in sizes for side in ("a", "b")]).agg(F.count("*").alias("shared"))


def jaccard(pairs: DataFrame) -> Column:
    return F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 6)


def containment_candidates(sets: DataFrame) -> DataFrame:
    """sub, sup (numbers of `sets`: id, cells, size) where sup holds the rarest cell of sub, is larger, and has all bits of its mask.

    A set is probed under one cell only, the one that the fewest sets have.
    """
    mask = F.expr("aggregate(cells, 0L, (m, c) -> m | shiftleft(1L, cast(pmod(xxhash64(c), 64) AS int)))")
    marked = sets.select("id", "size", "cells", mask.alias("mask"))
    posted = marked.select("id", "size", "mask", F.explode("cells").alias("cell"))
    spread = posted.groupBy("cell").agg(F.count("*").alias("n"))
    asked = posted.join(spread, "cell").groupBy(F.col("id").alias("sub")).agg(F.min(F.struct("n", "cell")).alias("r"), F.first("size").alias("sub_size"), F.first("mask").alias("sub_mask"))
    met = asked.select("sub", "sub_size", "sub_mask", F.col("r.cell").alias("cell")).join(posted, "cell")
    return met.where("sub_size < size AND sub_mask & ~mask = 0").select("sub", F.col("id").alias("sup"))


def contained(member: DataFrame, saved: Callable) -> DataFrame:
    """Strictly contained clusters: sub, sup.

    Equal sets of cells are one set until the end, so copies cost nothing before they are listed.  Candidates have passed
    a mask of 64 bits; the cells decide.
    """
    listed = member.groupBy("cluster").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    listed = saved(listed)
    sets = saved(listed.groupBy("cells").agg(F.min("cluster").alias("id"), F.count("*").alias("copies")).withColumn("size", F.size("cells")))
    met = saved(containment_candidates(sets))
    of = lambda side: sets.select(F.col("id").alias(side), F.col("cells").alias(f"cells_{side}"))
    held = met.join(of("sub"), "sub").join(of("sup"), "sup").where(F.size(F.array_except("cells_sub", "cells_sup")) == 0).select("sub", "sup")
    copied = sets.where("copies > 1").select("id", "cells").join(listed, "cells").select("id", "cluster")
    every = lambda side: copied.select(F.col("id").alias(side), F.col("cluster").alias(f"c_{side}"))
    named = held.join(every("sub"), "sub", "left").join(every("sup"), "sup", "left")
    return named.select(F.coalesce("c_sub", "sub").alias("sub"), F.coalesce("c_sup", "sup").alias("sup"))


def _met_twice(sets: DataFrame, per: list[str]) -> DataFrame:
    """The lists of clusters without hot cells, of at most NARROW cells, that have the same two cells."""
    narrow = sets.where((F.size("heavy") == 0) & F.size("light").between(2, NARROW)).select("cluster", *per, F.array_sort("light").alias("c"))
    one = narrow.select("cluster", *per, "c", F.posexplode("c").alias("i", "x"))
    two = one.select("cluster", *per, "x", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("y"))
    return two.groupBy("x", "y").agg(F.collect_list(F.struct("cluster", *per)).alias("m")).where(F.size("m") > 1).select("m", F.col("m.cluster").alias("clusters"))


def _surplus(twice: DataFrame, many: DataFrame, own: DataFrame, per: list[str]) -> DataFrame:
    """own, n (below 0): by how much a sum over its cells counts the narrow neighbours that a narrow cluster meets in more than one cell.

    Two that share s cells are in s(s - 1)/2 lists.
    """
    each = twice.where(F.size("clusters") <= NARROW).select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).where("a.cluster <> b.cluster")
    lists = each.select(F.col("a.cluster").alias("own"), F.col("b.cluster").alias("b"), *[F.col(f"b.{c}").alias(c) for c in per]).groupBy("own", "b", *per).agg(F.count("*").alias("t"))
    kept = lists.join(many.select(F.col("cluster").alias("own")), "own", "left_anti").join(many.select(F.col("cluster").alias("b")), "b", "left_anti")
    shared = F.round((F.sqrt(8 * F.col("t") + 1) + 1) / 2).cast("long")
    return kept.join(own.select(F.col("cluster").alias("own")), "own", "left_semi").select("own", *per, (1 - shared).alias("n"))


def neighbour_counts(member: DataFrame, saved: Callable, key: DataFrame | None = None, asked: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """cluster, and with `key` (cluster, p_key) the p_key of neighbours, and n: the number of other clusters that share a cell.

    Only clusters of `asked` (cluster) are counted for, if given; those without a neighbour have no row.  No pair becomes
    a row.  A cell that at most `hot` clusters have is posted as one array, and a cluster takes the union of its arrays.
    Narrow clusters, without hot cells and of few cells that no others share by twos, are no part of arrays for each other:
    a sum over the cells counts them, less those met more than once.  Clusters that meet in a hot cell are counted by the hot cells they have: distinct sets of hot cells are compared,
    not clusters, and a cluster's arrays leave out those it has met there.
    """
    per = [] if key is None else ["p_key"]
    spread = saved(member.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("cell", F.lit(True).alias("is_hot")))
    tagged = member.join(spread, "cell", "left").withColumn("is_hot", F.col("is_hot").isNotNull())
    light = F.collect_list(F.when(~F.col("is_hot"), F.col("cell")))
    heavy = F.array_sort(F.collect_list(F.when(F.col("is_hot"), F.col("cell"))))
    sets = tagged.groupBy("cluster").agg(light.alias("light"), heavy.alias("heavy"))
    sets = saved(sets if key is None else sets.join(key.select("cluster", "p_key"), "cluster"))
    hot_less = F.size("heavy") == 0
    # narrow clusters count each other: all that have their cells, less those met in more than one of them
    twice = saved(_met_twice(sets, per))
    many = twice.where(F.size("clusters") > NARROW).select(F.explode("clusters").alias("cluster")).distinct()
    narrow = hot_less & (F.size("light") <= NARROW)
    sets = sets.join(saved(many).withColumn("is_many", F.lit(True)), "cluster", "left").withColumn("narrow", narrow & F.col("is_many").isNull()).drop("is_many")
    own = sets if asked is None else sets.join(asked.select("cluster").distinct(), "cluster", "left_semi")
    posted = sets.select(F.explode("light").alias("cell"), *per, "cluster", "heavy", "narrow").groupBy("cell", *per).agg(
        F.collect_list(F.when(F.col("narrow"), F.col("cluster"))).alias("few"), F.collect_list(F.when(hot_less & ~F.col("narrow"), F.col("cluster"))).alias("near"),
        F.collect_list(F.when(~hot_less, F.struct("cluster", "heavy"))).alias("mixed"),
    )
    probed = own.select(F.explode("light").alias("cell"), F.col("cluster").alias("own"), F.col("heavy").alias("own_heavy"), F.col("narrow").alias("own_narrow")).join(posted, "cell")
    fresh = F.transform(F.filter("mixed", lambda c: ~F.arrays_overlap(c["heavy"], F.col("own_heavy"))), lambda c: c["cluster"])
    wide = F.when(F.size("mixed") == 0, F.col("near")).otherwise(F.concat("near", fresh))
    met = F.when(F.col("own_narrow"), wide).otherwise(F.concat("few", wide))
    itself = F.lit(1) if key is None else F.array_contains("few", F.col("own")).cast("int")
    by_own = probed.select("own", *per, F.when(F.size(met) > 0, met).alias("met"), F.when(F.col("own_narrow"), F.size("few") - itself).otherwise(0).alias("n")).groupBy("own", *per).agg(
        F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"), F.sum("n").alias("n")
    )
    by_light = by_own.select("own", *per, (F.size("met") - F.array_contains("met", F.col("own")).cast("int") + F.col("n")).alias("n")).union(_surplus(twice, many, own, per))
    # hot cells: how many clusters have one of a set's cells
    counted = sets.where(F.size("heavy") > 0).groupBy("heavy", *per).agg(F.count("*").alias("n"))
    theirs = counted.select(F.explode("heavy").alias("cell"), F.col("heavy").alias("theirs"), *per, "n")
    mine = own.where(F.size("heavy") > 0).select("heavy").distinct().select(F.explode("heavy").alias("cell"), F.col("heavy").alias("mine"))
    met_hot = mine.join(theirs, "cell").select("mine", "theirs", *per, "n").distinct().groupBy("mine", *per).agg(F.sum("n").alias("n"))
    of_own = own.where(F.size("heavy") > 0).select(F.col("cluster").alias("own"), F.col("heavy").alias("mine"), *[F.col(c).alias("own_key") for c in per])
    itself = F.lit(1) if key is None else (F.col("p_key") == F.col("own_key")).cast("long")
    by_heavy = of_own.join(met_hot, "mine").select("own", *per, (F.col("n") - itself).alias("n"))
    return by_light.union(by_heavy).groupBy(F.col("own").alias("cluster"), *per).agg(F.sum("n").alias("n")).where("n > 0")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions, from one computation of the pairs."""
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root): in each partition every node with the least node that the partition's edges (u, v) lead to; nodes are longs."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        u, v = (np.concatenate(c) for c in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:  # each edge hooks the larger root to the smaller, then paths are halved
            a, b = root[u], root[v]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
            open_ = root[u] != root[v]
            u, v = u[open_], v[open_]
        for k in range(0, len(nodes), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], schema=schema)

    return edges.select("u", "v").mapInArrow(run, "node long, root long")


def _labels(edges: DataFrame, saved: Callable, one_task: int) -> DataFrame:
    """(node, root): the least node that each node of the edges (u, v) reaches.

    Every task first joins what its own edges join, so that only stars are left: each node with its task's root.  While
    these are too many for one task, nodes pass their least neighbour on to the larger ones and then to the smaller ones,
    which keeps components and lowers the diameter; rounds replace each other's files.
    """
    stars, rounds, total = saved(_joined(edges).where("node <> root").toDF("u", "v").distinct()), 0, None
    while True:
        sums = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums.n <= one_task:
            return saved(_joined(stars.coalesce(1)), instead=stars)
        if (sums.n, sums.h) == total:  # stars of stars: every node knows its root
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return saved(stars.toDF("node", "root").union(roots), instead=stars)
        total, rounds = (sums.n, sums.h), rounds + 1
        both = stars.union(stars.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, instead=stars)
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # all edges lead down
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = saved(small, instead=large)


def components(member: DataFrame, saved: Callable, one_task: int = ONE_TASK) -> DataFrame:
    """cluster, component: least cluster reachable through shared cells.  Clusters are integers.

    A cell links its clusters to its least one, so there are no more edges than members.  Members are dealt out once, by
    cell, and may repeat.
    """
    member = member.select(F.col("cluster").cast("long").alias("cluster"), "cell")
    edges = member.where(F.col("cell").isNotNull()).withColumn("v", F.min("cluster").over(Window.partitionBy("cell"))).where("cluster <> v").select(F.col("cluster").alias("u"), "v")
    labels = _labels(edges, saved, one_task)
    alone = member.select("cluster").distinct()
    return alone.join(labels.select(F.col("node").alias("cluster"), "root"), "cluster", "left").select("cluster", F.coalesce("root", "cluster").alias("component"))


def weighted_counts(neighbours: DataFrame, keyed: DataFrame) -> DataFrame:
    """neighbours: cluster, n.  Each cluster counts as one over itself and its neighbours."""
    share = 1.0 / (1 + F.coalesce("n", F.lit(0)))
    return keyed.join(neighbours.select("cluster", "n"), "cluster", "left").groupBy("p_key").agg(F.round(F.sum(share), 6).alias("weighted"), F.count("*").alias("cnt"))


def overlap_ratio(member: DataFrame, keyed: DataFrame) -> DataFrame:
    """Share of the clusters of key_a that touch at least one cluster of key_b.

    A cell passes on which keys its clusters have, not the clusters: keys are numbered, and 64 of them are the bits of one
    long, so a member is a row or two of fixed width however many clusters its cell has.
    """
    key = keyed.select("cluster", "p_key")
    number = numbered(key.groupBy("p_key").agg(F.count("*").alias("n")), [F.col("p_key")], "k")
    own = key.join(number, "p_key").select("cluster", "k")
    rows = member.join(own, "cluster").select("cluster", "k", "cell").repartition("cell")
    held = rows.groupBy("cell", F.expr("k div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 AS int)))").alias("bits"))
    near = rows.join(held, "cell").groupBy("cluster", "k", "word").agg(F.bit_or("bits").alias("bits"))
    each = near.select("k", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where("getbit(bits, bit) = 1")
    touching = each.select(F.col("k").alias("a"), F.expr("word * 64 + bit").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("touching"))
    of_a, of_b = number.select(F.col("k").alias("a"), F.col("p_key").alias("key_a"), "n"), number.select(F.col("k").alias("b"), F.col("p_key").alias("key_b"))
    return touching.join(of_a, "a").join(of_b, "b").select("key_a", "key_b", F.round(F.col("touching") / F.col("n"), 6).alias("overlap_ratio"))


def presence(member: DataFrame, keyed: DataFrame, master: DataFrame) -> DataFrame:
    """For (p_key, master): share of clusters holding it, and its mean number in a cluster."""
    key = keyed.select("cluster", "p_key")
    dealt = tasks(member)
    rows = member.join(master, "cell").repartition(dealt, "cluster").join(key.repartition(dealt, "cluster"), "cluster")
    held = rows.groupBy("p_key", "master", "cluster").agg(F.count("*").alias("k")).groupBy("p_key", "master").agg(F.count("*").alias("c"), F.sum("k").alias("k"))
    n = key.groupBy("p_key").agg(F.count("*").alias("n"))
    return held.join(n, "p_key").select("p_key", "master", F.round(F.col("c") / F.col("n"), 6).alias("m1"), F.round(F.col("k") / F.col("n"), 6).alias("m2"))


def attributes(member: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (cell, area, master): for each cluster the number, total and largest area of its cells, and how many masters they have."""
    rows = member.join(cells, "cell").repartition(tasks(member), "cluster")
    return rows.groupBy("cluster").agg(
        F.count("*").alias("n_cells"), F.sum("area").alias("total_area"), F.countDistinct("master").alias("n_masters"), F.max("area").cast("long").alias("max_area")
    )


def secondary(member: DataFrame, keyed: DataFrame, primary: DataFrame, k: int, saved: Callable) -> DataFrame:
    """For the clusters of the primary key: neighbours by key, most in one cluster, top k."""
    key = keyed.select("cluster", "p_key")
    own = key.join(primary.select("p_key"), "p_key", "left_semi").select("cluster")
    near = neighbour_counts(member, saved, key, own).join(primary.select("p_key"), "p_key", "left_anti")
    return near.groupBy("p_key").agg(F.max("n").alias("max_overlap")).orderBy(F.col("max_overlap").desc(), "p_key").limit(k)


def coverage(single: DataFrame, composite: DataFrame) -> DataFrame:
    """p_key, total, and its matches by one cell and by clusters."""
    a = single.groupBy("p_key").agg(F.count("*").alias("single_cell"))
    b = composite.groupBy("p_key").agg(F.count("*").alias("multi_cell"))
    zero = F.lit(0).cast("long")
    return a.join(b, "p_key", "full").select(
        "p_key", (F.coalesce("single_cell", zero) + F.coalesce("multi_cell", zero)).alias("total"),
        F.coalesce("single_cell", zero).alias("single_cell"), F.coalesce("multi_cell", zero).alias("multi_cell"),
    )


def area_gain(areas: DataFrame, library: DataFrame) -> DataFrame:
    """areas: p_key, area of each cluster; library: p_key, cell, area.  Gain is the mean cluster's area less the new cell's."""
    stats = areas.groupBy("p_key").agg(
        F.count("*").alias("n_clusters"), F.round(F.avg("area"), 4).alias("avg_area"), F.min("area").alias("min_area"), F.max("area").alias("max_area"),
        F.avg("area").alias("__avg"),
    )
    return stats.join(library.select("p_key", "cell", F.col("area").alias("new_area")), "p_key", "left").select(
        "p_key", F.coalesce("cell", F.lit("(none)")).alias("cell"), "n_clusters", "avg_area", "min_area", "max_area", F.coalesce("new_area", F.lit(-1)).alias("new_area"),
        F.round(F.col("__avg") - F.col("new_area"), 4).alias("gain"),
    )


def totals(counts: DataFrame) -> DataFrame:
    """One row: occurrences of all patterns and their number."""
    return counts.agg(F.sum("cnt").alias("total"), F.count("*").alias("patterns"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent patterns, ties by key."""
    return counts.select("p_key", "cnt").orderBy(F.col("cnt").desc(), "p_key").limit(k)


def select_candidates(keyed: DataFrame, labels: DataFrame, member: DataFrame, most: int) -> DataFrame:
    """The most frequent key that a library cell has, and up to `most` others that its clusters overlap with: kind, p_key, label, cnt."""
    anchor = frequency(keyed).join(labels, "p_key").orderBy(F.col("cnt").desc(), "p_key").limit(1)
    key = keyed.select("cluster", "p_key")
    own = key.join(anchor.select("p_key"), "p_key", "left_semi").select("cluster")
    cells = member.join(own, "cluster", "left_semi").select("cell").distinct()
    near = member.join(cells, "cell", "left_semi").select("cluster").distinct()
    found = near.join(key, "cluster").join(anchor.select("p_key"), "p_key", "left_anti").groupBy("p_key").agg(F.count("*").alias("cnt")).join(labels, "p_key")
    best = found.orderBy(F.col("cnt").desc(), "p_key").limit(most)
    return anchor.select(F.lit("anchor").alias("kind"), "p_key", "label", "cnt").union(best.select(F.lit("overlap"), "p_key", "label", "cnt"))
