"""Demand: candidates for mined functions, cost-weighted split, demand of each cell; relations between keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_relation(relation: DataFrame) -> DataFrame:
    """The cheapest usable row for each (target, base): least total, then base count, then inverters."""
    best = relation.where("status = 'OK'").groupBy("target", "base").agg(F.min(F.struct("total", "base_count", "inv_count")).alias("m"))
    return best.select("target", "base", "m.base_count", "m.inv_count", "m.total")


def candidates(mined: DataFrame, cells: DataFrame, relation: DataFrame, max_cost: int) -> DataFrame:
    """mined (key, cnt, n), cells (key, name, n): itself if it is a cell, else every base within cost and fan-in."""
    own = mined.join(cells.select("key"), "key", "left_semi").select(
        F.col("key").alias("logic"), "cnt", F.col("key").alias("base"), F.lit(1).alias("base_count"), F.lit(0).alias("inv_count"), F.lit(1).alias("total")
    )
    others = (
        best_relation(relation).where((F.col("total") <= max_cost) & (F.col("target") != F.col("base")))
        .join(mined.select(F.col("key").alias("target"), "cnt", F.col("n").alias("nt")), "target")
        .join(cells.select(F.col("key").alias("base"), F.col("n").alias("nb")), "base").where("nb <= nt")
        .select(F.col("target").alias("logic"), "cnt", "base", "base_count", "inv_count", "total")
    )
    return own.unionByName(others)


def uncovered(mined: DataFrame, found: DataFrame) -> DataFrame:
    return mined.join(found.select(F.col("logic").alias("key")), "key", "left_anti").select("key", "cnt")


def with_delta(found: DataFrame, cost: DataFrame) -> DataFrame:
    """cost (key, fet): transistors of the detour beyond the direct cell, at least 0."""
    joined = found.join(cost.toDF("base", "base_fet"), "base").join(cost.toDF("logic", "direct_fet"), "logic")
    return joined.withColumn("indirect_fet", F.col("base_count") * F.col("base_fet") + 2 * F.col("inv_count")).withColumn(
        "delta", F.greatest(F.lit(0), F.col("indirect_fet") - F.col("direct_fet"))
    )


def weighted_split(found: DataFrame) -> DataFrame:
    """Every function's count is shared out by 1 / (1 + delta)."""
    w = 1.0 / (1 + F.col("delta"))
    ratio = F.col("w") / F.sum("w").over(Window.partitionBy("logic"))
    return found.withColumn("w", w).withColumn("ratio", ratio).withColumn("base_used", F.col("ratio") * F.col("cnt") * F.col("base_count")).withColumn(
        "inv_used", F.col("ratio") * F.col("cnt") * F.col("inv_count")
    )


def cell_demand(split: DataFrame) -> DataFrame:
    """Cells used of each base, and one INV row for all inverters."""
    cells = split.groupBy(F.col("base").alias("cell")).agg(F.round(F.sum("base_used"), 4).alias("used"))
    return cells.union(split.agg(F.round(F.sum("inv_used"), 4).alias("used")).select(F.lit("INV"), "used"))


def symmetric_overlap(relation: DataFrame, threshold: int) -> DataFrame:
    """Every unordered pair of targets with both directions' cost, the cheaper one and who absorbs whom."""
    keys = relation.select(F.col("target").alias("k")).distinct()
    pairs = keys.toDF("key_a").crossJoin(keys.toDF("key_b")).where("key_a < key_b")  # keys are function classes, a finite set
    one = relation.groupBy("target", "base").agg(F.min(F.struct("total", "status")).alias("m"))
    ab = one.select(F.col("target").alias("key_a"), F.col("base").alias("key_b"), F.col("m.total").alias("t_ab"), F.col("m.status").alias("s_ab"))
    ba = one.select(F.col("target").alias("key_b"), F.col("base").alias("key_a"), F.col("m.total").alias("t_ba"), F.col("m.status").alias("s_ba"))
    cost = lambda t, s: F.when(F.col(s).isin("OK", "PROJECTION"), F.col(t))
    joined = pairs.join(ab, ["key_a", "key_b"], "left").join(ba, ["key_a", "key_b"], "left")
    joined = joined.select("key_a", "key_b", cost("t_ab", "s_ab").alias("cost_ab"), F.coalesce("s_ab", F.lit("MISSING")).alias("status_ab"),
                           cost("t_ba", "s_ba").alias("cost_ba"), F.coalesce("s_ba", F.lit("MISSING")).alias("status_ba"))
    least = F.least("cost_ab", "cost_ba")
    return joined.select(
        "*", least.alias("min_cost"),
        F.when(least.isNull(), None).when(F.col("cost_ab") <= F.coalesce("cost_ba", F.col("cost_ab")), F.col("key_b")).otherwise(F.col("key_a")).alias("absorber"),
        F.when(F.coalesce(least <= threshold, F.lit(False)), "YES").otherwise("NO").alias("overlap"),
    )


def missing_pairs(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Ordered pairs of distinct keys that are not cached yet; keys are a finite set of classes."""
    return keys.toDF("target").crossJoin(keys.toDF("base")).where("target <> base").join(known.select("target", "base"), ["target", "base"], "left_anti")
