"""Multi-output grouping: tuples of outputs that share inputs and cells.

A candidate has grp (its place), out, inputs, cells (sorted arrays), x/y bounds and,
if asked for, key (its function).  Candidates meet through a shared input of a place,
so the join is an equi-join on (place, input), or in mode exact on (place, inputs);
residual conditions are array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diagonal(a: str, b: str) -> Column:
    """Of the box around both; unknown places count as none."""
    side = lambda c: F.greatest(f"hi_{c}_{a}", f"hi_{c}_{b}") - F.least(f"lo_{c}_{a}", f"lo_{c}_{b}")
    return F.coalesce(F.sqrt(F.pow(side("x"), 2) + F.pow(side("y"), 2)), F.lit(-1.0))


def pairs(
    candidates: DataFrame, mode: str = "shared", least_shared_inputs: int = 1, least_shared_cells: int = 1, most_inputs: int = 6, span: float | None = None,
    different_keys: bool = False,
) -> DataFrame:
    """Pairs of outputs (out_a < out_b) of one place that share an input; mode exact asks for equal input sets.

    Pairs that share no input are never made, so fewer than one shared input cannot be asked for.
    """
    if mode not in ("shared", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    if least_shared_inputs < 1:
        raise ValueError("pairs meet through a shared input")
    cols = ["out", "inputs", "cells", "lo_x", "hi_x", "lo_y", "hi_y", *(["key"] if different_keys else [])]
    a = candidates.select("grp", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = candidates.select("grp", *[F.col(c).alias(f"{c}_b") for c in cols])
    if mode == "exact":
        met = a.join(b, (a["grp"] == b["grp"]) & (F.col("inputs_a") == F.col("inputs_b"))).drop(b["grp"]).where("out_a < out_b AND size(inputs_a) > 0")
    else:
        # the pair is taken where the least shared input meets, so it is made once
        left, right = a.withColumn("via", F.explode("inputs_a")), b.withColumn("via", F.explode("inputs_b"))
        met = left.join(right, ["grp", "via"]).where("out_a < out_b").where(F.col("via") == F.array_min(F.array_intersect("inputs_a", "inputs_b"))).drop("via")
    met = met.select(
        "*", F.size(F.array_intersect("inputs_a", "inputs_b")).alias("ki"), F.size(F.array_intersect("cells_a", "cells_b")).alias("kc"),
        F.size(F.array_union("inputs_a", "inputs_b")).alias("ui"), F.size(F.array_union("cells_a", "cells_b")).alias("uc"), diagonal("a", "b").alias("diagonal"),
    )
    keep = (F.col("ki") >= least_shared_inputs) & (F.col("kc") >= least_shared_cells) & (F.col("ui") <= most_inputs)
    if span is not None:
        keep = keep & (F.col("diagonal") <= span)
    if different_keys:
        keep = keep & (F.col("key_a") != F.col("key_b"))
    return met.where(keep).select(
        "grp", "out_a", "out_b", F.col("ki").cast("long").alias("shared_inputs"), F.col("kc").cast("long").alias("shared_cells"),
        F.round(F.col("ki") / F.col("ui"), 6).alias("input_overlap"), F.round(F.col("kc") / F.col("uc"), 6).alias("cell_overlap"),
    )


def tuples(pair: DataFrame, k: int, saved: Callable) -> DataFrame:
    """Distinct tuples o1 < ... < ok in which every two pair up, with the mean input overlap of their pairs.

    A pair leads from the output with fewer pairs to the one with more, so no output leads to more than the square root of
    twice all pairs.  A tuple carries the outputs that all of its own lead to; only those extend it, so what is made is
    always a tuple, never a chain that nothing closes.
    """
    if k < 2:
        raise ValueError("a tuple has two outputs at least")
    edge = saved(pair.select("grp", "out_a", "out_b", "input_overlap"))
    degree = edge.select("grp", F.explode(F.array("out_a", "out_b")).alias("out")).groupBy("grp", "out").agg(F.count("*").alias("n"))
    ranked = edge
    for side in ("a", "b"):
        ranked = ranked.join(degree.select("grp", F.col("out").alias(f"out_{side}"), F.struct("n", "out").alias(f"rank_{side}")), ["grp", f"out_{side}"])
    down = F.col("rank_a") < F.col("rank_b")
    led = ranked.select("grp", F.when(down, F.col("out_a")).otherwise(F.col("out_b")).alias("last"), F.struct(F.when(down, F.col("out_b")).otherwise(F.col("out_a")).alias("out"), F.col("input_overlap").alias("s")).alias("to"))
    near = saved(led.groupBy("grp", "last").agg(F.map_from_entries(F.collect_list("to")).alias("near")))
    rows = near.select("grp", F.array("last").alias("outs"), F.lit(0.0).alias("total"), F.expr("transform(map_entries(near), e -> struct(e.key AS out, e.value AS s))").alias("ahead"))
    for n in range(2, k + 1):
        # `s` of an output ahead is the sum of its overlaps with all outputs of the tuple
        step = rows.where(F.size("ahead") > k - n).select("grp", "outs", "total", "ahead", F.explode("ahead").alias("to"))
        rows = step.select("grp", F.concat("outs", F.array("to.out")).alias("outs"), (F.col("total") + F.col("to.s")).alias("total"), "ahead", F.col("to.out").alias("last"))
        if n < k:
            both = "transform(filter(ahead, x -> map_contains_key(near, x.out)), x -> struct(x.out AS out, x.s + near[x.out] AS s))"
            rows = rows.join(near, ["grp", "last"]).select("grp", "outs", "total", F.expr(both).alias("ahead"))
    outs = F.array_sort("outs")
    return rows.select("grp", *[outs[i - 1].alias(f"o{i}") for i in range(1, k + 1)], F.round(F.col("total") / (k * (k - 1) // 2), 6).alias("mean_overlap"))


def triples(pair: DataFrame, saved: Callable) -> DataFrame:
    return tuples(pair, 3, saved).select("grp", F.col("o1").alias("a"), F.col("o2").alias("b"), F.col("o3").alias("c"), "mean_overlap")


def similarities(candidates: DataFrame, pair: DataFrame) -> DataFrame:
    """Means for each pair of functions over its pairs: number, Jaccard of inputs, Jaccard of cells; candidates have key."""
    of = lambda side: candidates.select("grp", F.col("out").alias(f"out_{side}"), F.col("key").alias(f"key_{side}"))
    named = pair.join(of("a"), ["grp", "out_a"]).join(of("b"), ["grp", "out_b"])
    low, high = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
    return named.groupBy(low.alias("key_a"), high.alias("key_b")).agg(F.count("*").alias("n"), F.round(F.avg("input_overlap"), 6).alias("avg_input_overlap"), F.round(F.avg("cell_overlap"), 6).alias("avg_cell_overlap"))


def merged(candidates: DataFrame, pair: DataFrame) -> DataFrame:
    """Frequency of merged functions: the two keys sorted and joined, their number, and the mean overlaps."""
    s = similarities(candidates, pair)
    return s.select(F.array_join(F.array_sort(F.array("key_a", "key_b")), ";").alias("p_key"), "n", "avg_input_overlap", "avg_cell_overlap")
