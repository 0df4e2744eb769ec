"""Combinations, subsets, sweeps, small-graph checks, exact synthesis over the finite function space."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netmine.functions import names
from netmine.functions.expr import input_pattern
from netmine.operators.order import numbered
from netmine.session import saved

#: Up to so many keys every subset is made unless asked otherwise, beyond that so many are drawn.
MAX_ENUMERATED, DRAWN = 10, 50


def _unranked(numbers: DataFrame, k: int) -> DataFrame:
    """number, p1 < ... < pk: places of the combination with this number, in the combinatorial number system.

    The number is C(pk, k) + ... + C(p1, 1).  The greatest place whose term still fits lies within k of the root of
    k! times the number, so it is found among a few candidates; a candidate too large for a long doesn't fit.
    """
    factorials = "array(" + ", ".join(f"{float(math.factorial(i))}D" for i in range(1, k + 1)) + ")"
    low = f"greatest(cast(floor(pow(acc.rest * element_at({factorials}, size), 1D / size)) AS bigint) - 2, 0L)"
    term = "aggregate(sequence(0L, size - 1L), 1L, (t, i) -> try_multiply(t, c - i) div (i + 1))"
    fits = f"filter(transform(sequence({low}, {low} + size + 4), c -> struct(c AS place, {term} AS term)), t -> t.term <= acc.rest)"
    # one fold over the sizes; a chain of columns would repeat each step inside all later ones
    step = f"transform(array(element_at({fits}, -1)), b -> struct(acc.rest - b.term AS rest, concat(array(b.place), acc.places) AS places))[0]"
    folded = f"aggregate(sequence({k}, 1, -1), struct(number AS rest, cast(array() AS array<bigint>) AS places), (acc, size) -> {step}).places"
    return numbers.select("number", F.expr(folded).alias("p")).select("number", *[F.col("p")[i - 1].alias(f"p{i}") for i in range(1, k + 1)])


def _numbers(spark: SparkSession, count: int) -> DataFrame:
    """number from 0, of `count` rows, dealt out over tasks; more than a double can tell apart raises."""
    if count >= 1 << 53:
        raise ValueError(f"{count} combinations cannot be listed")
    return spark.range(count).select(F.col("id").alias("number"))


def combinations(items: DataFrame, key: str, k: int) -> DataFrame:
    """Every set of k of the distinct items (null is none) as columns c1 < c2 < ... < ck.

    A combination is made from its number: tasks share the C(n, k) numbers evenly, and each of the k places is looked up
    by its own equi-join, so no items are joined with items.
    """
    if k < 1:
        raise ValueError("a combination has one item at least")
    held = saved(numbered(items.select(F.col(key).alias("item")).where("item IS NOT NULL").distinct(), [F.col("item").asc()], "place"))
    out = _unranked(_numbers(items.sparkSession, math.comb(held.count(), k)), k)
    for i in range(1, k + 1):
        out = out.join(held.select(F.col("place").alias(f"p{i}"), F.col("item").alias(f"c{i}")), f"p{i}")
    return out.select(*[f"c{i}" for i in range(1, k + 1)])


def subsets(cells: DataFrame, mined: DataFrame, baseline: list[str], seed: int = 42, most: int = MAX_ENUMERATED) -> DataFrame:
    """(keys, cells): sets of keys with the cells that stand for them, of the least drive alone and with all drives.

    cells (name, p_key); keys must be mined and not in the baseline.  With up to `most` keys every set, made from the
    bits of its number; beyond that every single key and DRAWN sets of two and more whose numbers follow from a seeded
    hash (not the draw of another generator).
    """
    kept = cells.join(mined.select("p_key").distinct(), "p_key", "left_semi").where(~F.col("p_key").isin(baseline)).withColumn("drive", names.drive(F.col("name"), 1))
    kept = saved(kept.select("p_key", "name", (F.col("drive") == F.min("drive").over(Window.partitionBy("p_key"))).alias("is_base")))
    keys = saved(numbered(kept.select("p_key").distinct(), [F.col("p_key").asc()], "bit"))
    n, spark = keys.count(), cells.sparkSession
    if n <= most:
        chosen = _numbers(spark, 1 << n).where("number > 0").select(F.col("number").cast("string").alias("set"), F.expr(f"explode(filter(sequence(0L, {max(n - 1, 0)}L), b -> getbit(number, cast(b AS int)) = 1))").alias("bit"))
    else:
        single = keys.select(F.concat(F.lit("single "), "bit").alias("set"), "bit")
        draws = spark.range(1, 4 * DRAWN + 1).select(F.col("id").alias("draw"))
        taken = draws.select("draw", F.expr(f"explode(filter(sequence(0L, {n - 1}L), b -> xxhash64(draw, b + 1, {seed}) % 2 = 0))").alias("bit"))
        sets = taken.groupBy("draw").agg(F.array_sort(F.collect_list("bit")).alias("bits")).where(F.size("bits") > 1)
        first = sets.groupBy("bits").agg(F.min("draw").alias("draw")).orderBy("draw").limit(DRAWN)
        chosen = single.union(first.select(F.concat(F.lit("drawn "), "draw").alias("set"), F.explode("bits").alias("bit")))
    named = chosen.join(keys, "bit").join(kept, "p_key")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("name")))).alias("cells")
    whole = named.groupBy("set").agg(F.array_sort(F.collect_set("p_key")).alias("keys"), of(F.col("is_base")).alias("base"), of(F.lit(True)).alias("every"))
    return whole.select("keys", F.explode(F.array("base", "every")).alias("cells")).distinct()


def grid(areas: DataFrame, freqs: DataFrame, repeats: int) -> DataFrame:
    """area x freq x repeat, the parameters of a sweep."""
    return areas.select("area").distinct().crossJoin(freqs.select("freq").distinct()).select("area", "freq", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))


def around(value: float, step: float = 0.05, most: int = 2) -> list[float]:
    """A value and its steps of 5 % up and down."""
    return [round(value * (1 + step * i), 9) for i in range(-most, most + 1)]


def converge(first: float, step: Callable[[float], float], most: int = 20) -> list[float]:
    """Values of a loop that ends when one repeats or after `most` steps; each step is a query of its own."""
    seen = [first]
    for _ in range(most):
        value = step(seen[-1])
        if value in seen:
            return [*seen, value]
        seen.append(value)
    return seen


def connected(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets (root, cells) with `connected`: whether every cell is reached from the root against the edges within the set.

    A set has at most a few cells, so its inner edges fit a row; they are followed as often as it has cells.
    """
    rows = sets.select("root", "cells", F.explode("cells").alias("load"))
    inner = rows.join(edges.select("driver", "load"), "load").where(F.array_contains("cells", F.col("driver")))
    packed = inner.groupBy("root", "cells").agg(F.collect_set(F.struct("driver", "load")).alias("e"))
    reach = F.expr(
        "aggregate(sequence(1, size(cells)), array(root), (r, _) -> array_union(r, transform(filter(e, x -> array_contains(r, x.load)), x -> x.driver)))"
    )
    return sets.select("root", "cells").join(packed, ["root", "cells"], "left").withColumn("e", F.coalesce("e", F.expr("cast(array() AS array<struct<driver:bigint,load:bigint>>)"))).select(
        "root", "cells", (F.size(reach) == F.size("cells")).alias("connected")
    )


def longest_path(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets (root, cells) with `depth`: cells on the longest path from the root within the set (acyclic, connected)."""
    rows = sets.select("root", "cells", F.explode("cells").alias("load"))
    inner = rows.join(edges.select("driver", "load"), "load").where(F.array_contains("cells", F.col("driver")))
    packed = inner.groupBy("root", "cells").agg(F.collect_set(F.struct("driver", "load")).alias("e"))
    # what lies at the next distance, as often as something does
    level = F.expr(
        "aggregate(sequence(1, size(cells)), named_struct('at', array(root), 'd', 0), "
        "(s, _) -> if(size(s.at) = 0, s, named_struct('at', array_distinct(transform(filter(e, x -> array_contains(s.at, x.load)), x -> x.driver)), 'd', s.d + 1)))"
    )
    joined = sets.select("root", "cells").join(packed, ["root", "cells"], "left").withColumn("e", F.coalesce("e", F.expr("cast(array() AS array<struct<driver:bigint,load:bigint>>)")))
    return joined.select("root", "cells", level["d"].alias("depth"))


# ---------------------------------------------------------------- exact synthesis


@functools.lru_cache(maxsize=4096)
def synthesis(target: int, n: int, base: int, m: int, most: int) -> tuple[str, int | None, int | None, int | None]:
    """(status, base gates, inverters, total): fewest gates, then fewest inverters, that make the target of a base gate and inverters.

    Iterative deepening: every gate reads inputs and earlier gates; nets already made are never made again, and a
    base gate's inputs are distinct.  Of equal totals the circuit with the fewest inverters counts.
    """
    ones = (1 << (1 << n)) - 1
    inputs = [input_pattern(i, n) for i in range(n)]
    if target in inputs:
        return "PROJECTION", 0, 0, 0
    if _affine(base, m) and not _affine(target, n):
        return "IMPOSSIBLE_AFFINE", None, None, None
    minterms = [a for a in range(1 << m) if base >> ((1 << m) - 1 - a) & 1]

    def gate(nets):
        value = 0
        for a in minterms:
            term = ones
            for j, net in enumerate(nets):
                term &= net if a >> (m - 1 - j) & 1 else ones ^ net
            value |= term
        return value

    def grow(nets: tuple[int, ...], left: int, inverters: int) -> int | None:
        best = None
        made = {ones ^ x: inverters + 1 for x in nets}
        for pick in itertools.permutations(nets, m):
            v = gate(pick)
            made[v] = min(made.get(v, 1 << 30), inverters)
        if left == 1:
            return made.get(target)
        for v, cost in made.items():
            if v not in nets:
                found = grow((*nets, v), left - 1, cost)
                if found is not None and (best is None or found < best):
                    best = found
        return best

    for total in range(1, most + 1):
        inverters = grow(tuple(inputs), total, 0)
        if inverters is not None:
            return "OK", total - inverters, inverters, total
    return "IMPOSSIBLE_MAXGATES", None, None, None


def _affine(value: int, n: int) -> bool:
    """No product of two inputs in the algebraic normal form."""
    size = 1 << n
    return all(sum(value >> (size - 1 - a) & 1 for a in range(size) if a & s == a) % 2 == 0 for s in range(size) if s.bit_count() > 1)


def relation(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(target, base) keys `0b...` with status, base_count, inv_count, total of the smallest circuit of at most `most` gates."""
    def run(batches):
        for part in batches:
            rows = []
            for t, b in zip(part.target, part.base):
                found = synthesis(int(t[2:], 2), (len(t) - 2).bit_length() - 1, int(b[2:], 2), (len(b) - 2).bit_length() - 1, most)
                rows.append((t, b, *found))
            yield pd.DataFrame(rows, columns=["target", "base", "status", "base_count", "inv_count", "total"]).astype({c: "Int64" for c in ("base_count", "inv_count", "total")})

    return pairs.select("target", "base").mapInPandas(run, "target string, base string, status string, base_count long, inv_count long, total long")


def simulate(gates: list[tuple], n: int) -> list[int]:
    """Tables of the gates of a circuit: each (table, inputs) with numbers of nets, the circuit's n inputs first."""
    nets = [input_pattern(i, n) for i in range(n)]
    ones = (1 << (1 << n)) - 1
    for table, reads in gates:
        m, value = len(reads), 0
        for a in range(1 << m):
            if table >> ((1 << m) - 1 - a) & 1:
                value |= functools.reduce(lambda x, jr: x & (nets[jr[1]] if a >> (m - 1 - jr[0]) & 1 else ones ^ nets[jr[1]]), enumerate(reads), ones)
        nets.append(value)
    return nets[n:]


def synthesis_table(spark: SparkSession, bases: list[str], n: int, most: int) -> DataFrame:
    """The relation for every function of n inputs from each base."""
    keys = [f"0b{v:0{1 << n}b}" for v in np.arange(1 << (1 << n)).tolist()]
    return relation(spark.createDataFrame([(t, b) for t in keys for b in bases], "target string, base string"), most)
