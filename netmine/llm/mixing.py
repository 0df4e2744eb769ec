"""A mix of sources to target weights, in words, by subset sums over lengths.

Sizes are counted once; everything after that works on counts of documents by
exact length.  Each source's target is met in three steps: whole copies, an even
share of every length, and for the words that remain a bounded knapsack over the
lengths still left, solved by dynamic programming.  The plan says how many
documents of each length to take; which ones follows from a seeded digest, so a
rerun, or a task run again on another executor, takes the same.

A source's histogram has one row for each length, whatever the number of its
documents.  Documents of one source and length, which may be a third of all, are
ranked in about sqrt(c) buckets of about sqrt(c) rows each.

Defined cases: null text has size 0; documents of size 0 are never taken; a null
source is a source, ordered last; rows that repeat an id are documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netmine.llm.common import delete, saved
from netmine.operators.order import numbered, running

WEIGHTS = (5, 2, 1)
#: All targets together, in percent of all sizes.
SHARE = 150
#: No source, and no document, is taken more often than this.
MOST = 2
SEED = 13
#: Words of a target that the even share leaves to the knapsack, at most, and at most one in so many of them.
RESERVE, ONE_IN = 1 << 15, 16

_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, the key of the source ('' is null), size, and the digest that orders documents of one length."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("h"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """skey, source_size and target of sources (skey, source_size).

    Weights repeat over the sources by code point, null last.  Sharing by weight and
    passing on what is above a bound ends where the bounded sources are those with
    the least bound for their weight: with sources in that order, one is bounded if
    its bound is at most its share of what the sources before it leave.
    """
    n = len(weights)
    by_name = numbered(sources, [(F.col("skey") == "").asc(), F.col("skey").asc()], "no")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("no") % n + 1).cast("int"))
    weighed = by_name.select("skey", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("bound"))
    ordered = running(weighed, [(F.col("bound") / F.col("weight")).asc(), F.col("skey").asc()], {"bound_before": "bound", "weight_before": "weight"})
    # The sources of one ratio are bounded or free together, and either way get the same target.
    total = ordered.agg(F.sum(F.col("source_size").cast("decimal(38,0)")).alias("s"), F.sum("weight").alias("w")).first()
    words, all_weights = (total.s or 0), (total.w or 0)
    left = f"(CAST({words * share} AS DECIMAL(38,0)) - 100 * bound_before)"  # a hundred times the words
    free = f"(CAST({all_weights} AS DECIMAL(38,0)) - weight_before)"
    bounded = ordered.withColumn("is_bound", F.expr(f"100 * CAST(bound AS DECIMAL(38,0)) * {free} <= weight * {left}"))
    kept = bounded.where("is_bound").agg(F.coalesce(F.sum(F.col("bound").cast("decimal(38,0)")), F.lit(0)).alias("b"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    words_left = float(words * share - 100 * kept.b) / 100.0
    weight_left = float(all_weights - kept.w) or 1.0
    target = F.when(F.col("is_bound"), F.col("bound").cast("double")).otherwise(F.col("weight").cast("double") * F.lit(words_left) / F.lit(weight_left))
    return bounded.select("skey", "source_size", target.alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the words come as near to `budget` as they can without going above it.

    A count is split into 1, 2, 4, ... copies, each used at most once.  `first` holds
    the item that first reached a sum; the sum without it was reached by earlier items,
    so following it back gives the items.  It ends at once when the budget is met.
    """
    first = np.full(budget + 1, -1, dtype=np.int32)
    first[0] = 0
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = [(0, 0)]
    for which, (length, count) in enumerate(zip(lengths, counts)):
        if length <= 0:
            continue
        count = min(count, budget // length)
        copies = 1
        while count > 0 and not reached[budget]:
            copies = min(copies, count)
            words = length * copies
            new = np.flatnonzero(reached[: budget + 1 - words] & ~reached[words:]) + words
            if new.size:
                items.append((which, copies))
                first[new] = len(items) - 1
                reached[new] = True
            count -= copies
            copies *= 2
        if reached[budget]:
            break
    take = [0] * len(lengths)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        which, copies = items[first[at]]
        take[which] += copies
        at -= copies * lengths[which]
    return take


def fit(lengths: list[int], counts: list[int], target: float, reserve: int = RESERVE) -> tuple[int, list[int]]:
    """Whole copies of the source, and for each length the number of documents taken once more."""
    words = sum(n * c for n, c in zip(lengths, counts))
    whole, budget = divmod(int(target), words) if words else (0, 0)
    take = [0] * len(lengths)
    even = budget - min(reserve, budget // ONE_IN)
    carry = 0  # words that lengths so far could not take, times `words`
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] > 0:
            carry += counts[i] * lengths[i] * even
            take[i] = min(counts[i], carry // (lengths[i] * words))
            carry -= take[i] * lengths[i] * words
    left = budget - sum(n * t for n, t in zip(lengths, take))
    for i, more in enumerate(knapsack(lengths, [c - t for c, t in zip(counts, take)], left)):
        take[i] += more
    return whole, take


def plan(histogram: DataFrame, wanted: DataFrame, reserve: int = RESERVE) -> DataFrame:
    """skey, size, c (documents), whole and more: of the c documents each is taken `whole` times and `more` of them once more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        whole, more = fit(rows["size"].tolist(), rows["c"].tolist(), float(rows["target"].iloc[0]), reserve)
        return pd.DataFrame({"skey": rows["skey"], "size": rows["size"], "c": rows["c"], "whole": whole, "more": more})

    joined = histogram.join(wanted.select("skey", "target"), "skey")
    return joined.groupBy("skey").applyInPandas(run, "skey string, size long, c long, whole long, more long")


def _chosen(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """doc_id, skey, size and `extra` (0 or 1) of every row: the `more` first in the order of buckets and digests."""
    group = ["skey", "size"]
    bucket: Column = F.pmod("h", F.ceil(F.sqrt("c")).cast("long")).alias("bucket")
    dealt = saved(rows.join(planned, group).select("doc_id", *group, "h", "whole", "more", bucket))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "bucket").agg(F.count("*").alias("n")).select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("h", "doc_id"))
    placed = dealt.select("*", place.alias("place")).join(offsets, [*group, "bucket"])
    return placed.select("doc_id", *group, (F.col("whole") + (F.col("before") + F.col("place") <= F.col("more")).cast("long")).alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = SEED, reserve: int = RESERVE) -> DataFrame:
    """doc_id, source, size, source_size, target, times (0 to `most`) and taken = times * size of every document."""
    rows = saved(sized(docs, seed))
    spark = rows.sparkSession
    histogram = saved(rows.groupBy("skey", "size").agg(F.count("*").alias("c")))
    wanted = saved(targets(histogram.groupBy("skey").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")), weights, share, most))
    planned = saved(plan(histogram, wanted, reserve), instead=histogram)
    chosen = _chosen(rows, planned)  # written inside, so `rows` and the plan are read no more
    for done in (rows, planned):
        delete(spark, done._saved_at)
    source = F.when(F.col("skey") != "", F.expr("substr(skey, 2)"))
    return chosen.join(wanted, "skey").select("doc_id", source.alias("source"), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and source."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
