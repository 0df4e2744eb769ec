"""Data-quality queries: every one gives the rows that break a rule, or counts of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reasons for which the search leaves a cell set out, in the order in which they are tested.
PRUNED = ["max_outputs", "external_loads", "max_distance", "max_root_dx", "max_root_dy", "max_cells", "max_depth"]


def bad_counts(counts: DataFrame) -> DataFrame:
    """(rule, n) for a table name, count (strings as read): what is no number, NaN, negative, not whole, or named twice."""
    value = F.try_to_number(F.col("count"), F.lit("999999999999.999999")).cast("double")
    number = F.when(F.lower("count") == "nan", F.lit(float("nan"))).otherwise(F.coalesce(value, F.expr("try_cast(count AS double)")))
    rows = counts.select("name", number.alias("v"))
    n = lambda test: F.count(F.when(test, 1))
    one = rows.agg(
        n(F.col("v").isNull()).alias("no number"), n(F.isnan("v")).alias("nan"), n((F.col("v") < 0) & ~F.isnan("v")).alias("negative"),
        n((F.col("v") != F.floor("v")) & ~F.isnan("v")).alias("not whole"),
    )
    twice = rows.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("twice"))
    spread = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in df.columns])).alias("r")).select("r.*")
    return spread(one).union(spread(twice))


def header_matches(lines: DataFrame, expected: str) -> DataFrame:
    """(path, ok): whether the first line of each file is the expected header."""
    return lines.groupBy("path").agg(F.min_by("value", "line").alias("head")).select("path", (F.trim("head") == expected).alias("ok"))


def bad_slack(metrics: DataFrame, columns: list[str], least: float = -100.0) -> DataFrame:
    """Runs with a slack that no sound run has."""
    return metrics.where(reduce(lambda a, b: a | b, [F.col(c) < least for c in columns]))


def completeness(runs: DataFrame, files: DataFrame, needed: list[str], tails: DataFrame, mark: str) -> DataFrame:
    """(run, missing, finished): needed files that a run lacks, and whether the last lines of its log hold the mark."""
    wanted = runs.select("run", F.explode(F.array(*map(F.lit, needed))).alias("file"))
    lacks = wanted.join(files.select("run", "file"), ["run", "file"], "left_anti").groupBy("run").agg(F.array_sort(F.collect_list("file")).alias("missing"))
    ended = tails.where(F.col("value").rlike(mark)).select("run").distinct().withColumn("finished", F.lit(True))
    return runs.select("run").join(lacks, "run", "left").join(ended, "run", "left").select(
        "run", F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"), F.coalesce("finished", F.lit(False)).alias("finished")
    )


def content_stamp(files: DataFrame) -> DataFrame:
    """One row: a digest over the digests of files (path, content), in the order of paths."""
    each = files.select("path", F.md5("content").alias("h"))
    joined = each.agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("l"))  # a handful of inputs
    return joined.select(F.md5(F.encode(F.array_join(F.transform("l", lambda x: x["h"]), "\n"), "utf-8")).alias("stamp"))


def verdicts(checks: DataFrame) -> DataFrame:
    """(run, status, why): broken if any check of a run is, with the names of those."""
    broken = F.array_sort(F.collect_set(F.when(F.col("broken"), F.col("check"))))
    out = checks.groupBy("run").agg(F.bool_or("broken").alias("b"), broken.alias("w"))
    return out.select("run", F.when(F.col("b"), "BROKEN").otherwise("OK").alias("status"), F.array_join("w", ",").alias("why"))


def log_violations(states: DataFrame, log: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """(rule, n) where the search's log and its rules disagree; all 0 in a sound log.

    states (root, cells, n_cells, n_inputs, n_outputs, depth), log (root, cells, verdict): an included set must be within
    all bounds, a pruned one must break the bound that it names, and every state must have exactly one verdict.
    """
    both = states.join(log, ["root", "cells"], "full")
    inside = (
        F.col("n_cells").between(bounds["min_cells"], bounds["max_cells"]) & F.col("n_inputs").between(bounds["min_inputs"], bounds["max_inputs"])
        & (F.col("n_outputs") <= bounds["max_outputs"]) & F.col("depth").between(2, bounds["max_depth"])
    )
    n = lambda test: F.count(F.when(test, 1))
    out = both.agg(
        n((F.col("verdict") == "include") & ~inside).alias("included outside of the bounds"),
        n((F.col("verdict") == "skip:bounds") & inside).alias("skipped within the bounds"),
        n((F.col("verdict") == "prune:max_depth") & (F.col("depth") <= bounds["max_depth"])).alias("depth within its bound"),
        n((F.col("verdict") == "prune:max_cells") & (F.col("n_cells") <= bounds["max_cells"])).alias("size within its bound"),
        n((F.col("verdict") == "prune:max_outputs") & (F.col("n_outputs") <= bounds["max_outputs"])).alias("outputs within their bound"),
        n(F.col("verdict").startswith("prune:") & ~F.col("verdict").isin([f"prune:{r}" for r in PRUNED])).alias("unknown reason"),
        n(F.col("verdict").isNull()).alias("state without verdict"), n(F.col("n_cells").isNull()).alias("verdict without state"),
    )
    twice = log.groupBy("root", "cells").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("two verdicts"))
    spread = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in df.columns])).alias("r")).select("r.*")
    return spread(out).union(spread(twice))
