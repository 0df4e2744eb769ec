"""Which cells of a library count: masks, subsets, compliance, names, candidates, admission of runs.

Cell tables are those of a library (hundreds of rows, thousands at most); what is
joined to them may be of any size.  Broken input raises instead of giving nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netmine.functions import names

#: Fixed value: the buffer's key, active in every library.
ALWAYS_ACTIVE = "0b01"


def mask(cells: DataFrame, keys: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """cells (name, p_key) with `active`: by the given keys (p_key) if there are any, else by glob patterns (pattern); buffers always."""
    if keys is not None:
        hit = cells.join(keys.select("p_key").distinct(), "p_key", "left_semi").select("name").distinct()
    elif patterns is not None:
        hit = cells.join(F.broadcast(patterns), names.glob_match(F.col("name"), F.col("pattern")), "left_semi").select("name").distinct()
    else:
        hit = cells.select("name").limit(0)
    found = cells.join(hit.withColumn("hit", F.lit(True)), "name", "left")
    return found.withColumn("active", F.coalesce("hit", F.lit(False)) | (F.col("p_key") == ALWAYS_ACTIVE)).drop("hit")


def subset(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """(run, source, name): the cells that each run may use, by the first source that yields any.

    rules: run, source, value.  In order: direct_deny, provenance_deny and filter_deny list cells that are taken out,
    only_use names cells, canonical_keys lists keys.  A deny list that exists always decides, even if it leaves none.
    """
    order = F.expr("array_position(array('direct_deny', 'provenance_deny', 'filter_deny', 'only_use', 'canonical_keys'), source)")
    listed = rules.select("run", "source", order.alias("rank"), F.col("value").alias("v")).distinct()
    lists = listed.select("run", "source", "rank").distinct()
    # the first deny list of a run decides before all else, so no other is taken against the cells, and only such runs meet all cells
    deny = lists.where("source LIKE '%deny'").groupBy("run").agg(F.min(F.struct("rank", "source")).alias("m")).select("run", "m.source", "m.rank")
    left = deny.crossJoin(cells.select("name")).join(listed.select("run", "source", F.col("v").alias("name")), ["run", "source", "name"], "left_anti")
    only = listed.where("source = 'only_use'").withColumnRenamed("v", "name").join(cells.select("name").distinct(), "name", "left_semi")
    keyed = listed.where("source = 'canonical_keys'").withColumnRenamed("v", "p_key").join(cells.select("name", "p_key"), "p_key")
    found = left.select("run", "source", "rank", "name").unionByName(only.select("run", "source", "rank", "name")).unionByName(keyed.select("run", "source", "rank", "name"))
    decided = deny.select("run", "rank").unionByName(only.select("run", "rank")).unionByName(keyed.select("run", "rank")).groupBy("run").agg(F.min("rank").alias("rank"))
    return found.join(decided, ["run", "rank"]).select("run", "source", "name").distinct()


def compliance(used: DataFrame, rules: DataFrame, allow: bool = False) -> DataFrame:
    """used (name, count) with a verdict against deny globs, or against a list of allowed names.

    Deny: `violation` or `ok`.  Allow: `ok`; `drive` if the same cell of drive 1 is allowed; `sequential` for names ending in _SH; else `violation`.
    """
    if not allow:
        bad = used.join(F.broadcast(rules.select("pattern")), names.glob_match(F.col("name"), F.col("pattern")), "left_semi").select("name").distinct()
        return used.join(bad.withColumn("bad", F.lit(True)), "name", "left").select(*used.columns, F.when(F.col("bad"), "violation").otherwise("ok").alias("verdict"))
    listed = rules.select(F.col("pattern").alias("allowed")).distinct()
    base = F.regexp_replace("name", r"_X[248](_.*)?$", "_X1")
    one = used.withColumn("__base", base)
    one = one.join(listed.select(F.col("allowed").alias("name"), F.lit(True).alias("own")), "name", "left").join(
        listed.select(F.col("allowed").alias("__base"), F.lit(True).alias("kin")), "__base", "left"
    )
    verdict = F.when(F.col("own"), "ok").when(F.col("kin"), "drive").when(F.col("name").endswith("_SH"), "sequential").otherwise("violation")
    return one.select(*used.columns, verdict.alias("verdict"))


def enforce(judged: DataFrame, bad: str = "violation") -> None:
    """Raise if any row is a violation, naming some."""
    found = [r.name for r in judged.where(F.col("verdict") == bad).select("name").orderBy("name").limit(5).collect()]
    if found:
        raise ValueError(f"cells outside the allowed library: {', '.join(found)}")


def resolve(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """asked (name, p_key) with `resolved`: itself if the vocabulary (name, p_key) has it, else the cell of the same key and drive.

    Of several, names that end with their drive come first, then the order of names; without any the name stays.
    """
    exact = vocabulary.select("name").distinct().withColumn("known", F.lit(True))
    ends = F.when(F.col("name").rlike(r"_X\d+$"), 0).otherwise(1)
    by_key = vocabulary.withColumn("drive", names.drive(F.col("name"))).where("drive IS NOT NULL").groupBy("p_key", "drive").agg(F.min(F.struct(ends.alias("e"), "name")).alias("best"))
    found = asked.withColumn("drive", names.drive(F.col("name"))).join(exact, "name", "left").join(by_key, ["p_key", "drive"], "left")
    return found.select(*asked.columns, F.when(F.col("known"), F.col("name")).otherwise(F.coalesce("best.name", "name")).alias("resolved"))


def remap(rows: DataFrame, key: str, to: Column, numbers: list[str], others: list[str], order: str) -> DataFrame:
    """Rows under new keys: of those that meet, numbers add up and of other columns the first by `order` stays."""
    renamed = rows.withColumn("__new", to)
    return renamed.groupBy(F.col("__new").alias(key)).agg(*[F.sum(c).alias(c) for c in numbers], *[F.min_by(c, F.col(order)).alias(c) for c in others])


def admit(runs: DataFrame, used: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """runs (run, has_patterns, broken) with the reason they are skipped, null if admitted.

    used (run, name, is_logic, count): cells out of the vocabulary, or under two logic cells in use, reject a run.
    """
    known = vocabulary.select("name").distinct()
    out = used.join(known, "name", "left_anti").groupBy("run").agg(F.count("*").alias("unknown"))
    active = used.where("is_logic AND count > 0").groupBy("run").agg(F.countDistinct("name").alias("active"))
    reason = (
        F.when(~F.col("has_patterns"), "no patterns").when(F.col("broken"), "broken").when(F.coalesce("unknown", F.lit(0)) > 0, "unknown cells")
        .when(F.coalesce("active", F.lit(0)) < 2, "too few cells")
    )
    return runs.join(out, "run", "left").join(active, "run", "left").select(*runs.columns, reason.alias("reason"))


def passes(metrics: DataFrame, least_slack: float = -0.020, most_drc: int = 200, most_shorts: int = 20) -> Column:
    """Whether a run has ended within its limits: slack of both groups, rule violations, shorts."""
    return (
        F.col("completed") & (F.col("slack_in2reg") >= least_slack) & (F.col("slack_clock") >= least_slack) & (F.col("drc") <= most_drc) & (F.col("shorts") <= most_shorts)
    )


def best_passing(metrics: DataFrame, fixed: str, value: str, least: bool) -> DataFrame:
    """Of the passing runs at each value of `fixed`, the one of the least (or greatest) `value`; ties by run."""
    good = metrics.where(passes(metrics))
    rank = F.struct(F.col(value) if least else -F.col(value), "run")
    return good.groupBy(fixed).agg(F.min_by("run", rank).alias("run"), (F.min(value) if least else F.max(value)).alias(value))


def split_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of keys shared out evenly over the active cells of the key: name, count."""
    n = F.count("*").over(Window.partitionBy("p_key"))
    active = cells.where("active").select("name", "p_key", n.alias("n"))
    return active.join(counts.select("p_key", "count"), "p_key").select("name", (F.col("count") / F.col("n")).alias("count"))


def with_rank(cells: DataFrame, ranks: DataFrame) -> DataFrame:
    """rank_norm of each cell's key, 1 where the key was not mined."""
    return cells.join(ranks.select("p_key", "rank_norm"), "p_key", "left").withColumn("rank_norm", F.coalesce("rank_norm", F.lit(1.0)))


def candidates_by_rank(cells: DataFrame, owned: DataFrame, ranks: DataFrame, least: int, most: int, k: int) -> DataFrame:
    """The k best ranked cells that are not owned, are logic of drive 1, have least..most inputs and a mined key; ties by name."""
    free = cells.join(owned.select("name"), "name", "left_anti").where(names.is_logic(F.col("name"))).where(F.col("name").endswith("_X1")).where(F.col("n_inputs").between(least, most))
    return free.join(ranks.select("p_key", "rank_norm"), "p_key").select("name", "p_key", "rank_norm").orderBy("rank_norm", "name").limit(k)


def without_features(ranks: DataFrame, cells: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """Cells of the k best ranked keys that have no features yet."""
    top = ranks.orderBy("rank_norm", "p_key").limit(k).select("p_key")
    return cells.join(top, "p_key", "left_semi").join(features.select("name"), "name", "left_anti").select("name", "p_key")


def preferred(cells: DataFrame, suffix: str) -> DataFrame:
    """For each key the cell to take: names with the suffix first, then fewest inputs, least area, name."""
    rank = F.struct((~F.col("name").endswith(suffix)).alias("other"), "n_inputs", "area", "name")
    return cells.groupBy("p_key").agg(F.min_by("name", rank).alias("name"))


def placed_macros(macros: DataFrame, masters: DataFrame) -> DataFrame:
    """Names that both the layout and the library have."""
    return macros.select("name").intersect(masters.select("name"))


def usable(cells: DataFrame, layouts: DataFrame, macros: DataFrame) -> DataFrame:
    """Cells with a layout that are in the macro list."""
    return cells.join(layouts.select("name"), "name", "left_semi").join(macros.select("name"), "name", "left_semi")


def append_missing(have: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """`have` and those rows of `more` whose key it lacks; both must have the same columns."""
    if set(have.columns) != set(more.columns):
        raise ValueError(f"columns differ: {sorted(set(have.columns) ^ set(more.columns))}")
    return have.unionByName(more.join(have.select(key), key, "left_anti"))


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Sets of cell names: union, intersect or except."""
    x, y = a.select("name"), b.select("name")
    if how == "union":
        return x.union(y).distinct()
    if how == "intersect":
        return x.intersect(y)
    if how == "except":
        return x.subtract(y)
    raise ValueError(f"unknown operation {how!r}")


def library_mapping(used: DataFrame, cells: DataFrame) -> DataFrame:
    """Each name with `exact` or `missing` against the library."""
    return used.select("name").distinct().join(cells.select("name").distinct().withColumn("hit", F.lit(True)), "name", "left").select(
        "name", F.when(F.col("hit"), "exact").otherwise("missing").alias("status")
    )


def vocabulary_agreement(left: DataFrame, right: DataFrame, most: float = 0.25) -> DataFrame:
    """One row: names on both sides, how many have different keys, their share, and whether it is within `most`."""
    both = left.select("name", F.col("p_key").alias("k1")).join(right.select("name", F.col("p_key").alias("k2")), "name")
    out = both.agg(F.count("*").alias("n"), F.count(F.when(F.col("k1") != F.col("k2"), 1)).alias("differ"))
    share = F.when(F.col("n") > 0, F.col("differ") / F.col("n")).otherwise(0.0)
    return out.select("n", "differ", F.round(share, 6).alias("share"), (share <= most).alias("ok"))
