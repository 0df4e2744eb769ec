"""Feature tables: timing statistics, normalisation, ranks, roles, softmax, the feature graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(order: Window, descending_share: bool = False, alone: float = 0.0) -> Column:
    """Position / (N - 1) over a finite set of types, or one minus that; `alone` if there is one row."""
    n = F.count("*").over(Window.partitionBy())
    share = (F.row_number().over(order) - 1) / (n - 1)
    return F.when(n == 1, F.lit(alone)).otherwise(F.round(1 - share if descending_share else share, 6))


def timing_stats(samples: DataFrame) -> DataFrame:
    """samples: kind, path, value, failing.  Only positive values count; none gives 0."""
    paths = samples.select("path").distinct().agg(F.count("*").alias("all_paths"))
    positive = F.when(F.col("value") > 0, F.col("value"))
    stats = samples.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.avg(positive), F.lit(0.0)), 6).alias("avg_value"), F.coalesce(F.min(positive), F.lit(0.0)).alias("min_value"),
        F.coalesce(F.max(positive), F.lit(0.0)).alias("max_value"), F.countDistinct("path").alias("through"),
        F.countDistinct(F.when(F.col("failing"), F.col("path"))).alias("failed"), F.min("value").alias("worst"),
    )
    out = stats.join(F.broadcast(paths)).select(
        "kind", "n", "avg_value", "min_value", "max_value", F.round(F.col("failed") / F.col("through"), 6).alias("violation_ratio"),
        F.round(F.col("through") / F.col("all_paths"), 6).alias("path_coverage"), "worst",
    )
    return out.withColumn("worst_rank", ranked(Window.orderBy("worst", "kind"), alone=0.5))


def z_score(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column less its mean over its population deviation (1 if that is below 1e-8); one aggregate row is joined back."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    scaled = lambda c: F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")), 6)
    return joined.select(key, *[scaled(c).alias(f"z_{c}") for c in columns])


def role(in_a: Column, in_b: Column) -> list[Column]:
    """Three columns of which one is 1; a cell on neither side raises."""
    lost = F.raise_error(F.lit("a cell of neither library")).cast("int")
    return [
        F.when(in_a | in_b, (in_a & ~in_b).cast("int")).otherwise(lost).alias("only_a"), (in_a & in_b).cast("int").alias("both"), (~in_a & in_b).cast("int").alias("only_b")
    ]


def masked_softmax(rows: DataFrame, group: str, score: str, mask: str) -> DataFrame:
    w = Window.partitionBy(group)
    x = F.when(F.col(mask), F.col(score))
    e = F.exp(x - F.max(x).over(w))
    return rows.select("*", F.round(F.coalesce(e / F.sum(e).over(w), F.lit(0.0)), 6).alias("softmax"))


def label_norm(rows: DataFrame, group: str, value: str, mask: str) -> DataFrame:
    total = F.sum(F.when(F.col(mask), F.col(value))).over(Window.partitionBy(group))
    return rows.select("*", F.when(F.coalesce(total, F.lit(0.0)) <= 1e-9, 0.0).otherwise(F.round(F.col(value) / total, 6)).alias("label"))


def graph_edges(nodes: DataFrame, mining: DataFrame, ratio: DataFrame, saved) -> DataFrame:
    """nodes: name, p_key, np_key, inv_in, inv_out; mining: p_key, name, m1, m2; ratio: key_a, key_b, overlap_ratio.

    Seven attributes for each ordered pair of cell types whose class is equal or one of whose three mined weights is not 0.
    Each of these four conditions gives its pairs by an equi-join; other pairs are never made.
    """
    mining, ratio = saved(mining.where("m1 <> 0 OR m2 <> 0").toDF("d_p_key", "s_name", "m1", "m2")), saved(ratio.where("overlap_ratio <> 0").toDF("d_p_key", "s_p_key", "overlap"))
    d = nodes.select(*[F.col(c).alias(f"d_{c}") for c in nodes.columns])
    s = nodes.select(*[F.col(c).alias(f"s_{c}") for c in nodes.columns])
    own, other = d.select("d_name", "d_p_key", "d_np_key"), s.select("s_name", "s_p_key", "s_np_key")
    met = (
        own.join(other, own["d_np_key"] == other["s_np_key"]).select("d_name", "s_name")
        .union(own.join(mining, "d_p_key").join(other.select("s_name"), "s_name").select("d_name", "s_name"))
        .union(own.join(ratio, "d_p_key").join(other, "s_p_key").select("d_name", "s_name"))
    ).where("d_name <> s_name").distinct()
    joined = met.join(d, "d_name").join(s, "s_name").join(mining, ["d_p_key", "s_name"], "left").join(ratio, ["d_p_key", "s_p_key"], "left")
    same = F.col("d_np_key") == F.col("s_np_key")
    zero = F.lit(0.0)
    return joined.select(
        F.col("d_name").alias("dst"), F.col("s_name").alias("src"), (F.col("d_p_key") == F.col("s_p_key")).cast("int").alias("same_key"), same.cast("int").alias("same_class"),
        F.coalesce("m1", zero).alias("m1"), F.coalesce("m2", zero).alias("m2"), F.coalesce("overlap", zero).alias("overlap"),
        F.when(same, F.abs(F.col("d_inv_in") - F.col("s_inv_in"))).otherwise(0).alias("d_in"), F.when(same, F.abs(F.col("d_inv_out") - F.col("s_inv_out"))).otherwise(0).alias("d_out"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("k")).select(F.lit("out").alias("side"), "k")
    into = edges.groupBy("dst").agg(F.count("*").alias("k")).select(F.lit("in").alias("side"), "k")
    return out.union(into).groupBy("side").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    o = old.select(F.col(key).alias("ko"), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key).alias("kn"), F.struct(*old.columns).alias("n"))
    return o.join(n, F.col("ko") == F.col("kn"), "full").select(F.coalesce("n", "o").alias("r")).select("r.*")
