"""Line-oriented scans: pattern blocks, overlap lines, tables, logs and reports; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netmine.sources import ranges

#: Pairs of clusters that one task counts.
PAIRED = 1 << 18


def numbered(files: DataFrame) -> DataFrame:
    """path, line number from 0, line; of files read whole."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))


def by_ranges(source: DataFrame) -> DataFrame:
    """Lines by ranges (path, block, at, value) as they are, or those of whole texts (path, text)."""
    return source if "value" in source.columns else ranges.of_texts(source)


def carried(rows: DataFrame, name: Column, into: str) -> DataFrame:
    """The rows (path, block, at, ...) with the last non-null `name` up to each: last inside its range, else of the ranges before it.

    The second look has one row for each range.
    """
    marked = rows.withColumn("__own", name)
    ends = marked.groupBy("path", "block").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("at"))).alias("__end"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("path", "block", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    inside = F.last("__own", ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("at"))
    found = marked.withColumn("__in", inside).join(before, ["path", "block"])
    return found.withColumn(into, F.coalesce("__in", "__before")).drop("__own", "__in", "__before")


def pattern_blocks(source: DataFrame) -> DataFrame:
    """canonical, cluster, cells from `canonical_key=` headers and `clst<N>: ids` lines; other lines are ignored."""
    head, member = F.regexp_extract("value", r"canonical_key=(\S+)", 1), F.col("value").rlike(r"^\s*clst\d+\s*:")
    rows = by_ranges(source).where(member | (head != ""))
    members = carried(rows, F.when(head != "", head), "canonical").where(member)
    ids = F.transform(F.regexp_extract_all(F.split_part("value", F.lit(":"), F.lit(2)), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return members.select("path", "canonical", F.regexp_extract("value", r"(clst\d+)", 1).alias("cluster"), ids.alias("cells"))


def overlap_lines(source: DataFrame, mode: str = "pairs") -> DataFrame:
    """a, b from lines of cluster names: the first with each other (star), or every two (pairs)."""
    if mode not in ("star", "pairs"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = by_ranges(source).where(~F.col("value").startswith("#")).select(F.regexp_extract_all("value", F.lit(r"(clst\d+)"), 1).alias("c")).where(F.size("c") > 1)
    if mode == "star":
        return rows.select(F.element_at("c", 1).alias("a"), F.explode(F.slice("c", 2, F.size("c"))).alias("b"))
    one = rows.select("c", F.posexplode("c").alias("i", "a"))
    return one.select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))


def overlap_counts(source: DataFrame, modes: tuple[str, ...] = ("star", "pairs")) -> DataFrame:
    """mode, a, b, n: how many lines give each pair.  Pairs are dealt out before they are counted, about PAIRED to a task, however many a range gives."""
    rows = by_ranges(source)
    both = [overlap_lines(rows, m).select(F.lit(m).alias("mode"), "a", "b") for m in modes]
    k = F.size(F.regexp_extract_all("value", F.lit(r"(clst\d+)"), 1)).cast("long")
    most = rows.agg(F.sum(k * (k - 1))).first()[0] or 0
    dealt = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // PAIRED))
    return reduce(DataFrame.union, both).repartition(dealt, "mode", "a", "b").groupBy("mode", "a", "b").agg(F.count("*").alias("n"))


def table(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A headed text table under a stated schema; a wrong header or value raises."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").options(**options).csv(path)


#: Words of the netlist language that begin a line like an instance does.
RESERVED = (
    "module endmodule input output inout wire reg assign always begin end if else case endcase parameter localparam integer supply0 supply1 tri "
    "posedge negedge initial generate endgenerate function task"
).split()


def cell_counts(source: DataFrame, suffix: str = "") -> DataFrame:
    """Instances of each cell type, from the first word of lines that look like instances; a given ending of names is dropped."""
    name = F.regexp_extract("value", r"^\s*([A-Za-z_]\w*)\s+\w", 1)
    rows = by_ranges(source).select("path", name.alias("cell")).where((F.col("cell") != "") & ~F.lower("cell").isin(RESERVED))
    if suffix:
        rows = rows.withColumn("cell", F.when(F.col("cell").endswith(suffix), F.expr(f"left(cell, length(cell) - {len(suffix)})")).otherwise(F.col("cell")))
    return rows.groupBy("path", "cell").agg(F.count("*").alias("cnt"))


def quality(files: DataFrame) -> DataFrame:
    """path, slack_in2reg, freq_mhz, slack_clock from the `Summary,` line, cell_area from the line after `CAP, FANOUT`; null where absent."""
    fields = F.transform(F.split("line", ","), lambda x: F.trim(x))
    one = numbered(files).where(F.col("line").startswith("Summary,")).groupBy("path").agg(F.min_by(fields, "no").alias("f"))
    number = lambda i: F.expr(f"try_cast(replace(f[{i}], 'MHz', '') AS double)")
    area = next_line(files, "CAP, FANOUT").groupBy("path").agg(F.min("fields").alias("g"))
    return one.join(area, "path", "left").select("path", number(1).alias("slack_in2reg"), number(4).alias("freq_mhz"), number(5).alias("slack_clock"), F.expr("try_cast(g[4] AS double)").alias("cell_area"))


def violations(files: DataFrame) -> DataFrame:
    """path, total, shorts of rule reports: the number on the last `Design :` line, and on the last `Short` line indented by twelve; `No DRCs to report` is 0, 0."""
    total, short = F.regexp_extract("line", r"^Design\s*:\s*\S+\s+(\d+)", 1), F.regexp_extract("line", r"^\s{12}Short\s+(\d+)", 1)
    last = lambda x: F.max_by(F.when(x != "", x.cast("int")), F.when(x != "", F.col("no")))
    none = F.bool_or(F.col("line").contains("No DRCs to report"))
    out = numbered(files).groupBy("path").agg(last(total).alias("t"), last(short).alias("s"), none.alias("none"))
    return out.select("path", F.when(F.col("t").isNotNull(), F.col("t")).when(F.col("none"), 0).alias("total"), F.when(F.col("t").isNotNull(), F.coalesce("s", F.lit(0))).when(F.col("none"), 0).alias("shorts"))


def next_line(files: DataFrame, header: str) -> DataFrame:
    """path, fields of the line after each line that starts with the header."""
    order = Window.partitionBy("path").orderBy("no")
    rows = numbered(files).withColumn("after", F.lead("line").over(order))
    return rows.where(F.trim("line").startswith(header)).select("path", F.transform(F.split("after", ","), lambda x: F.trim(x)).alias("fields"))


def first_tag(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """path, number, tag of lines that start with `Error:`; the first rule (tag, pattern) that matches, else other."""
    tag = F
    for name, pattern in rules:
        tag = tag.when(F.col("line").rlike(pattern), name)
    return numbered(files).where(F.col("line").startswith("Error:")).select("path", "no", tag.otherwise("other").alias("tag"))


def error_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("path", "tag").agg(F.count("*").alias("n"))


def properties(files: DataFrame) -> DataFrame:
    """path, key, value of `key=value` lines."""
    return numbered(files).where(F.col("line").rlike(r"^\s*[\w.]+\s*=")).select(
        "path", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key"), F.trim(F.regexp_extract("line", r"=(.*)$", 1)).alias("value")
    )


def wide_report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row a step, a column for each metric; metrics: step, metric, value."""
    return metrics.groupBy("step").pivot("metric", names).agg(F.first("value"))


def stage_summary(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row for each step with a column for each metric: the first match of its pattern in the step's reports (path .../<step>/<report>)."""
    step = F.element_at(F.split("path", "/"), -2)
    found = F.coalesce
    one = files.select(step.alias("step"), "path", *[F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias(m) for m, p in patterns])
    return one.groupBy("step").agg(*[F.min_by(F.col(m), F.when(found(F.col(m), F.lit("")) != "", F.col("path"))).alias(m) for m, _ in patterns])
