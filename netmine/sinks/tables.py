"""Sinks: tables as Parquet, block and line text, CSV, JSON; point lookups over what was written.

Bounded reports (one row for each function class, component or candidate) may be one
file; tables of clusters and cells stay as many files as they have partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netmine.functions import names


def write_database(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Each table as Parquet under path/name; strings are dictionary-encoded by the format."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_database(spark: SparkSession, path: str, expected: dict[str, str]) -> dict[str, DataFrame]:
    """Tables written by write_database with stated columns; a missing column raises, one of a newer writer is left out."""
    out = {}
    for name, ddl in expected.items():
        df = spark.read.parquet(f"{path}/{name}")
        wanted = [c.split()[0] for c in ddl.split(", ")]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        out[name] = df.select(wanted)
    return out


def frequency_lines(rows: DataFrame) -> DataFrame:
    """`n_outputs,label,key,count,expr` for each pattern, count and expression quoted as CSV asks."""
    return rows.select(
        F.concat_ws(",", F.col("n_outputs").cast("string"), names.csv_quote(F.col("label")), names.csv_quote(F.col("p_key")), names.format_count(F.col("count").cast("double")), names.csv_quote(F.coalesce("expr", F.lit("")))).alias("value")
    )


def instance_blocks(clusters: DataFrame) -> DataFrame:
    """A block of text for each (key): header, count, then every cluster's cells, inputs and table.

    One row for each cluster would need an order over all; a block holds the clusters of one key, which may be many,
    so a row is a cluster's lines with its key, and the writer deals them out by key.
    """
    return clusters.select(
        F.concat(F.lit("0b"), F.regexp_replace("p_key", "^0b", "")).alias("p_key"), "cluster",
        F.concat(
            F.lit("clst"), F.col("cluster").cast("string"), F.lit(": "), F.array_join(F.array_sort("cells").cast("array<string>"), " "),
            F.when(F.col("inputs").isNotNull(), F.concat(F.lit("\ninputs: "), F.array_join("inputs", " "))).otherwise(""),
            F.when(F.col("tt").isNotNull(), F.concat(F.lit("\ntruth_table: "), F.col("tt"))).otherwise(""),
        ).alias("value"),
    )


def write_instances(clusters: DataFrame, path: str) -> None:
    """Text files, the clusters of a key together and in order below a header line `canonical_key=...` and `count=...`."""
    rows = instance_blocks(clusters)
    heads = rows.groupBy("p_key").agg(F.count("*").alias("n")).select("p_key", F.lit(None).cast("long").alias("cluster"), F.concat(F.lit("canonical_key="), F.col("p_key"), F.lit("\ncount="), F.col("n").cast("string")).alias("value"))
    every = rows.select("p_key", F.col("cluster").cast("long").alias("cluster"), "value").union(heads)
    every.repartition("p_key").sortWithinPartitions("p_key", F.col("cluster").asc_nulls_first()).select("value").write.text(path)


def overlap_lines(components: DataFrame) -> DataFrame:
    """A line of sorted cluster names for each component of two and more."""
    many = components.groupBy("component").agg(F.array_sort(F.collect_list("cluster")).alias("l")).where(F.size("l") > 1)
    return many.select(F.array_join(F.transform("l", lambda x: F.concat(F.lit("clst"), x.cast("string"))), " ").alias("value"))


def subset_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.format_string("clst%d clst%d", "sub", "sup").alias("value"))


def cell_map_lines(cells: DataFrame) -> DataFrame:
    """`id,name,master,x,y` with NaN for what is not placed."""
    place = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "NaN").otherwise(names.format_count(F.col(c)))
    return cells.select(F.concat_ws(",", F.col("id").cast("string"), names.csv_quote(F.col("name")), names.csv_quote(F.coalesce("master", F.lit("UNKNOWN"))), place("x"), place("y")).alias("value"))


#: Fixed value: the header of the table of selected candidates.
SELECTED = ["master_cell", "source_master_cell", "candidate_pattern", "canonical_key", "logic_expr", "count", "selected_area", "selected_lib"]


def write_selected(rows: DataFrame, path: str) -> None:
    """Selected candidates as one CSV file (a top-k report)."""
    lacking = [c for c in SELECTED if c not in rows.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    rows.select([names.format_count(F.col(c).cast("double")).alias(c) if c == "selected_area" else F.col(c) for c in SELECTED]).coalesce(1).write.option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Every row as one JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def constraint_lines(patterns: DataFrame) -> DataFrame:
    """Text that leaves all cells out and takes the given patterns back in, with a guard for patterns that match nothing."""
    head = patterns.sparkSession.createDataFrame([(0, "set_lib_cell_purpose -exclude all [get_lib_cells */*]")], "n long, value string")
    body = patterns.select(
        F.lit(1).cast("long").alias("n"),
        F.format_string(
            'set _c [get_lib_cells -quiet {*/%s}]\nif {[sizeof_collection $_c] == 0} { error "no cell matches %s" }\nset_lib_cell_purpose -include all $_c',
            "pattern", "pattern",
        ).alias("value"),
    )
    return head.union(body)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one id; the filter reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.union(df)
    return out
