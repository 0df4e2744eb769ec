"""A table in parts, of which a new version writes only those whose input has changed.

A folder holds `data/version=N` (rows of the parts that version N computed) and
`manifest/version=N` (for every part its input's digest and the version that has its
rows).  A version is there once its manifest is, which is written elsewhere and then
renamed; a run that fails leaves the version before it, and is repeated by the next one.
Reading joins the rows with the manifest, so a version that nothing refers to is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, folder: str) -> int:
    """Number of the newest complete version, 0 if there is none."""
    path, files = _file_system(spark, folder)
    at = path(f"{folder}/manifest")
    if not files.exists(at):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """part, digest, written (the version with the part's rows)."""
    number = version(spark, folder) if number is None else number
    if not number:
        return spark.createDataFrame([], "part string, digest string, written int")
    return spark.read.parquet(f"{folder}/manifest/version={number}").select("part", "digest", "written")


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default, with their part."""
    held = manifest(spark, folder, number)
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").withColumnRenamed("version", "written")
    return rows.join(held.select("part", "written"), ["part", "written"]).drop("written")


def digests(rows: DataFrame, part: str) -> DataFrame:
    """(part, digest) of a table's parts: the number of rows and two sums of their hashes, whatever their order; columns must not hold maps."""
    columns = [F.col(c) for c in rows.columns]
    wide = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return rows.groupBy(F.col(part).cast("string").alias("part")).agg(
        F.concat_ws(":", F.count("*").cast("string"), wide(F.xxhash64(*columns)), wide(F.xxhash64(F.lit(1), *columns))).alias("digest")
    )


def changed(spark: SparkSession, folder: str, inputs: DataFrame) -> DataFrame:
    """The rows of inputs (part, digest) whose digest is new."""
    held = manifest(spark, folder).select("part", "digest")
    return inputs.select("part", "digest").distinct().join(held, ["part", "digest"], "left_anti")


def refresh(spark: SparkSession, folder: str, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], whole: bool = True) -> int:
    """Make the next version from inputs (part, digest) and return its number, or the present one if nothing has changed.

    `compute` gets the parts (part) to make and returns their rows with their part.  Parts that inputs no longer name
    leave the table, unless `whole` is false.  A part has one digest; two raise.
    """
    now = version(spark, folder)
    held = manifest(spark, folder, now)
    inputs = inputs.groupBy("part").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).select(
        "part", F.when(F.col("digest") == F.col("other"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("two digests of "), "part")).cast("string")).alias("digest")
    )
    fresh = inputs.join(held.select("part", "digest"), ["part", "digest"], "left_anti")
    gone = held.join(inputs, "part", "left_anti")
    if fresh.isEmpty() and (not whole or gone.isEmpty()):
        return now
    compute(fresh.select("part")).write.mode("overwrite").parquet(f"{folder}/data/version={now + 1}")
    kept = held.join(fresh.select("part"), "part", "left_anti")
    kept = kept.join(inputs.select("part"), "part", "left_semi") if whole else kept
    aside = f"{folder}/manifest/making-{uuid.uuid4().hex}"
    kept.select("part", "digest", "written").union(fresh.select("part", "digest", F.lit(now + 1))).write.parquet(aside)
    path, files = _file_system(spark, folder)
    if not files.rename(path(aside), path(f"{folder}/manifest/version={now + 1}")):
        raise RuntimeError(f"version {now + 1} of {folder} is there already")
    return now + 1
