"""Incremental arrival of run payloads: a file stream upserted into a keyed table.

The batch engine has no streams of its own; what it does have is an upsert of
new rows into a snapshot and a wait for new files.  Both map to one Structured
Streaming query: files arrive, each micro-batch keeps its newest row of a key and
is merged into the next version of the table.  The table is in parts by a hash of
the key; a version writes the parts that its batch touches and refers to the
others.  A batch that is run again after a failure finds its number in the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from netmine.operators.features import upsert
from netmine.sinks import versions

#: Parts of a table; a batch with few keys rewrites few of them.
PARTS = 64


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("string")


def merge_version(spark: SparkSession, target: str, key: str, order: str, batch: DataFrame, number: int, parts: int = PARTS) -> None:
    """The table with the newest rows of micro-batch `number`, as its next version; a batch that is in it already changes nothing."""
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").withColumn("part", part_of(key, parts))
    mark = f"batch {number}"
    if versions.manifest(spark, target).where(F.col("digest") == mark).count():
        return

    def compute(touched: DataFrame) -> DataFrame:
        if not versions.version(spark, target):
            return newest
        return upsert(versions.read(spark, target).join(touched, "part", "left_semi").select(*newest.columns), newest, key)

    versions.refresh(spark, target, newest.select("part", F.lit(mark).alias("digest")).distinct(), compute, whole=False)


def follow(spark: SparkSession, source: str, schema: StructType, target: str, key: str, order: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Everything that is in `source` now, in micro-batches, and then stop; call again for what came later."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, number: merge_version(spark, target, key, order, df, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, target: str) -> DataFrame:
    return versions.read(spark, target).drop("part")
