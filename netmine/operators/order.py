"""Global order without one ordered task: ranks and running sums over range partitions.

Rows are dealt out by ranges of the order (bounds that Spark samples), sorted inside
each partition and written once, so that a second look at them sees the same
partitions.  A row's place inside its partition comes from the id that the sort
leaves; what all partitions before it hold is added as an offset.  The only thing
that reaches the driver is one row for each partition.

Rows that tie in `by` keep an arbitrary but fixed order among them; equal keys never
lie on both sides of a border unless `spread` adds a digest of the row to the order,
which splits a key that a great part of all rows share.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netmine.session import saved

#: `monotonically_increasing_id` holds the partition above this bit and the place below it.
_PLACE_BITS = 33


def _ranged(rows: DataFrame, by: list[Column], partitions: int | None, spread: bool) -> DataFrame:
    """The rows with `__at`, ascending in the order, dense inside each partition; written."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = by + [F.xxhash64(*[F.col(c) for c in rows.columns])] if spread else by
    return saved(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at")))


def _before(parts: list, columns: list[str], zero=0) -> list[tuple]:
    """(partition, sums of each column over the partitions before it)."""
    out, held = [], [zero] * len(columns)
    for row in sorted(parts, key=lambda r: r["__part"]):
        out.append((row["__part"], *held))
        held = [h + (row[c] or 0) for h, c in zip(held, columns)]
    return out


def numbered(rows: DataFrame, by: list[Column], name: str = "rank_no", total: str | None = None, partitions: int | None = None, spread: bool = False) -> DataFrame:
    """The rows with their number from 0 in the order `by`, and in `total` the number of all rows.

    One shuffle by range, no window.  An empty table stays empty.
    """
    at = _ranged(rows, by, partitions, spread).withColumn("__part", F.shiftright("__at", _PLACE_BITS))
    parts = at.groupBy("__part").agg(F.count("*").alias("n")).collect()
    offsets = rows.sparkSession.createDataFrame(_before(parts, ["n"]), "__part bigint, __before bigint")
    place = F.col("__before") + F.col("__at") - F.shiftleft("__part", _PLACE_BITS)
    out = at.join(F.broadcast(offsets), "__part").select(*rows.columns, place.alias(name))  # one row for each partition
    return out.withColumn(total, F.lit(sum(p["n"] for p in parts)).cast("long")) if total else out


def running(rows: DataFrame, by: list[Column], sums: dict[str, str], partitions: int | None = None, spread: bool = False) -> DataFrame:
    """The rows with, for each `new: column` of `sums`, the sum of the integer column over all rows before this one, as decimal(38,0).

    Each partition's own running sums come from a window over that partition.
    """
    at = _ranged(rows, by, partitions, spread)
    with_part = at.select("*", F.shiftright("__at", _PLACE_BITS).alias("__part"))
    columns = list(sums.values())
    parts = with_part.groupBy("__part").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns]).collect()
    offsets = rows.sparkSession.createDataFrame(
        _before(parts, columns, Decimal(0)), "__part bigint, " + ", ".join(f"`__before_{i}` decimal(38,0)" for i in range(len(columns)))
    )
    inner = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    joined = with_part.select(
        *rows.columns, "__part", *[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")).over(inner), zero).alias(f"__in_{i}") for i, c in enumerate(columns)]
    ).join(F.broadcast(offsets), "__part")  # one row for each partition
    return joined.select(*rows.columns, *[(F.col(f"__in_{i}") + F.col(f"__before_{i}")).cast("decimal(38,0)").alias(new) for i, new in enumerate(sums)])
