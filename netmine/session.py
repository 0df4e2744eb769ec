"""Session settings, table access, and cuts of lineage in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def tuned(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with adaptive planning and skew handling; sizes are left to the cluster."""
    builder = builder or SparkSession.builder
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`.

    A session on one machine (tests) that has none gets a temporary folder; on a cluster that is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="netmine-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of which the planner still knows how its rows are dealt out and sorted.

    An adaptive plan doesn't tell that before it has run, so this one is planned without; the setting is put back.
    """
    spark = df.sparkSession
    folder, sc = shared_folder(spark), spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


#: Folders written in the innermost scope of this thread of work; those outside of any go when the driver ends.
_written: contextvars.ContextVar[list[str]] = contextvars.ContextVar("written")
_left: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `saved` writes inside is deleted at the end: write a query's result inside, since it is read from there."""
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for path in mine:
            delete(spark, path)


def _clean(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session's JVM may have ended before
        for path in _left:
            delete(spark, path)


def _note(spark: SparkSession, path: str) -> None:
    held = _written.get(None)
    if held is None:
        if not _left:
            atexit.register(_clean, spark)
        held = _left
    held.append(path)


def saved(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back, so that sizes are those of files.

    In a loop a checkpoint would keep the estimates of the plans that it came from, which multiply
    each round.  `instead` is an earlier result of this function that nothing needs any more.  The folder goes at the
    end of the `scratch` around the call, or else with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    _note(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if instead is not None:
        delete(spark, instead._saved_at)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
