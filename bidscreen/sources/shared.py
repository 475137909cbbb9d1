"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and is a local one, as in tests, a folder of this machine is set: executors
    of a cluster would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the driver and the executors of {master or 'the cluster'} share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether Spark removes a statement's shuffle files as soon as it ends, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what is written leaves no shuffle files behind. For tables that are read back: a frame that is collected
    again would have to shuffle again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `written` has written within it: to be held around a query and the use of its result.

    Within another one, each deletes its own. Tables that nobody owns stay, since a DataFrame that is read later needs them.
    """
    paths: list[str] = []
    before = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(before)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, folder_by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet and read back: what several plans need is computed once, and outlives lost executors. Rows
    of equal folder_by columns, where given, stand in a folder of their own, which a filter reads alone. The shuffle files of
    the write are removed with its end, so disk holds those of one step and not of all."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    with shuffles_removed(spark):
        df.write.partitionBy(*folder_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
