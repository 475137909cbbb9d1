"""Newly arrived documents against all that came before, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

from bidscreen.operators import fields
from bidscreen.profile import Profile


def overlaps_with_history(new: DataFrame, history: DataFrame) -> DataFrame:
    """Exact field overlaps of new documents with each other and with those of history, both as key fields."""
    old = history.join(new.select("task_id").distinct(), "task_id", "left_semi")
    both = fields.exact_overlaps(old.unionByName(new).distinct())
    fresh = new.select("task_id", "doc_id").distinct()
    touched = both.join(fresh.withColumnRenamed("doc_id", "doc_a"), ["task_id", "doc_a"], "left_semi").unionByName(both.join(fresh.withColumnRenamed("doc_id", "doc_b"), ["task_id", "doc_b"], "left_semi"))
    return touched.distinct()


def screen_arrivals(spark: SparkSession, source: str, schema: StructType, history: str, found: str, profile: Profile) -> DataStreamWriter:
    """A stream over Parquet files of documents (task_id, doc_id, doc_ord, text) that land in `source`.

    Each micro-batch writes its overlaps to `found` and its key fields to `history`, both in a folder of
    the batch's number, so a batch that is run again replaces what it wrote. Start it with a checkpoint.
    """

    def batch(docs: DataFrame, number: int) -> None:
        new = fields.extract(docs, profile)
        mine = f"{history}/batch={number}"
        new.write.mode("overwrite").parquet(mine)
        new = spark.read.schema(new.schema).parquet(mine)
        earlier = spark.read.schema(StructType([*new.schema.fields, StructField("batch", LongType())])).option("basePath", history).parquet(history)
        old = earlier.where(F.col("batch") < number).drop("batch")
        overlaps_with_history(new, old).write.mode("overwrite").parquet(f"{found}/batch={number}")

    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(batch)
