"""Sinks: chunk upserts, task deletion, and reports as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscreen.sources.shared import shuffles_removed


def upsert(current: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("task_id", "chunk_id"), version: str = "version") -> DataFrame:
    """current and new rows with the last version of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return current.unionByName(new).withColumn("_n", last).where("_n = 1").drop("_n")


def write_partitions(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the tasks in df and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)


def without_tasks(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of other tasks than the deleted ones; the same for tasks, documents, chunks and pairs."""
    return table.join(deleted.select("task_id").distinct(), "task_id", "left_anti")


def write_json(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines by task; nulls are kept."""
    reports.withColumn("task", F.col("task_id")).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("task").json(path)


def write_report(lines: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """Report lines (task_id, kind, place, body) as JSON lines in files of at most max_rows, each of a range of (task_id,
    kind, place), and an index of what each file has. A task of any size spans as many files as it needs.

    The index is written last: without it there is no report.
    """
    head = F.to_json(F.struct("task_id", "kind", "place"), {"ignoreNullFields": "false"})
    line = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"body":'), F.coalesce("body", F.lit("null")), F.lit("}"))
    by = ["task_id", "kind", "place"]
    with shuffles_removed(lines.sparkSession):
        lines.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("head", head).select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", max_rows).text(f"{path}/pieces")
    rows = lines.sparkSession.read.schema(_LINE).json(f"{path}/pieces").select("task_id", "kind", "place", F.col("_metadata.file_name").alias("file"))
    index = rows.groupBy("file", "task_id", "kind").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    index.write.mode("overwrite").parquet(f"{path}/index")


_LINE = "task_id string, kind string, place bigint, body string"


def read_report(spark: SparkSession, path: str, task_id: str | None = None, kind: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """Lines of a written report; of one task, one kind, and places from first to last, where given: only files that have such lines are read."""
    index = spark.read.parquet(f"{path}/index")
    rows = spark.read.schema(_LINE)
    wanted = F.lit(True) if task_id is None else F.col("task_id") == task_id
    wanted &= F.lit(True) if kind is None else F.col("kind") == kind
    if task_id is None and kind is None:
        found = rows.json(f"{path}/pieces")
    else:
        here = (F.col("last") >= first) & (F.lit(True) if last is None else F.col("first") <= last)
        files = [f"{path}/pieces/{r.file}" for r in index.where(wanted & here).select("file").distinct().collect()]
        found = rows.json(files) if files else spark.createDataFrame([], _LINE)
    return found.where(wanted & (F.col("place") >= first) & (F.lit(True) if last is None else F.col("place") <= last))


def csv_rows(pairs: DataFrame) -> DataFrame:
    """The fifteen columns of the pair list: texts cut to 200 characters, defaults for what is missing."""
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in pairs.columns else F.lit(default)
    cut = lambda c: F.substring(c, 1, 200)
    return pairs.where("risk_level != 'none'").select(
        "pair_id", "risk_level", given("risk_type", "normal_overlap").alias("risk_type"), "final_score", F.round("similarity", 4).alias("vector_similarity"), F.round("keyword_overlap", 4).alias("keyword_overlap"),
        F.col("section_title_a").alias("doc_a_section"), F.col("page_num_a").alias("doc_a_page"), cut("text_a").alias("doc_a_text"),
        F.col("section_title_b").alias("doc_b_section"), F.col("page_num_b").alias("doc_b_page"), cut("text_b").alias("doc_b_text"),
        given("reason_zh", "").alias("reason_zh"), given("suggest_action", "").alias("suggest_action"), given("confidence", 0.0).alias("confidence"),
    )


def write_csv(pairs: DataFrame, path: str) -> None:
    with shuffles_removed(pairs.sparkSession):
        csv_rows(pairs).write.mode("overwrite").option("header", "true").options(quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv has written; texts may hold quotes and line breaks."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
