"""Boilerplate: chunks that cite what everyone cites, by pattern or by closeness to known phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; no pattern finds nothing."""
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def close_to_phrases(chunks: DataFrame, phrases: DataFrame, threshold: float = 0.88, max_phrases: int = 10_000, max_bytes: int = 1 << 28) -> DataFrame:
    """chunk_id of chunks (chunk_id, embedding) whose best cosine to a phrase (embedding) reaches the threshold.

    Phrases are a curated list: their matrix is sent to the tasks once, beside the plan, which has the same size for any
    list; beyond max_phrases or max_bytes an error is raised rather than a list of any size sent out. Tasks multiply
    batches of vectors with it. Vectors that are null, hold nulls or have another length are close to nothing.
    """
    listed = [r["embedding"] for r in phrases.where("embedding IS NOT NULL").select("embedding").limit(max_phrases + 1).collect()]
    if len(listed) > max_phrases:
        raise ValueError(f"more than {max_phrases} phrases")
    if not listed:
        return chunks.select("task_id", "chunk_id").limit(0)
    if len({len(v) for v in listed}) > 1:
        raise ValueError("phrases of several lengths")
    matrix = np.array(listed, np.float64).T
    if matrix.nbytes > max_bytes:
        raise ValueError(f"phrases take more than {max_bytes} bytes")
    sent, dims = chunks.sparkSession.sparkContext.broadcast(matrix), len(listed[0])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            whole = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1)) == dims
            at = np.flatnonzero(whole)
            values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            for begin in range(0, len(at), 1024):  # a null component is not a number, and so is its product
                at[begin : begin + 1024][~((values[begin : begin + 1024] @ sent.value).max(axis=1) >= threshold)] = -1
            yield batch.select([0, 1]).take(pa.array(at[at >= 0]))

    kinds = dict(chunks.dtypes)
    return chunks.select("task_id", "chunk_id", "embedding").mapInArrow(keep, f"task_id {kinds['task_id']}, chunk_id {kinds['chunk_id']}")


def mark(chunks: DataFrame, patterns: list[str], close: DataFrame | None = None) -> DataFrame:
    """Adds is_whitelisted; no chunk is removed. close(task_id, chunk_id) come from close_to_phrases."""
    plain = by_pattern(F.col("text"), patterns)
    if close is None:
        return chunks.withColumn("is_whitelisted", plain)
    near = close.distinct().withColumn("_close", F.lit(True))
    return chunks.join(near, ["task_id", "chunk_id"], "left").withColumn("is_whitelisted", plain | F.coalesce("_close", F.lit(False))).drop("_close")
