"""Dense vectors: cells around pivots, skipped pairs of cells, and all pairs over the threshold; phrases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidscreen.operators import similarity, whitelist

SCHEMA = "task_id string, doc_id long, chunk_id long, embedding array<float>"


def clustered(n, centres, spread, seed, dims=16):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] / 4 + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows(spark, x, task="t", more=()):
    return spark.createDataFrame([(task, int(i % 7), int(i), [float(v) for v in row]) for i, row in enumerate(x)] + list(more), SCHEMA)


def brute(x, at_least):
    s = x @ x.T
    return {(i, j) for i, j in zip(*np.nonzero(s >= at_least), strict=True) if i % 7 != j % 7}


@pytest.mark.parametrize("block", [16, 100, 5000])
@pytest.mark.parametrize("scale", [1.0, 3.0])
def test_all_pairs_are_found(spark, block, scale):
    x = (clustered(600, 12, 0.08, 1) * np.random.default_rng(2).uniform(0.5, scale, (600, 1))).astype(np.float32).astype(float)
    df = rows(spark, x, more=[("t", 1, 9000, None), ("t", 1, 9001, [None] * 16), ("alone", 1, 1, [1.0] * 16)])
    got = similarity.vector_pairs(df, 0.8, block).collect()
    assert {(r.chunk_q, r.chunk_h) for r in got} == brute(x, 0.8) and len(got) == len(brute(x, 0.8)) > 500
    assert all(abs(r.similarity - x[r.chunk_q] @ x[r.chunk_h]) < 1e-9 for r in got[:500])


def test_most_pairs_of_cells_are_skipped_where_vectors_cluster(spark):
    x = clustered(4000, 40, 0.01, 3)
    celled = similarity.vector_cells(rows(spark, x), 50)
    pairs = similarity.cell_pairs(similarity.cell_bounds(celled), 0.9).agg(F.avg(F.col("met").cast("int")).alias("met"), F.count("*").alias("n")).first()
    sizes = celled.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert pairs.n > 2000 and pairs.met < 0.2 and sizes < 4 * 50


def test_few_or_no_vectors(spark):
    assert not similarity.vector_pairs(rows(spark, np.zeros((0, 16))), 0.5).collect()
    assert not similarity.vector_pairs(rows(spark, clustered(1, 1, 0.1, 1)), 0.5).collect()
    zeros = np.zeros((20, 4))
    assert not similarity.vector_pairs(rows(spark, zeros), 0.5, 4).collect()


def test_phrases(spark):
    x, p = np.split(clustered(503, 8, 0.05, 5).astype(np.float32), [500])
    df = rows(spark, x, more=[("t", 1, 9000, None), ("t", 1, 9001, [None] * 16), ("t", 1, 9002, [1.0] * 3), ("t", 1, 9003, [])])
    phrases = spark.createDataFrame([([float(c) for c in v],) for v in p] + [(None,)], "embedding array<float>")
    got = {r.chunk_id for r in whitelist.close_to_phrases(df, phrases, 0.7).collect()}
    assert got == set(np.flatnonzero((x.astype(float) @ p.astype(float).T).max(axis=1) >= 0.7).tolist()) and 0 < len(got) < 500
    size = lambda n: len(whitelist.close_to_phrases(df, phrases.limit(n), 0.7)._jdf.queryExecution().toString())
    assert abs(size(1) - size(3)) < 100  # the plan doesn't hold the phrases
    assert not whitelist.close_to_phrases(df, phrases.limit(0), 0.7).collect() and not whitelist.close_to_phrases(df.limit(0), phrases, 0.7).collect()
    for kw in ({"max_phrases": 2}, {"max_bytes": 100}):
        with pytest.raises(ValueError, match="more than"):
            whitelist.close_to_phrases(df, phrases, 0.7, **kw)
