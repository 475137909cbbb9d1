"""Text similarity over all terms of a task, frequent ones included."""

import math
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from bidscreen.operators import similarity
from bidscreen.plans import base
from bidscreen.plans.catalog import ORACLES, QUERIES
from bidscreen.profile import LATIN

KEY = "task_id string, doc_id long, doc_ord long, chunk_id string, chunk_index int, text string, is_whitelisted boolean"


def plain_cosines(rows, at_least):
    terms = [Counter(w for w in r[5].split() if len(w) >= 2) for r in rows]
    df, n = Counter(t for c in terms for t in c), len(rows)
    vectors = [{t: k * (math.log((n + 1) / (df[t] + 1)) + 1) for t, k in c.items()} for c in terms]
    size = [math.sqrt(math.fsum(x * x for x in v.values())) for v in vectors]
    out = {}
    for i, j in permutations(range(n), 2):
        if rows[i][1] != rows[j][1] and size[i] and size[j]:
            s = round(math.fsum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) / size[i] / size[j], 9)
            if s >= at_least:
                out[rows[i][3], rows[j][3]] = s
    return out


def rows_of(seed=0):
    """Forty copies of one passage, variants of it, and texts of few and of many frequent words."""
    import random

    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    texts = ["the same passage stands here in many documents"] * 40 + [f"the same passage stands here in other{i} documents" for i in range(12)]
    texts += [" ".join(rng.choices(words, [1 / (1 + i) for i in range(60)], k=rng.randint(1, 25))) for _ in range(90)] + [""]
    return [("t", i // 2, i // 2, f"c{i}", i % 2, t, False) for i, t in enumerate(texts)]


@pytest.mark.parametrize("salt", [2_000, 7])
def test_all_pairs_over_all_terms(spark, monkeypatch, salt):
    monkeypatch.setattr(similarity, "SALT", salt)
    rows = rows_of()
    weights = similarity.term_weights(spark.createDataFrame(rows, KEY), LATIN)
    got = {(r.chunk_q, r.chunk_h): r.similarity for r in similarity.text_pairs(weights, 0.55).collect()}
    want = plain_cosines(rows, 0.55)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    assert len(want) > 40 * 38


def test_top_leaves_out_no_hit_of_a_chunk(spark):
    chunks = spark.createDataFrame(rows_of(1), KEY)
    weights = similarity.term_weights(chunks, LATIN)
    found = [sorted(map(tuple, similarity.retrieve(chunks, similarity.text_pairs(weights, 0.55, top=top), 10).collect())) for top in (None, 10)]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("name", ["candidate_pairs", "text_risk"])
def test_queries_equal_sql_over_all_terms(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    want = sorted(rounded(r) for r in found.fetchall())
    assert sorted(rounded(r[c] for c in columns) for r in QUERIES[name](spark, sf_dir).collect()) == want


def test_copies_of_more_than_twenty_chunks_have_pairs(spark, tmp_path):
    text = "this passage stands in thirty documents of one source and each of its words with it"
    spark.createDataFrame([(i, text, "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    weights = base.scored_pairs(spark, str(tmp_path))
    assert weights.where("similarity = 1").count() >= 29
