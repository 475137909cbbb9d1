"""Classes of documents with the same rare tokens: few rows for many copies, and the same links."""

import pytest
from pyspark.sql import functions as F

from bidscreen.operators import rare
from bidscreen.plans import base
from bidscreen.profile import LATIN, ZH

DOCS = "task_id string, doc_id long, doc_ord long, text string"


def links_of(tokens):
    members = rare.classes(tokens)
    return members, rare.class_links(tokens, members)


def expanded(tokens):
    members, links = links_of(tokens)
    rows = [tuple(r) for r in rare.expand_links(links, members).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_expansion_equals_all_pairs(spark, sf_dir):
    docs = base.documents(spark, sf_dir)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumns({"doc_id": F.col("doc_id") + 100_000, "doc_ord": F.lit(50) - F.col("doc_ord")}))
    want = rare.signal(rare.matches(docs, LATIN)).select("task_id", "doc_a", "doc_b", "ord_a", "ord_b", "total_match_count", "rare_level")
    got = expanded(rare.all_tokens(docs, LATIN))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 60


@pytest.mark.parametrize("copies", [50, 100])
def test_rows_grow_with_copies_and_not_with_their_pairs(spark, copies):
    rows = [("t", i, i, "项目采用分布式架构设计，交货期30天") for i in range(copies)] + [("t", 900, 900, "完全不同的内容描述文字，保修期5年"), ("t", 901, 901, "另一份标书写明交货期30天"), ("u", 1, 1, ""), ("u", 2, 2, None)]
    members, links = links_of(rare.all_tokens(spark.createDataFrame(rows, DOCS), ZH))
    assert members.count() == copies + 2
    found = {(r.class_a, r.class_b): r.total_match_count for r in links.collect()}
    own = members.where("doc_id = 0").first()
    assert found == {(0, 0): own.n_tokens, (0, 901): 1} and own.class_size == copies


def test_nothing_shared(spark):
    tokens = rare.all_tokens(spark.createDataFrame([("t", 1, 1, "x")], DOCS), LATIN)
    assert not expanded(tokens) and not expanded(tokens.where(F.lit(False)))
