"""Versioned tables: what a commit rewrites, what readers see, and what failures leave."""

import pytest
from pyspark.sql import functions as F

from bidscreen.sources.versions import Store

KEYS = {"chunks": ("task_id", "chunk_id"), "pairs": ("task_id", "pair_id")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", KEYS, buckets=8)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "task_id string, chunk_id long, version long, text string")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "task_id string, pair_id long, version long")


def seen(df):
    return {tuple(r) for r in df.collect()}


def files(store, table="chunks"):
    return {b: set(f) for b, f in store.manifest()[table]["files"].items() if f}


def test_untouched_files_keep_their_names(spark, store):
    store.commit({"chunks": chunks(spark, *[(f"t{i}", j, 1, "old") for i in range(40) for j in range(3)])})
    before = files(store)
    assert len(before) == 8
    store.commit({"chunks": chunks(spark, ("t7", 1, 2, "new"), ("t7", 9, 1, "more"), ("t7", 2, 0, "too old"))})
    after = files(store)
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1 and not before[changed[0]] & after[changed[0]]
    rows = seen(store.read("chunks"))
    assert len(rows) == 121 and {r[1:] for r in rows if r[0] == "t7"} == {(0, 1, "old"), (1, 2, "new"), (2, 1, "old"), (9, 1, "more")}
    assert ("t7", 1, 1, "old") in seen(store.read("chunks", 1))  # the version before stays readable


def test_deletes_cascade_over_all_tables_in_one_version(spark, store):
    store.commit({"chunks": chunks(spark, ("a", 1, 1, "x"), ("b", 1, 1, "y")), "pairs": pairs(spark, ("a", 5, 1), ("b", 6, 1))})
    n = store.commit({"chunks": chunks(spark, ("a", 2, 1, "again"))}, deleted=spark.createDataFrame([("a",), ("none",)], "task_id string"))
    assert n == 2 and store.versions() == [1, 2]
    assert seen(store.read("chunks")) == {("b", 1, 1, "y"), ("a", 2, 1, "again")} and seen(store.read("pairs")) == {("b", 6, 1)}
    store.commit(deleted=spark.createDataFrame([("a",), ("b",)], "task_id string"))
    assert not seen(store.read("chunks")) and not seen(store.read("pairs")) and store.read("pairs").columns == ["task_id", "pair_id", "version"]


def test_a_failed_write_leaves_the_old_version(spark, store):
    store.commit({"chunks": chunks(spark, ("a", 1, 1, "x"))})
    bad = chunks(spark, ("a", 1, 2, "y")).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"chunks": bad})
    assert store.versions() == [1] and seen(store.read("chunks")) == {("a", 1, 1, "x")}


def test_the_second_of_two_writers_is_refused(spark, store):
    store.commit({"chunks": chunks(spark, ("a", 1, 1, "x"))})
    other = Store(spark, store.path, KEYS, buckets=8)
    known = other.versions
    other.versions = lambda: known()[:1]  # it began before the commit that follows
    store.commit({"chunks": chunks(spark, ("a", 1, 2, "first"))})
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit({"chunks": chunks(spark, ("a", 1, 3, "second"))})
    assert seen(store.read("chunks")) == {("a", 1, 2, "first")}


def test_unnamed_files_go(spark, store, tmp_path):
    for i in range(4):
        store.commit({"chunks": chunks(spark, ("a", 1, i, str(i)), ("b", i, 0, "b"))})
    assert store.drop_unnamed(keep=1) > 0 and store.versions() == [4]
    assert seen(store.read("chunks")) == {("a", 1, 3, "3"), *(("b", i, 0, "b") for i in range(4))}
    on_disk = {p.name for p in tmp_path.rglob("*.parquet")}
    assert on_disk == {f.split("/")[-1] for of in files(store).values() for f in of} and store.drop_unnamed() == 0


def test_an_empty_store(store):
    assert store.versions() == [] and store.manifest() == {} and store.drop_unnamed() == 0
