"""Where shared tables go."""

import os
import time

import pytest

from bidscreen.sources import shared
from bidscreen.sources.shared import shared_folder


class Session:
    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_a_cluster_has_to_name_its_folder():
    assert shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    local = Session(**{"spark.master": "local[4]"})
    assert shared_folder(local).startswith("file:///") and shared_folder(local) == local.settings["spark.checkpoint.dir"]
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(Session(**{"spark.master": master}))


def test_owned_tables_are_deleted_at_the_end(spark):
    kept = shared.written(spark.range(2), "kept")
    with shared.owned_tables(spark):
        outer = shared.written(spark.range(3), "outer")
        with shared.owned_tables(spark):
            inner = shared.written(spark.range(4), "inner")
            files = {n: df.inputFiles()[0] for n, df in (("kept", kept), ("outer", outer), ("inner", inner))}
        here = lambda n: os.path.exists(files[n].removeprefix("file://"))
        assert not here("inner") and here("outer") and outer.count() == 3
    assert not here("outer") and here("kept") and kept.count() == 2


def test_a_written_table_leaves_no_shuffle_files(spark):
    known = lambda: set(filter(None, spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",")))
    before, setting = known(), spark.conf.get(shared.CLEANUP, None)
    table = shared.written(spark.range(1_000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    end = time.time() + 20
    while known() - before and time.time() < end:  # files are removed beside the driver's work
        time.sleep(0.1)
    assert not known() - before and spark.conf.get(shared.CLEANUP, None) == setting
    assert table.count() == 7


def test_candidates_leave_their_result_alone(spark, tmp_path):
    """What similar chunks were found by is deleted; what a query goes on to read isn't."""
    from bidscreen.plans import base

    text = "\n".join(f"passage {i} of words that stand in every document of one source" for i in range(3))
    spark.createDataFrame([(i, f"{text}\nown{i} words{i} here{i}", "en", "s") for i in range(4)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = shared.shared_folder(spark).removeprefix("file://")
    before = {*os.listdir(folder)}
    pairs = base.scored_pairs(spark, str(tmp_path))
    left = {n.rsplit("-", 5)[0] for n in {*os.listdir(folder)} - before}
    assert {"chunks", "pairs"} <= left and not left & {"vectors", "unit", "near", "classes", "lists", "candidates", "weights"}
    assert pairs.count() > 0
