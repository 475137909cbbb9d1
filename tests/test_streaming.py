"""Documents that arrive one after another meet those before them."""

from bidscreen.profile import LATIN
from bidscreen.streaming.arrivals import screen_arrivals


def test_arrivals(spark, tmp_path):
    schema = "task_id string, doc_id string, doc_ord int, text string"
    source = f"file://{tmp_path}/in"
    for i, text in enumerate(["mail a@b.com", "mail c@d.org and a@b.com", "mail c@d.org", "mail x@y.net"]):
        docs = spark.createDataFrame([("t", f"d{i}", i, text)], schema)
        docs.coalesce(1).write.mode("append").parquet(source)
        writer = screen_arrivals(spark, source, docs.schema, f"file://{tmp_path}/history", f"file://{tmp_path}/found", LATIN)
        query = writer.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = spark.read.parquet(f"file://{tmp_path}/found").collect()
    assert {(r.doc_a, r.doc_b, r.value_a) for r in found} == {("d0", "d1", "a@b.com"), ("d1", "d2", "c@d.org")}
