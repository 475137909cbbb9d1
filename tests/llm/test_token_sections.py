"""op10's rows hold every section that count_by_section gives."""

from pyspark.sql import functions as F

from bidscreen.llm import queries, token_counts


def test_documents_hold_all_their_sections(spark, tmp_path):
    texts = ["one\ntwo three\n\n\nend", None, "", "\n", "no end", "çé漢字\n" * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = queries.op10_token_counts(spark, str(tmp_path)).select("doc_id", F.posexplode("sections").alias("section", "s")).select("doc_id", "section", "s.*")
    want = token_counts.count_by_section(docs, queries.tokenizer_path())
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.select(own.columns).collect()))
    assert own.count() == sum((t or "").count("\n") + 1 for t in texts)
