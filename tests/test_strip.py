"""Both ends are stripped of all that counts as white space, without a regular expression."""

from pyspark.sql import functions as F

from bidscreen.functions.text import strip


def test_every_character_as_the_pattern_has_it(spark):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [(f"{c}甲 {c} b{c}",) for c in points] + [(t,) for t in ("", " ", "　\n \t", "a", " a\r\n", "\n a  \u0085", "😀 ", None)]
    found = spark.createDataFrame(texts, "t string").select("t", strip(F.col("t")).alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert found.where("NOT (got <=> want)").count() == 0
    assert found.where("got <> t").count() > 25


def test_no_pattern(spark):
    plan = spark.range(1).select(strip(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
