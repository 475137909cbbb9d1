"""How the given tables are read as tenders: tasks, documents, bids and metadata."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscreen.functions.text import strip
from bidscreen.operators import chunking, fields, metadata, prices, rare, scoring, similarity, structure, synthesis, whitelist
from bidscreen.profile import LATIN, ZH
from bidscreen.sources.shared import dropped, written

#: Cosine that a hit has to reach, and hits of a chunk. Fixed values.
MIN_SIMILARITY, TOP = 0.55, 10
WHITELIST = [*LATIN.legal, *LATIN.standard]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a task; its documents go by id."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("task_id"), "doc_id", F.col("doc_id").alias("doc_ord"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents, written once: terms, retrieval and scores all read them."""
    return written(whitelist.mark(chunking.chunk_documents(documents(spark, sf_dir), LATIN), WHITELIST), "chunks")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunking.with_sections(chunking.split_paragraphs(documents(spark, sf_dir), LATIN), LATIN)
    return p.withColumn("chunk_type", chunking.chunk_type(F.col("body"), LATIN)).withColumnRenamed("body", "text")


def key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.extract(documents(spark, sf_dir), LATIN)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a document are taken for its headings."""
    lines = chunking.split_paragraphs(documents(spark, sf_dir), LATIN)
    return structure.headings(lines.select("task_id", "doc_id", "doc_ord", F.col("pos").alias("chunk_index"), strip(F.col("body")).alias("text"), F.lit(True).alias("is_heading")))


def rare_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare.matches(documents(spark, sf_dir), LATIN)


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a tender, a supplier's line items for it the lines of one bid."""
    items = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("合计："), F.round("l_extendedprice").cast("bigint").cast("string"), F.lit("元"))
    return items.select(F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_suppkey").alias("doc_ord"), line.alias("text"), F.lit("price_param").alias("chunk_type"))


def price_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.signal(prices.close_totals(prices.totals(bids(spark, sf_dir), ZH)))


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a file saved by its user; its type is the task."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("task_id"), F.col("event_id").alias("doc_id"), F.col("event_id").alias("doc_ord"), F.col("user_id").cast("string").alias("author"), F.lit("").alias("last_modified_by"), F.lit("").alias("company"), F.col("ts").alias("modified"))


def meta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.compared(file_metadata(spark, sf_dir))


def scored_pairs(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    c = c if c is not None else chunks(spark, sf_dir)
    weights = written(similarity.chunk_weights(c, LATIN), "weights")
    found = similarity.text_candidates(c, weights, MIN_SIMILARITY, TOP)
    pairs = written(scoring.score_pairs(found, c, similarity.keywords(weights, LATIN)), "pairs")
    dropped(weights, found)
    return pairs


def chunk_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("task_id", "doc_id", "doc_ord").agg(F.count("*").alias("n_chunks"))


def pair_text(pairs: DataFrame, c: DataFrame) -> DataFrame:
    """The text signal of pairs of documents that have scored pairs of chunks; the smaller id is A."""
    by = ("task_id", "doc_id_a", "doc_id_b")
    ordered = pairs.withColumns({"doc_id_a": F.least("doc_id_a", "doc_id_b"), "doc_id_b": F.greatest("doc_id_a", "doc_id_b")})
    text = scoring.text_risk(ordered, chunk_counts(c), by)
    return text.select("task_id", F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), F.col("doc_id_a").alias("ord_a"), F.col("doc_id_b").alias("ord_b"), "text_level", "text_rate")


def signals(spark: SparkSession, sf_dir: str, c: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Every pair of documents of a task with any text, structure, field or rare-token evidence.

    Prices and metadata are of bids and files, whose ids aren't the documents'.
    """
    c = c if c is not None else chunks(spark, sf_dir)
    pairs = scoring.candidates_above(pairs if pairs is not None else scored_pairs(spark, sf_dir, c))
    found = written(fields.overlaps(written(key_fields(spark, sf_dir), "fields"), LATIN), "overlaps")
    alike = written(structure.compare(written(titles(spark, sf_dir), "titles"), texts=False), "structure")
    return synthesis.assemble(text=pair_text(pairs, c), structure=alike, overlaps=found, rare=written(rare.signals(rare.texts_of(documents(spark, sf_dir)), LATIN, lists=False), "rare"))


def composite(spark: SparkSession, sf_dir: str, c: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    return synthesis.synthesize(signals(spark, sf_dir, c, pairs))
