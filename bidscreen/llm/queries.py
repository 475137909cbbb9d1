"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscreen.llm import bpe, chat, divergence, language, lm, mixing, near_duplicates, neighbours, packing, periodic, quality, token_counts, urls
from bidscreen.llm.common import crc_of_id


def tokenizer_path() -> str:
    """The public tokenizer file that the contracts name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_of_id("doc_id") % 3 == 1).alias("held_out"))
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), crc_of_id("doc_id") % 5 == 1)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of this query's contract.
URL_RULES = [
    urls.UrlRule("org", "/", "allow"),
    urls.UrlRule("example.org", "/es/", "block"),
    urls.UrlRule("example.org", "/en/1", "block"),
    urls.UrlRule("com", "/fr/", "allow"),
    urls.UrlRule("com", "/de/", "block"),
]
#: A title with three of these symbols in a row marks its host as listed.
SPAM_TITLE = r"<title>[^<]*(###|%%%|\*\*\*)"


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html").rlike(SPAM_TITLE), F.lit(False)).alias("spam"))
    listed = pages.where("spam").select(urls.host_of(F.col("url")).alias("host")).distinct()
    return urls.judge_urls(pages.select("page_id", "url"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_sections(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The contract's texts: of one document in ten, all words from a place on repeat a stretch of a given length."""
    h = crc_of_id(doc_id)
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))[0]  # the words are found once
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    found = periodic.find_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.short")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.short")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_mix": op13_source_mix,
}
