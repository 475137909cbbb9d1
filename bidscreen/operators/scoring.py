"""Scores of candidate pairs, review of the best, and a task's text risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscreen.functions.text import level
from bidscreen.operators.similarity import keyword_jaccard
from bidscreen.profile import Profile

SIDE = ("doc_id", "doc_ord", "chunk_index", "text", "section_title", "chunk_type", "page_num", "is_whitelisted")
# Weights, bonuses, penalty and levels of the score.
VECTOR, KEYWORD, CONTEXT = 0.60, 0.25, 0.15
SAME_SECTION, BOTH_TECH, PENALTY = 0.10, 0.05, 0.50
HIGH, MEDIUM, LOW = 85.0, 65.0, 45.0
RISK_TYPES = ("verbatim_copy", "semantic_paraphrase", "template_reuse", "key_param_duplicate", "normal_overlap")
EXTRA_TYPES = ("error_replication", "key_number_duplicate")
VERDICT = "risk_level string, risk_type string, confidence double, reason_zh string, evidence_quote_a string, evidence_quote_b string, suggest_action string, score_adjustment double"
NO_VERDICT = "no valid verdict: the result rests on the similarity score alone"


def risk_level(score: Column) -> Column:
    return level(score, HIGH, MEDIUM, LOW)


def score_pairs(candidates: DataFrame, chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pair id, overlaps, base score and level of candidates (task_id, chunk_a, chunk_b, similarity)."""
    own = chunks.select("task_id", "chunk_id", *SIDE).join(keywords, ["task_id", "chunk_id"], "left")

    def side(s: str) -> DataFrame:
        return own.select("task_id", F.col("chunk_id").alias(f"chunk_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*SIDE, "keywords")])

    p = candidates.join(side("a"), ["task_id", "chunk_a"]).join(side("b"), ["task_id", "chunk_b"])
    p = p.withColumn("pair_id", F.substring(F.md5(F.concat_ws(":", "chunk_a", "chunk_b").cast("binary")), 1, 12))
    p = p.withColumn("keyword_overlap", keyword_jaccard(F.col("keywords_a"), F.col("keywords_b"))).drop("keywords_a", "keywords_b")
    section = F.when((F.col("section_title_a") != "") & (F.col("section_title_a") == F.col("section_title_b")), SAME_SECTION).otherwise(0.0)
    tech = F.when((F.col("chunk_type_a") == "tech_spec") & (F.col("chunk_type_b") == "tech_spec"), BOTH_TECH).otherwise(0.0)
    p = p.withColumn("context_bonus", section + tech)
    raw = (F.col("similarity") * VECTOR + F.col("keyword_overlap") * KEYWORD + F.col("context_bonus") * CONTEXT) * 100
    p = p.withColumn("raw", F.when(F.col("is_whitelisted_a") | F.col("is_whitelisted_b"), raw * PENALTY).otherwise(raw))
    return p.withColumns({"base_risk_score": F.round("raw", 2), "final_score": F.round("raw", 2), "risk_level": risk_level(F.col("raw"))}).drop("raw")


def in_order(pairs: DataFrame, by: str = "base_risk_score") -> DataFrame:
    """Best first; equal scores by the asking chunk's place, then by id."""
    return pairs.orderBy("task_id", F.desc(by), "doc_ord_a", "chunk_index_a", "pair_id")


def candidates_above(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("base_risk_score") >= LOW)


def needs_review(pairs: DataFrame) -> DataFrame:
    """One row per task: whether its best pair calls for a review."""
    return pairs.groupBy("task_id").agg((F.max("base_risk_score") >= MEDIUM).alias("needs_review"))


def review_queue(pairs: DataFrame, top: int = 20) -> DataFrame:
    """The best pairs of tasks that need a review, with their place in the queue."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("base_risk_score"), "doc_ord_a", "chunk_index_a", "pair_id"))
    gate = needs_review(pairs).where("needs_review").select("task_id")
    return candidates_above(pairs).join(gate, "task_id", "left_semi").withColumn("queue_place", place).where(F.col("queue_place") <= top)


def review_requests(queue: DataFrame, names: DataFrame, profile: Profile) -> DataFrame:
    """What a reviewer gets of each pair: names(doc_id, name), sections, texts cut to max_chars, scores."""
    cut = lambda c: F.when(F.length(c) > profile.max_chars, F.concat(F.substring(c, 1, profile.max_chars), F.lit(profile.cut_mark))).otherwise(F.col(c))
    section = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(profile.no_section))
    named = lambda s: names.select(F.col("doc_id").alias(f"doc_id_{s}"), F.col("name").alias(f"doc_{s}_name"))
    q = queue.join(named("a"), "doc_id_a", "left").join(named("b"), "doc_id_b", "left")
    return q.select("task_id", "pair_id", "doc_a_name", section("section_title_a").alias("section_a"), cut("text_a").alias("text_a"), "doc_b_name", section("section_title_b").alias("section_b"), cut("text_b").alias("text_b"), F.col("similarity").alias("vector_similarity"), "keyword_overlap", "base_risk_score")


def parse_verdicts(verdicts: DataFrame, more_types: bool = False) -> DataFrame:
    """Reviewers' replies (task_id, pair_id, content) with `verdict` (null unless valid) and `valid`.

    The JSON runs from the first { to the last }. Valid: level and type of the lists, confidence from 0 to 1, a
    reason of at least 20 characters, an adjustment from -20 to 20 (0 where missing). more_types also
    takes two types that prompts may ask for.
    """
    v = verdicts.withColumn("v", F.from_json(F.regexp_extract("content", r"(?s)\{.*\}", 0), VERDICT))
    kinds = RISK_TYPES + (EXTRA_TYPES if more_types else ())
    x = F.coalesce(F.col("v.score_adjustment"), F.lit(0.0))
    valid = (
        F.col("v.risk_level").isin("high", "medium", "low", "none")
        & F.col("v.risk_type").isin(*kinds)
        & F.col("v.confidence").between(0.0, 1.0)
        & (F.length("v.reason_zh") >= 20)
        & x.between(-20.0, 20.0)
    )
    v = v.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return v.withColumn("verdict", F.when(F.col("valid"), F.col("v"))).drop("v")


def apply_verdicts(pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Final score and level after the adjustment; without a valid verdict only the reason changes."""
    v = parsed.select("task_id", "pair_id", "valid", "verdict").dropDuplicates(["task_id", "pair_id"])
    p = pairs.join(v, ["task_id", "pair_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    step = F.greatest(F.least(F.coalesce("verdict.score_adjustment", F.lit(0.0)), F.lit(20.0)), F.lit(-20.0))
    final = F.round(F.col("base_risk_score") + step, 2)
    text = lambda c: F.coalesce(f"verdict.{c}", F.lit(""))
    return p.withColumns(
        {
            "llm_adjustment": F.when(F.col("valid"), step).otherwise(0.0),
            "risk_level": F.when(F.col("valid"), risk_level(final)).otherwise(F.col("risk_level")),
            "final_score": F.when(F.col("valid"), final).otherwise(F.col("final_score")),
            "risk_type": F.when(F.col("valid"), F.col("verdict.risk_type")).otherwise("normal_overlap"),
            "confidence": F.when(F.col("valid"), F.col("verdict.confidence")).otherwise(0.0),
            "reason_zh": F.when(F.col("valid"), F.col("verdict.reason_zh")).otherwise(NO_VERDICT),
            "evidence_quote_a": text("evidence_quote_a"),
            "evidence_quote_b": text("evidence_quote_b"),
            "suggest_action": text("suggest_action"),
        }
    ).drop("valid", "verdict")


def review(pairs: DataFrame, verdicts: DataFrame, drop_unreviewed: bool = True, top: int = 20) -> DataFrame:
    """Pairs after review. Of tasks that need none, all candidates stay as they are; of others only the queue,
    unless drop_unreviewed is off."""
    above = candidates_above(pairs)
    queue = review_queue(pairs, top).drop("queue_place")
    done = apply_verdicts(queue, parse_verdicts(verdicts))
    gate = needs_review(pairs).where("needs_review").select("task_id")
    rest = above.join(gate, "task_id", "left_anti") if drop_unreviewed else above.join(queue.select("task_id", "pair_id"), ["task_id", "pair_id"], "left_anti")
    return done.unionByName(rest, allowMissingColumns=True)


def text_risk(pairs: DataFrame, chunk_counts: DataFrame, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Level and rate of a task, or of each pair of documents with by=(task_id, doc_id_a, doc_id_b).

    rate: distinct A-chunks in high, medium and low pairs over the chunks of the first document (of the
    task, or of the pair), 0 without any; chunk_counts has task_id, doc_id, doc_ord, n_chunks. The level
    uses the rate as it is, which is then rounded.
    """
    risky = F.col("risk_level") != "none"
    n = lambda kind: F.count_if(F.col("risk_level") == kind)
    out = pairs.groupBy(*by).agg(F.count_distinct(F.when(risky, F.col("chunk_a"))).alias("covered"), n("high").alias("n_high"), n("medium").alias("n_medium"), n("low").alias("n_low"), F.count("*").alias("n_pairs"))
    if len(by) == 1:
        first = chunk_counts.groupBy("task_id").agg(F.min_by("n_chunks", "doc_ord").alias("n_chunks"))
        out = first.join(out, "task_id", "left").fillna(0)
    else:
        out = out.join(chunk_counts.select("task_id", F.col("doc_id").alias("doc_id_a"), "n_chunks"), ["task_id", "doc_id_a"], "left")
    rate = F.when(F.col("n_chunks") > 0, F.col("covered") / F.col("n_chunks")).otherwise(0.0)
    share = F.when(F.col("n_pairs") > 0, F.col("n_high") / F.col("n_pairs")).otherwise(0.0)
    kind = F.when((rate >= 0.30) | (share >= 0.05), "high").when((rate >= 0.15) | ((F.col("n_high") >= 1) & (F.col("n_medium") >= 3)), "medium").otherwise("low")
    return out.withColumns({"text_level": kind, "text_rate": F.round(rate, 4)}).drop("covered", "n_chunks")
