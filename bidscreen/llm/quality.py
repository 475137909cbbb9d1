"""Quality rules: a threshold table compiled into one projection of native expressions.

All measures of a text come from Spark's own functions over its words and lines; no Python runs on
the executors and nothing is shuffled. Windows of words are compared by 64-bit hashes; only texts
in which a window's hash occurs twice are sorted to find the words that repeated windows cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages that the rules expect (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in is that it for as with was be by on not he this are or his from at which but have an had they you were their one all we can her has there been if when will who so no "
    "der die das und ist von zu den mit im ein eine nicht auf für sich des dem "
    "le la les de et un une du en que qui dans pour est par sur pas plus avec ou "
    "el los las y se con para es del al lo su como"
).split()
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document passes if its measure lies between low and high; a missing border is open."""

    measure: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok &= F.col(self.measure) >= F.lit(self.low)
        if self.high is not None:
            ok &= F.col(self.measure) <= F.lit(self.high)
        return ok


#: What a document has to satisfy besides the base rules.
RULES = (
    Rule("mean_word_length", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("capital_line_ratio", None, 0.5),
)


def measures(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with the measures of each text appended; a column of docs that has a measure's name is replaced.

    A null text has no words and no lines. window: words of a window of n_repeat_words, a power of 2.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(text, SPACES), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = 1
    while step < window:  # hashes of 2, 4, 8 ... words from each place on
        out = out.withColumn("_hashes", F.zip_with("_hashes", F.slice("_hashes", step + 1, F.greatest(F.size("_hashes"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    out = out.withColumn("_hashes", F.slice("_hashes", 1, F.greatest(F.size("_words") - (window - 1), F.lit(0))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
        return F.when(same(i - 1) | same(i + 1), x["i"])

    out = out.withColumn("_places", F.array_sort(F.array_compact(F.transform("_sorted", repeated))))
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_places", i + 1) - p, F.lit(window)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    count = lambda c: F.size(c).cast("bigint")
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    counts = {
        "n_words": count("_words"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_lines": count("_lines"),
        "n_dup_lines": count("_lines") - count(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
        "n_stop_words": count(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_capital_lines": count(F.filter("_lines", lambda x: (x == F.upper(x)) & (x != F.lower(x)))),
    }
    ratios = {
        "mean_word_length": F.col("word_chars") / some("n_words"),
        "symbols_per_word": F.col("n_symbols") / some("n_words"),
        "stop_word_ratio": F.col("n_stop_words") / some("n_words"),
        "dup_line_ratio": F.col("n_dup_lines") / some("n_lines"),
        "capital_line_ratio": F.col("n_capital_lines") / some("n_lines"),
    }
    # a row of its own for each text: filters on measures can't be moved below it, where each step would be put
    # into the next one as often as it is used, and worked out as often
    kept = [c for c in docs.columns if c not in counts and c not in ratios]
    out = out.select(*[F.col(c) for c in kept], F.inline(F.array(F.struct(*[v.alias(k) for k, v in counts.items()]))))
    return out.withColumns(ratios)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """docs with the measures, base_failed (too few words, or too many of them in repeated windows),
    failed (the measures of the rules that it breaks, in the table's order) and kept.

    A document is kept if the base rules and the whole table pass. Null and empty texts fail the
    base rules; repeated rows are judged each on its own, all alike; extra columns are kept.
    """
    out = measures(docs, text_col)
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.measure)) for r in rules]))
    out = out.withColumns({"base_failed": base, "failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns alone."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("text"))
    return judge(inner, rules).where("kept").select("_row.*")
