"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark gathers n-gram counts of each language; the log-probability matrix has a fixed number of rows
and is broadcast. The n-grams of all texts of a batch are one flat array of buckets, whose rows of the matrix
are gathered together and summed up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidscreen.llm.common import pieces

UNKNOWN = "und"
#: Draws of training documents go by a hash modulo this, fine enough for tables of 10^12 rows.
DRAW = 1 << 52
_letter = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """buckets: rows of the matrix, a power of 2; orders: lengths of the n-grams; smoothing: added to every count.

    max_train_docs bounds the documents learned from, about: of a language with more, a share chosen by
    the hash of id and text, so that copies of a text don't come in all or not at all. max_languages bounds the
    columns of the broadcast matrix; more languages are an error, none is left out.
    """

    buckets: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    max_train_docs: int = 6_000
    max_languages: int = 1_024


def batch_buckets(texts: list[str], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of the n-grams of all texts, lower-cased, in one flat array, and how many each text has."""
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the end of the text
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        if n > len(c):
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in settings.orders:
            whole = left[: len(h)] >= n  # n-grams that don't reach into the next text
            yield ((h[whole] + np.uint64(n)) & np.uint64(settings.buckets - 1)).astype(np.int64), np.maximum(size - n + 1, 0)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    settings: Settings

    def levels(self) -> np.ndarray:
        """What an n-gram of a language's own texts has on average as its log probability."""
        return (np.exp(self.log_prob) * self.log_prob).sum(0)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior probability, and how far the text's n-grams lie on average
        above (or below, if negative) the level of that language; texts without a letter have none."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total = np.tile(self.log_prior, (len(texts), 1))
        grams = np.zeros(len(texts), np.int64)
        step = max(1, (1 << 21) // len(self.languages))
        for bucket, count in batch_buckets(texts, self.settings):
            grams += count
            some = np.flatnonzero(count)
            end = np.cumsum(count[some])
            for x in range(0, len(bucket), step):
                y = min(x + step, len(bucket))
                first, last = np.searchsorted(end, x, side="right"), np.searchsorted(end, y, side="left")
                border = np.r_[0, end[first:last] - x]  # where the texts of this part begin
                total[some[first : last + 1]] += np.add.reduceat(self.log_prob[bucket[x:y]], border, axis=0)
        best = total.argmax(1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        fit = (total[np.arange(len(texts)), best] - self.log_prior[best]) / np.maximum(grams, 1) - self.levels()[best]
        known = np.array([bool(_letter.search(t)) for t in texts], bool)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0), np.where(known, fit, 0.0)


def train(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from the documents that have a language and a text. The driver gets at most languages x buckets counts.

    The id only takes part in the draw of documents; a table without that column is drawn from by text.
    """
    own = docs[id_col].cast("string") if id_col in docs.columns else F.lit("")
    kept = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), own.alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = kept.groupBy("lang").count().limit(settings.max_languages + 1).collect()
    if len(counts) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages; raise max_languages to learn them all")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((settings.buckets, 0)), settings)
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, settings.max_train_docs / r["count"]) * DRAW)))])
    take = F.pmod(F.xxhash64("id", "text"), F.lit(DRAW)) < share[F.col("lang")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                bucket = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in pieces(batches, "text"):
            lang = np.array([number[x] for x in batch.column(1).to_pylist()])
            for one in np.unique(lang).tolist():
                total = held.setdefault(one, np.zeros(settings.buckets, np.int64))
                for bucket, _ in batch_buckets(batch.column(0).take(pa.array(np.flatnonzero(lang == one))).to_pylist(), settings):
                    total += np.bincount(bucket, minlength=settings.buckets)
            if len(held) > 64:
                yield from rows()
        yield from rows()

    cells = kept.where(take).select("text", "lang").mapInArrow(gather, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    total = np.zeros((settings.buckets, len(languages)))
    total[found.column("bucket").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
    total += settings.smoothing
    prior = np.array([next(r["count"] for r in counts if r["lang"] == lang) for lang in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(total / total.sum(0)), settings)


def _found(docs: DataFrame, model: Model, text_col: str) -> Column:
    """lang_pred, score and fit of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, fit: double>")
    def score(text: pa.Array) -> pa.Array:
        lang, value, fit = [], [], []
        for piece in pieces([pa.RecordBatch.from_arrays([text], names=["text"])], "text"):
            found = shared.value.score([t or "" for t in piece.column(0).to_pylist()])
            lang += found[0]
            value.append(found[1])
            fit.append(found[2])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), *(pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (value, fit))], names=["lang_pred", "score", "fit"])

    return score(docs[text_col].cast("string"))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and fit appended (columns of these names are replaced).

    A null text and one without a letter get `und`, score 0 and fit 0; ties go to the language first in
    order. Whole texts are scored; repeated rows alike. Only the text takes part.
    """
    plain = docs.drop("lang_pred", "score", "fit")
    return plain.withColumn("_found", _found(plain, model, text_col)).select(*[plain[c] for c in plain.columns], "_found.lang_pred", "_found.score", "_found.fit")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5, min_fit: float = -2.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns alone, whose text is of one of the model's languages: likeliest by at least
    min_score, and with n-grams that lie on average no more than -min_fit nats below what the language's own texts have.

    The posterior alone says which of the languages comes nearest, and is near one for texts of any other language
    too; the fit says whether it comes near. A model of few texts (some hundreds) knows few n-grams, and tells less. Null texts and texts without a letter are of no language.
    """
    found = _found(docs, model, text_col).alias("_found")
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), found)
    return kept.where((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= min_score) & (F.col("_found.fit") >= min_fit)).select("_row.*")
