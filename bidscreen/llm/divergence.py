"""Source divergence audit: which sources of a language use other words than the rest, and which words.

Terms are counted by (lang, source); each language keeps the terms of at least `min_docs` of its documents. A group's
share of a term is 1 + floor(10**9 * (count + 5) / (N + 5 * V)) over all V kept terms of its language, N being its
occurrences of these; all arithmetic is of whole numbers.

Two groups are compared by a merge of their sorted (term id, count) arrays: a galloping intersection finds the terms of
both, which are priced by both counts; one-sided terms by a count and the other's share of nothing; and the terms that
both lack by one difference times their number. What a pair costs is what it has, not what the vocabulary has. Arrays
are cut to blocks of terms chosen by hash, so that a group of any size is many bounded arrays, and sources are dealt to
tiles, so that an array is sent to each tile once and not to each other source.

Handling: null text, lang and source count as ''. A language without kept terms gives each pair the value 0; a group
without terms still takes part. Repeated rows and ids are documents of their own. An empty table gives no rows. Other
columns, whatever their names, are not looked at. Very long texts are counted whole, one at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscreen.llm.common import materialize, pieces

#: Bytes of terms are letters and all of other than ASCII; A-Z become a-z, the rest parts terms.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SMOOTH, _SCALE = 5, 1_000_000_000


def count_terms(docs: DataFrame, max_entries: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it). A task's counts are sent on whenever they
    have max_entries terms: that bounds its memory and leaves the sums as they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = defaultdict(lambda: (Counter(), Counter()))

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in seen.items():
                for terms in (list(n)[i : i + 20_000] for i in range(0, len(n), 20_000)):
                    words = pa.array(terms, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), words, pa.array([n[t] for t in terms], pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for piece in pieces(batches, "text"):
            for lang, source, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                terms = text.encode().translate(_TERM_BYTES).split()
                n, in_docs = seen[lang, source]
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in seen.values()) >= max_entries:
                yield from sent()
        yield from sent()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exact."""
    whole = lambda c: c.cast("decimal(20,0)")
    scaled = (whole(n + _SMOOTH) * F.lit(_SCALE).cast("decimal(10,0)")).cast("decimal(31,0)")
    return F.call_function("div", scaled, whole(total + _SMOOTH * terms.cast("long"))) + 1


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """share() of arrays: three decimal digits at a time, so that nothing exceeds 64 bits."""
    out, rest = np.zeros(len(n), np.int64), n.astype(np.int64) + _SMOOTH
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // (total + _SMOOTH * terms)
        rest %= total + _SMOOTH * terms
    return out + 1


def gallop(small: np.ndarray, large: np.ndarray, stride: int = 32) -> np.ndarray:
    """How many of large are below each of small, both sorted: from the place of one key in `stride`, steps double
    until they would pass the key, then halve."""
    if not len(large):
        return np.zeros(len(small), np.int64)
    at = np.repeat(np.searchsorted(large, small[::stride]), stride)[: len(small)]

    def advance(step: int) -> bool:
        go = (at + step <= len(large)) & (large[np.minimum(at + step, len(large)) - 1] < small)
        at[go] += step
        return bool(go.any())

    step = 1
    while advance(step):
        step *= 2
    while step > 1:
        step //= 2
        advance(step)
    return at


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], all_terms: int, terms: int) -> int:
    """The sum of |share of a - share of b| over `terms` terms: a and b are sorted ids and counts of those they have."""
    if not all_terms:
        return 0
    (a_id, a_n), (b_id, b_n) = a, b
    none_a, none_b = (int(shares(np.zeros(1, np.int64), t, all_terms)[0]) for t in totals)
    if len(a_id) > len(b_id):
        (a_id, a_n), (b_id, b_n), none_a, none_b, totals = (b_id, b_n), (a_id, a_n), none_b, none_a, totals[::-1]
    at = gallop(a_id, b_id)
    both = np.flatnonzero((at < len(b_id)) & (b_id[np.minimum(at, len(b_id) - 1)] == a_id)) if len(b_id) else np.zeros(0, np.int64)
    p, q = shares(a_n, totals[0], all_terms), shares(b_n, totals[1], all_terms)
    met = int(np.abs(p[both] - q[at[both]]).sum())
    left = int(np.abs(p - none_b).sum() - np.abs(p[both] - none_b).sum())
    right = int(np.abs(q - none_a).sum() - np.abs(q[at[both]] - none_a).sum())
    absent = (terms - len(a_id) - len(b_id) + len(both)) * abs(none_a - none_b)
    return met + left + right + absent


def _pair_values(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Values of a block of terms for all pairs of a tile of sources with another, or within one tile, both ways."""
    lang, _, first, second = key
    arrays = [[(r.source, int(r.total), (np.asarray(r.ids, np.int64), np.asarray(r.counts, np.int64)), int(r.all_terms), int(r.terms)) for r in side.sort_values("place").itertuples()] for side in (left, right)]
    out = []
    for i, (a, a_total, a_array, all_terms, terms) in enumerate(arrays[0]):
        for b, b_total, b_array, _, _ in arrays[1][i + 1 :] if first == second else arrays[1]:
            value = price(a_array, b_array, (a_total, b_total), all_terms, terms)
            out += [(lang, a, b, value), (lang, b, a, value)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, block_terms: int = 512, tile: int = 8) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: item is each other source of the language, value their difference summed over all kept terms. Part
    `term`: item is a term that the group has and uses more than its language does, value by how much, the `top` first.
    Ranks go by value, then item. A task compares `tile` sources with as many over about `block_terms` terms.
    """
    counts = count_terms(docs)
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "lead": F.col("source") == F.min("source").over(of_term)}).where(F.col("in_docs") >= min_docs)
    kept = materialize(kept.select("lang", "source", "term", "n", "lang_n", "lead"), "kept-terms")

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("all_terms"), F.sum("n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "all_terms", "lang_total"])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumns({"tile": F.floor(F.col("place") / tile).cast("int"), "blocks": F.greatest(F.ceil(F.col("all_terms") / block_terms), F.lit(1))})
    groups = materialize(groups, "term-groups")

    known = kept.join(groups.select("lang", "source", "total", "all_terms", "lang_total", "blocks"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("all_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("all_terms"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")

    known = known.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    known = known.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")))
    known = known.withColumn("terms", F.max("id").over(Window.partitionBy("lang", "block")))
    pair = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = known.groupBy("lang", "block", "source").agg(pair.alias("pairs"), F.first("terms").alias("terms"))
    sizes = known.groupBy("lang", "block").agg(F.max("terms").alias("terms"))
    all_blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = all_blocks.join(arrays.drop("terms"), ["lang", "block", "source"], "left").join(sizes, ["lang", "block"], "left")
    sides = sides.select("lang", "block", "source", "place", "tile", "total", "all_terms", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce(F.col("pairs.id"), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.col("pairs.n"), F.array().cast("array<bigint>")).alias("counts"))
    sides = materialize(sides.withColumn("tiles", F.floor(F.max("tile").over(Window.partitionBy("lang", "block")))), "term-arrays")
    left = sides.withColumns({"first": F.col("tile"), "second": F.explode(F.sequence("tile", F.col("tiles").cast("int")))})
    right = sides.withColumns({"first": F.explode(F.sequence(F.lit(0), F.col("tile"))), "second": F.col("tile")})
    key = ["lang", "block", "first", "second"]
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_pair_values, "lang string, source string, item string, value bigint")
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
