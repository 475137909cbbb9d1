"""Paragraphs, sections, chunk types and chunks of documents.

Documents are (task_id, doc_id, doc_ord, text): doc_ord is a document's place in its task. All steps
work within a document, so everything after the split needs one shuffle by (task_id, doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidscreen.functions.text import hits, strip
from bidscreen.profile import Profile

DOC = ("task_id", "doc_id", "doc_ord")


def split_paragraphs(docs: DataFrame, profile: Profile) -> DataFrame:
    """One row per paragraph that isn't blank: pos, body, is_heading. Null texts have none."""
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    parts = docs.select(*DOC, F.posexplode(F.split(lines, profile.paragraph_split)).alias("pos", "raw"))
    parts = parts.withColumn("raw", strip(F.col("raw"))).where("raw != ''")
    heading = F.startswith("raw", F.lit(profile.heading_mark))
    body = F.when(heading, strip(F.substring("raw", len(profile.heading_mark) + 1, 2**31 - 1))).otherwise(F.col("raw"))
    return parts.select(*DOC, "pos", body.alias("body"), heading.alias("is_heading")).where("body != ''")


def section_title(body: Column, profile: Profile) -> Column:
    """The text itself where it is a section's title, else null."""
    return F.when((F.length(body) <= profile.max_title) & body.rlike(profile.any_of(profile.sections)), body)


def with_sections(paragraphs: DataFrame, profile: Profile) -> DataFrame:
    """Adds section: the last title up to and with the paragraph, empty before the first."""
    so_far = Window.partitionBy("task_id", "doc_id").orderBy("pos")
    return paragraphs.withColumn("section", F.coalesce(F.last(section_title(F.col("body"), profile), ignorenulls=True).over(so_far), F.lit("")))


def chunk_type(text: Column, profile: Profile) -> Column:
    """The first that holds: table parts by mark, legal and standard references, price and technical keywords."""
    return (
        F.when(F.startswith(text, F.lit(profile.header_mark)), "table_header")
        .when(F.startswith(text, F.lit(profile.table_mark)), "table_row")
        .when(text.rlike(profile.any_of(profile.legal)), "legal_ref")
        .when(text.rlike(profile.any_of(profile.standard)), "standard_ref")
        .when(hits(text, profile.price_words) >= 2, "price_param")
        .when(hits(text, profile.tech_words) >= 2, "tech_spec")
        .otherwise("normal")
    )


def least_length(kind: Column, profile: Profile) -> Column:
    """Characters below which a paragraph of this type is short."""
    return F.when(kind.isin("legal_ref", "standard_ref"), profile.min_chars_refs).otherwise(profile.min_chars)


def pack_sentences(text: Column, profile: Profile) -> Column:
    """Sentences of a long paragraph packed in order into pieces of at most `window` characters; a longer
    sentence stays whole, and pieces under `min_merged` characters are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        fits = F.length(state["open"]) + F.length(sentence) <= profile.window
        full = F.struct(F.when(state["open"] != "", F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), sentence.alias("open"))
        return F.when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], sentence).alias("open"))).otherwise(full)

    sentences = F.filter(F.split(text, profile.sentence_split), lambda s: strip(s) != "")
    packed = F.aggregate(sentences, start, add, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.filter(F.transform(packed, strip), lambda p: F.length(p) >= profile.min_merged)


def sliding_windows(text: Column, profile: Profile) -> Column:
    """Overlapping windows; the first that reaches the end is the last."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - profile.window) / profile.step).cast("int"), F.lit(0))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * profile.step + 1, F.lit(profile.window))))


def chunk_documents(docs: DataFrame, profile: Profile, page_map: DataFrame | None = None) -> DataFrame:
    """The chunks of documents, with ids, types, sections and pages.

    A heading is a chunk of its own; paragraphs over max_chars are packed by sentences; runs of short
    paragraphs of one section are joined by fives and kept from min_merged characters on. Chunks
    number from 0 within their document. page_map(doc_id, offset, page_num): pages by character
    offset; without it, or where a chunk's beginning isn't found, the page is 0.
    """
    p = with_sections(split_paragraphs(docs, profile), profile)
    short = ~F.col("is_heading") & (F.length("body") < least_length(chunk_type(F.col("body"), profile), profile))
    p = p.withColumn("short", short)
    in_doc = Window.partitionBy("task_id", "doc_id").orderBy("pos")
    goes_on = F.col("short") & F.lag("short", 1, False).over(in_doc) & (F.lag("section").over(in_doc) == F.col("section"))
    p = p.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(in_doc))
    nth = F.row_number().over(Window.partitionBy("task_id", "doc_id", "run").orderBy("pos")) - 1
    p = p.withColumn("part", F.floor(nth / profile.list_items))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"])
    g = p.groupBy(*DOC, "run", "part").agg(F.min("pos").alias("pos"), F.first("section").alias("section"), F.first("is_heading").alias("is_heading"), F.first("short").alias("short"), bodies.alias("bodies"))
    joined, first = strip(F.array_join("bodies", "\n")), F.get("bodies", F.lit(0))
    texts = (
        F.when(F.col("short"), F.filter(F.array(joined), lambda t: F.length(t) >= profile.min_merged))
        .when(~F.col("is_heading") & (F.length(first) > profile.max_chars), pack_sentences(first, profile))
        .otherwise(F.array(first))
    )
    c = g.select(*DOC, "pos", "section", "is_heading", F.posexplode(texts).alias("sub", "text"))
    index = F.row_number().over(Window.partitionBy("task_id", "doc_id").orderBy("pos", "sub")) - 1
    c = c.withColumn("chunk_index", index)
    doc = F.col("doc_id").cast("string")
    digest = F.substring(F.md5(F.concat_ws(":", doc, F.col("chunk_index").cast("string"), F.substring("text", 1, 50)).cast("binary")), 1, 8)
    c = c.select(
        *DOC,
        F.concat(doc, F.lit("_chunk_"), F.format_string("%04d", "chunk_index"), F.lit("_"), digest).alias("chunk_id"),
        "chunk_index",
        "text",
        F.col("section").alias("section_title"),
        chunk_type(F.col("text"), profile).alias("chunk_type"),
        "is_heading",
        F.length("text").alias("char_count"),
    )
    if page_map is None:
        return c.withColumn("page_num", F.lit(0))
    return look_up_pages(c, docs, page_map)


#: Characters of a chunk that are looked for. Fixed value.
PREFIX = 30
#: An odd base; windows are compared by polynomials in it modulo 2**64, and matches by their characters.
_BASE = 0x9E3779B97F4A7C15


def first_places(text: str, prefixes: list[str], block: int = 1 << 18) -> list[int]:
    """The first place of each prefix in the text, -1 where it doesn't occur.

    All windows of a prefix's length are hashed from running sums, a block of places at a time, and looked up among the
    prefixes of that length: the text is gone through once for each length that occurs, however many prefixes there are.
    """
    code = _codes(text)
    places = {p: 0 if not p else -1 for p in prefixes}
    for n in {len(p) for p in places if 0 < len(p) <= len(code)}:
        step = min(block, len(code))
        up = np.cumprod(np.r_[np.uint64(1), np.full(step + n, _BASE, np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(step, pow(_BASE, -1, 2**64), np.uint64)])
        by_key: dict[int, list[str]] = {}
        for p in (p for p in places if len(p) == n):
            by_key.setdefault(int(_window_hashes(_codes(p), n, up, back)[0]), []).append(p)
        keys = np.array(sorted(by_key), np.uint64)
        for at in range(0, len(code) - n + 1, block):
            window = _window_hashes(code[at : at + block + n - 1], n, up, back)
            k = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
            met = np.flatnonzero(keys[k] == window)
            for key, first in zip(*np.unique(k[met], return_index=True), strict=True):
                for p in by_key[int(keys[key])]:
                    if places[p] < 0:
                        places[p] = text.find(p, at + int(met[first]), at + block + n - 1)
            if len(met) and all(places[p] >= 0 for of in by_key.values() for p in of):
                break
    return [places[p] for p in prefixes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(code: np.ndarray, n: int, up: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hashes of all windows of n characters; up and back: powers of the base and of its inverse."""
    sums = np.r_[np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)])]
    return (sums[n:] - sums[:-n]) * back[: len(code) - n + 1]


def look_up_pages(chunks: DataFrame, docs: DataFrame, page_map: DataFrame) -> DataFrame:
    """As-of lookup: the page with the largest offset up to the first place of a chunk's first 30 characters; 0 where
    that isn't found or no page begins before it.

    A document's text is read once, beside the different beginnings of its chunks; from there on only places are
    carried. Pages and chunks of a document are then brought in order of place, and each takes the last page before it.
    """
    key = ["task_id", "doc_id"]
    c = chunks.withColumn("_prefix", F.substring("text", 1, PREFIX))
    wanted = c.groupBy(*key).agg(F.collect_set("_prefix").alias("prefixes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, prefixes = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                place = first_places(text, prefixes) if text is not None else [-1] * len(prefixes)
                same = [pa.repeat(batch.column(i)[row], len(prefixes)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(prefixes, pa.string()), pa.array(place, pa.int64())], ["task_id", "doc_id", "_prefix", "_place"])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    places = docs.select(*key, "text").join(wanted, key).mapInArrow(search, f"task_id {kind['task_id']}, doc_id {kind['doc_id']}, _prefix string, _place bigint")
    placed = c.join(places.groupBy(*key, "_prefix").agg(F.min("_place").alias("_place")), [*key, "_prefix"], "left").drop("_prefix")
    pages = page_map.select("doc_id", F.col("offset").cast("bigint").alias("_place"), F.col("page_num").alias("_page")).where("_place IS NOT NULL")
    both = placed.withColumn("_chunk", F.lit(True)).unionByName(pages, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("_place", F.col("_chunk").asc_nulls_first(), "_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.when(F.col("_place") >= 0, F.last("_page", ignorenulls=True).over(upto))
    return both.withColumn("page_num", F.coalesce(page, F.lit(0))).where("_chunk").select(*chunks.columns, "page_num")
