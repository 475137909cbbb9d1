"""Token counts of the sections of a document, by character offsets.

Each whole document is encoded once. Token spans in characters come from the lengths of the tokens'
bytes; an interval join by binary search over the sections' sorted starts finds the sections that a
token touches; an explicit rule allocates tokens that cross a border.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidscreen.llm.bpe import numpy_encoder, vocabulary
from bidscreen.llm.common import pieces

#: start: the section of the token's first character; majority: the one that holds most of its characters, the
#: first of several; split: each section its share of the characters.
RULES = ("start", "majority", "split")


def line_starts(text: str) -> list[int]:
    """The sections of a text: its lines, each with its line end."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that begin in it cross its end.

    first, last: place of each token's first and last character; starts: of the sections, sorted, the
    first at or before all tokens. Of sections with one start, all but the last are empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    n = len(starts)
    a, b = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, last, side="right") - 1
    crossing = np.bincount(a[b > a], minlength=n)
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float), crossing
    counts = np.bincount(a[a == b], minlength=n).astype(float)
    for f, e, x, y in zip(*(v[b > a].tolist() for v in (first, last, a, b)), strict=True):
        section = np.arange(x, y + 1)
        ends = np.r_[starts[x + 1 : y + 1], e + 1]
        share = ends - np.maximum(starts[x : y + 1], f)
        if rule == "split":
            counts[section] += share / share.sum()
        else:
            counts[section[np.argmax(share)]] += 1
    return counts, crossing


def _batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, rule: str):
    """Of each batch: ids column, tokens of each document, section starts in characters of the batch, sections of each document, counts, crossings, first character of each document."""
    encoder, v = numpy_encoder(tokenizer_path), vocabulary(tokenizer_path)
    for batch in pieces(batches, "text"):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids, at = encoder.encode(texts)
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(v.length[ids])
        first, last = character[end - v.length[ids]] if len(ids) else end, character[end - 1] if len(ids) else end
        base = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        own = [line_starts(t) for t in texts]
        sizes = np.array([len(o) for o in own], np.int64)
        starts = np.fromiter((s + b for o, b in zip(own, base.tolist(), strict=False) for s in o), np.int64, int(sizes.sum()))
        counts, crossing = allocate(first, last, starts, rule)
        yield batch.column(0), np.diff(at), starts, sizes, counts, crossing, base


def _bounds(starts: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sections begin and end in their documents."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    return starts - base[row], np.where(last, base[row + 1], np.r_[starts[1:], 0][: len(row)]) - base[row]


def count_by_section(docs: DataFrame, tokenizer_path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line of each document.

    Returns id_col, section (from 0), begin, end (characters of the text, the line end included),
    n_tokens (double; whole numbers unless rule is split), n_crossing (tokens that begin in the
    section and end behind it). A null or empty text has one empty section. Repeated rows each
    have their sections; columns other than the id and the text aren't read.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for ids, _, starts, sizes, counts, crossing, base in _batches(batches, tokenizer_path, rule):
            row = np.repeat(np.arange(len(sizes)), sizes)
            section = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin, end = _bounds(starts, sizes, base)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(section.astype(np.int32)), pa.array(begin), pa.array(end), pa.array(counts), pa.array(crossing.astype(np.int64))], names=["id", "section", "begin", "end", "n_tokens", "n_crossing"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, section int, begin bigint, end bigint, n_tokens double, n_crossing bigint").withColumnRenamed("id", id_col)


def count_with_sections(docs: DataFrame, tokenizer_path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document over the same sections: n_tokens, n_sections, n_crossing, max_section_tokens
    (double), section_crc32 (of the sections' counts as little-endian doubles, in order), and sections: all that
    count_by_section gives of them, in order (begin, end, n_tokens, n_crossing)."""
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for ids, tokens, starts, sizes, counts, crossing, base in _batches(batches, tokenizer_path, rule):
            begin = np.cumsum(sizes) - sizes
            most, cross = (np.maximum.reduceat(counts, begin), np.add.reduceat(crossing, begin)) if len(sizes) else (counts, crossing)
            raw = counts.astype("<f8").tobytes()
            crc = [zlib.crc32(raw[8 * b : 8 * (b + n)]) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            first, last = _bounds(starts, sizes, base)
            section = pa.StructArray.from_arrays([pa.array(first), pa.array(last), pa.array(counts), pa.array(crossing.astype(np.int64))], names=["begin", "end", "n_tokens", "n_crossing"])
            sections = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), section)
            yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.int64()), pa.array(sizes), pa.array(cross.astype(np.int64)), pa.array(most), pa.array(crc, pa.int64()), sections], names=["id", "n_tokens", "n_sections", "n_crossing", "max_section_tokens", "section_crc32", "sections"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n_tokens bigint, n_sections bigint, n_crossing bigint, max_section_tokens double, section_crc32 bigint, sections array<struct<begin: bigint, end: bigint, n_tokens: double, n_crossing: bigint>>").withColumnRenamed("id", id_col)


def count_by_document(docs: DataFrame, tokenizer_path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """count_with_sections without the sections themselves."""
    return count_with_sections(docs, tokenizer_path, rule, id_col, text_col).drop("sections")
