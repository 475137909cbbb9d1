"""Byte-level BPE over whole texts: encoding by batched numpy merge rounds, and decoding.

A text is cut into units at spaces and line ends, where the tokenizer's own pattern always cuts as
well; a unit's ids are found once and kept in a bounded cache, and the ids of a batch of texts are
gathered by numpy. Texts for which such cuts aren't safe go through the pattern itself.

Null texts count as empty. The text of an added token stands for that token's id, as in the
tokenizers library. Results have one row for each input row, repeated rows included; columns other
than the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bidscreen.llm.common import pieces

#: Fixed value: how byte-level BPE of this vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_words = regex.compile(WORDS)
#: Where three white-space characters meet, or two at the end, cuts at single spaces aren't the pattern's.
_unsafe = re.compile(r"\s\s(?:\s|\Z)|\x01")
#: Without any of these a text has no two white-space characters in a row: a quick test before the search.
_signs = ["  ", " \n", "\n ", "\n\n", "\x01", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Arrays of a byte-level BPE file: merges sorted by pair key, and each id's bytes in one flat array."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        characters = byte_characters()
        self.byte_id = np.array([vocab[c] for c in characters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        of = {c: b for b, c in enumerate(characters)}
        tokens = [b""] * self.size
        for token, i in vocab.items():
            tokens[i] = bytes(of[c] for c in token)
        for token, i in self.added.items():
            tokens[i] = token.encode()
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of each word's.

        Each round merges, in every word, all places of its lowest-ranked pair. Only pairs beside a
        merge are looked up anew; words without a pair that merges leave the rounds.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = self.ranks(symbols, word, np.arange(len(symbols)))
        done_symbols, done_words = [], []
        none = len(self.merged)
        while len(symbols):
            first = np.r_[True, word[1:] != word[:-1]]
            lowest = np.minimum.reduceat(rank, np.flatnonzero(first))
            best = lowest[np.cumsum(first) - 1]
            open_ = best < none
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            hit = rank == best
            if (twice := hit[1:] & hit[:-1]).any():  # of places that overlap, as in aaa, the first, third ... of a run are merged
                i = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.r_[False, twice], i, 0))
                hit &= (i - run) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            changed = hit | np.r_[hit[1:], False]
            symbols, word, rank, changed = symbols[keep], word[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            rank[at] = self.ranks(symbols, word, at)
        symbols, word = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
        return symbols[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merge rank of each symbol at those places with the one after it, by binary search over the sorted pair keys."""
        none = len(self.merged)
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[after]
        found = np.minimum(np.searchsorted(self.pair_keys, key), none - 1)
        return np.where((self.pair_keys[found] == key) & (word[at] == word[after]) & (after > at), self.pair_rank[found], none)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids in one flat array."""
        return gather(self.bytes, self.start[ids], self.length[ids])


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and length, one after another."""
    end = np.cumsum(length)
    return flat[np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)]


class _Numbers(dict):
    """Unit -> number; a unit that isn't there gets the next number and is put down in new."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, unit):
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class TextEncoder:
    """Ids of texts, by a cache of units.

    encode_units gives the ids of units in one array and the number of each unit's; max_units bounds the cache.
    """

    def __init__(self, encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], max_units: int = 600_000):
        self.encode_units, self.added, self.max_units = encode_units, added, max_units
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used, self.start, self.length = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list:
        if self.added and any(a in text for a in self.added):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.cut(text[at : m.start()]), (m.group(),)]
                at = m.end()
            return out + self.cut(text[at:])
        return self.cut(text)

    @staticmethod
    def cut(text: str) -> list[str]:
        if any(s in text for s in _signs) and _unsafe.search(text):
            return _words.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins (one more than texts)."""
        if len(self.numbers) > self.max_units:
            self.forget()
        get = self.numbers.__getitem__
        cut = [self.units(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        units = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.numbers.new:
            self.learn()
        length = self.length[units]
        ids = gather(self.flat, self.start[units], length)
        ends = np.r_[0, np.cumsum(length)]
        return ids, ends[np.r_[0, np.cumsum(sizes)]]

    def learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        added, length = self.encode_units([u for u in new if isinstance(u, str)])
        for i, u in enumerate(new):
            if not isinstance(u, str):  # an added token
                added = np.insert(added, int(length[:i].sum()), self.added[u[0]])
                length = np.insert(length, i, 1)
        if self.used + len(added) > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(max(len(added), len(self.flat)) * 2, np.uint32)]
        self.flat[self.used : self.used + len(added)] = added
        self.start = np.r_[self.start, self.used + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.used += len(added)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def numpy_encoder(path: str) -> TextEncoder:
    """An encoder whose units are merged by numpy rounds; kept by a Python worker from task to task."""
    v = vocabulary(path)

    def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, sizes = [], []
        for unit in units:
            cut = _words.findall(unit)
            sizes.append(len(cut))
            words += cut
        ids, counts = v.merge_words([w.encode() for w in words])
        ends = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(np.array(sizes, np.int64))]]
        return ids, np.diff(ends)

    return TextEncoder(encode_units, v.added)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> TextEncoder:
    """An encoder whose units go through the tokenizers library."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    return TextEncoder(encode_units, added)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids of every whole text and the text decoded from them.

    Returns id_col, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (string); without
    with_ids, their SHA-256 digests ids_sha256 and decoded_sha256 instead, so that the arrays stay
    in the Python workers. A null text has no ids and decodes as empty; an empty table gives none.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    values = [("ids", pa.binary()), ("decoded", pa.string())] if with_ids else [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = f"id {kept.schema['id'].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"{n} {'binary' if t == pa.binary() else 'string'}" for n, t in values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = numpy_encoder(tokenizer_path), vocabulary(tokenizer_path)
        for batch in pieces(batches, "text"):
            ids, at = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            raw = ids.astype("<u4", copy=False)
            flat = v.decode(ids)
            ends = np.r_[0, np.cumsum(v.length[ids])][at]
            rows = [(raw[a:b].tobytes(), flat[c:d].tobytes()) for a, b, c, d in zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True)]
            if with_ids:
                first, second = [r[0] for r in rows], [r[1].decode("utf-8", "replace") for r in rows]
            else:
                first = [hashlib.sha256(r[0]).hexdigest() for r in rows]
                second = [hashlib.sha256(r[1] if _valid(r[1]) else r[1].decode("utf-8", "replace").encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(first, values[0][1]), pa.array(second, values[1][1])], names=["id", "n_tokens", values[0][0], values[1][0]])

    return kept.mapInArrow(run, out).withColumnRenamed("id", id_col)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True
