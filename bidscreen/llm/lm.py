"""Language-model scoring by logistic context mixing of bits.

A text is the bytes of its lower-cased form and an end. Each bit of a byte is predicted from several contexts: one, two,
four and five bytes before it, and a hash of its whole word as far as it has come, however long (of the six bytes before
it where the word is shorter). Spark gathers how often either bit came next in all training documents, each context by
itself: what is kept grows with the texts. Contexts of four bytes and more are counted in buckets by their last four
bytes; those of one and two bytes, of which there are 2^24 with their next byte at most, are sums over all buckets and
sent to them. Buckets get their keys over levels: each level merges a fixed number of messages and then deals them to
more buckets, so neither a message's size nor a group grows with the number of parts.

A gate, the bit's place and how much the two longest contexts have seen, chooses the
weights that mix the predictions in the logistic domain; an adaptive map by bit history refines
the mixture. Weights and map are learned online in each bucket of contexts, from the predictions of all training
documents, and averaged; own counts are left out. They stay as learned while texts are scored, so that a text's score
doesn't depend on what is scored beside it. The probability of a text is the product over its bits, so the score is its
total bits in log10 units.

Beside it stands a smoothed unigram score of words, whose counts are those of all training documents:
the frequent words are broadcast up to a fixed number, the others joined.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidscreen.llm.common import byte_values, materialize, mix, pieces, powers, release

U = np.uint64
END = b"\xff"
#: Bytes before a byte: those that choose its bucket, those of contexts that are sums over buckets (at most), those that a
#: key has as they are (at most), and ends before each text.
LAST, SHORT, EXACT, BEFORE = 4, 2, 5, 8
#: Bytes of text in one part, in one step of its work, and a bucket's share of all texts.
PART_BYTES, STEP_BYTES, BUCKET_BYTES = 8 << 20, 1 << 18, 16 << 20
#: Messages merged at once, about, and buckets that a part is dealt to at first.
FAN, WIDTH = 256, 1024


@dataclass(frozen=True)
class Settings:
    """orders: bytes of the contexts beside the whole word, rising, 1 to SHORT and LAST to EXACT; least: bytes of the
    word's context where the word is shorter (5 or 6); head: words whose counts are broadcast, at most; rate: of learning;
    map_steps: cells of the map for each node; rounds: passes that learn weights and map."""

    orders: tuple[int, ...] = (1, 2, 4, 5)
    least: int = 6
    head: int = 300_000
    rate: float = 0.06
    map_steps: int = 24
    rounds: int = 1

    def __post_init__(self):
        if not self.orders or list(self.orders) != sorted(set(self.orders)) or not set(self.orders) <= {*range(1, SHORT + 1), *range(LAST, EXACT + 1)}:
            raise ValueError(f"orders rise, from 1 to {SHORT} and from {LAST} to {EXACT}")
        if not EXACT <= self.least <= EXACT + 1:
            raise ValueError(f"least is {EXACT} or {EXACT + 1}")

    @property
    def n(self) -> int:
        """Contexts of a bit."""
        return len(self.orders) + 1


def plain_bytes(text: str | None) -> bytes:
    """A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower()


def joined(raws: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts one after another, each with BEFORE ends before it, so that the first of them ends the text before; and their lengths."""
    return b"".join(END * BEFORE + r for r in raws) + END, np.array([len(r) for r in raws], np.int64)


def steps_of(blob: bytes, sizes: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of joined texts, a bounded number of bytes at a time: the texts that have bytes there (their ends count as such),
    how many each has, and the key of each byte: from the top the EXACT bytes before it, latest first, 16 bits of its
    longest context's hash, and itself. A word that goes on from step to step carries its hash along."""
    start = np.cumsum(sizes + BEFORE) - sizes
    carried, length = np.zeros(1, U), 0
    for x in range(BEFORE, len(blob), STEP_BYTES):
        y = min(x + STEP_BYTES, len(blob))
        own = np.frombuffer(blob, np.uint8, y - x + BEFORE, x - BEFORE)
        new = own[BEFORE:]
        powers.reach(len(new) + 1)
        sums = np.r_[U(0), np.cumsum(byte_values[new] * powers.up[: len(new)])]
        place = np.arange(len(new) + 1)
        begin = np.maximum.accumulate(np.r_[0, np.where((new <= 0x20) | (new == 0xFF), place[1:], 0)])  # of the word before each place; 0: before the step
        goes_on = begin == 0
        so_far = np.where(goes_on, carried + U(pow(int(powers.step), length, 2**64)) * sums, (sums - sums[begin]) * powers.down[begin])
        so_long = place - begin + length * goes_on
        carried, length = so_far[-1:], int(so_long[-1])
        first, last = np.searchsorted(start + sizes, x), np.searchsorted(start, y)
        low, high = np.maximum(start[first:last], x), np.minimum(start[first:last] + sizes[first:last] + 1, y)
        n = np.maximum(high - low, 0)
        if not n.sum():
            continue
        at = np.repeat(low - x - (np.cumsum(n) - n), n) + np.arange(n.sum())
        before = np.ndarray((len(new),), "<u8", own.tobytes(), strides=(1,))[at]
        sixth = (before >> U(16)) & U(255 if settings.least > EXACT else 0)  # as it is: it packs better than a hash
        tag = np.where(so_long[at] > settings.least, mix(so_far[at], 4) >> U(48), sixth)
        yield np.arange(first, last), n, (before >> U(64 - 8 * EXACT) << U(64 - 8 * EXACT)) | (tag << U(8)) | new[at]


def context(key: np.ndarray, order: int) -> np.ndarray:
    """The context of each key's byte: so many bytes before it, or for more than EXACT its word's."""
    return key >> U(64 - 8 * order if order <= EXACT else 8)


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """Of a power of two; fewer buckets are unions of them: the numbers' lower bits."""
    return (mix(context(key, LAST), 3) & U(n_buckets - 1)).astype(np.int64)


def counted(values: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct values, rising, and the sum of each weight; of no weights, how often each value comes."""
    if weights:
        order = np.argsort(values, kind="stable")  # merges what are rising stretches
        values, weights = values[order], [w[order] for w in weights]
    else:
        values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    if not weights:
        return values[first], np.diff(np.r_[first, len(values)])
    return values[first], *(np.add.reduceat(w, first) if len(first) else w for w in weights)


def packed_bytes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def part_counts(blob: bytes, sizes: np.ndarray, often: np.ndarray, once: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a part's texts, rising, and how many of its texts' bytes make them where the texts' marks
    often and once hold."""
    held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    kind = often + 2 * once

    def together() -> None:
        held[:] = [counted(*(np.concatenate(c) for c in zip(*held, strict=True)))]

    for texts, n, key in steps_of(blob, sizes, settings):
        own = np.repeat(kind[texts], n)
        for k in np.unique(kind[texts]).tolist():
            found, times = counted(key[own == k])
            held.append((found, (times * (k % 2)).astype(np.int32), (times * (k // 2)).astype(np.int32)))
        if sum(len(h[0]) for h in held[1:]) > max(250_000, len(held[0][0])):
            together()
    together()
    return held[0]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logit of a counted bit, smoothed."""
    return (np.log(n1 + 0.04) - np.log(n0 + 0.04)).astype(np.float32)


def trust(n: np.ndarray) -> np.ndarray:
    """How much a context has seen: none, little, some, much."""
    return (n >= 1).astype(np.uint8) + (n >= 4) + (n >= 32)


def steps(byte: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each of the eight bits of a byte: its place, the bits before it as a node of the tree, and the bit."""
    for t in range(8):
        yield t, (1 << t) | (byte >> (8 - t)), (byte >> (7 - t)) & 1


@dataclass
class Mixer:
    """Weights of each gate, and the map that refines the mixture by node and by its logit."""

    settings: Settings
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def new(settings: Settings) -> Mixer:
        """Equal weights, and a map that changes nothing."""
        weights = np.full((8 * 16, settings.n + 1), 0.3, np.float32)
        weights[:, -1] = 0
        middle = 1 / (1 + np.exp(-(np.arange(settings.map_steps) * (24 / (settings.map_steps - 1)) - 12)))
        return Mixer(settings, weights, np.tile(middle, 257).astype(np.float32))

    def cell(self, node: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the map on either side of a logit (the lower one), and the share of the upper."""
        n = self.settings.map_steps
        x = (np.clip(logit, -11.99, 11.99) + 12) * ((n - 1) / 24)
        low = x.astype(np.int64)
        return node * n + low, (x - low).astype(np.float32)

    def logit(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """The weighted sum of the inputs and a bias."""
        total = self.weights[:, -1][gate]
        for i, x in enumerate(inputs):
            total += self.weights[:, i][gate] * x
        return total

    def cost(self, logit: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each bit: the mean of the mixture and its refinement."""
        low, share = self.cell(node, logit)
        p = 0.5 / (1 + np.exp(-np.clip(logit, -30, 30))) + 0.5 * (self.refined[low] * (1 - share) + self.refined[low + 1] * share)
        p = np.clip(p, 1e-5, 1 - 1e-5)
        return np.log(np.where(bit == 1, p, 1 - p))


def short_counts(key: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SHORT bytes, next byte) as a number of 24 bits, rising, and how often it comes."""
    return counted((context(key, SHORT) << U(8)) | (key & U(255)), often)


class Bucket:
    """Keys whose contexts end alike, with the counts of all their contexts: those of LAST bytes and more aren't counted
    elsewhere, those of up to SHORT bytes are `short`'s."""

    def __init__(self, key: np.ndarray, often: np.ndarray, settings: Settings, short: tuple[np.ndarray, np.ndarray]):
        self.byte, self.counted = (key & U(255)).astype(np.int64), []
        for order in (*settings.orders, EXACT + 1):
            c = context(key, order)
            # few (context, byte) for many keys: what their nodes have seen is summed up there
            pair, number = np.unique((c << U(8)) | (key & U(255)), return_inverse=True)
            if order <= SHORT:
                every, count = counted((short[0] >> U(8 * (SHORT + 1 - order)) << U(8)) | (short[0] & U(255)), short[1])
                here = np.isin(every >> U(8), pair >> U(8))
                self.counted.append((every[here], np.searchsorted(every[here], pair)[number].astype(np.int32), count[here]))
            else:
                self.counted.append((pair, number.astype(np.int32), np.bincount(number, often, len(pair))))

    def features(self, without_own: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, gates, nodes and bits of each of the eight bits of all keys."""
        for t, node, bit in steps(self.byte):
            inputs, seen = [], []
            for i, (pair, number, count) in enumerate(self.counted):
                prefix = pair >> U(8 - t)
                of = np.cumsum(np.r_[False, prefix[1:] != prefix[:-1]])
                one = ((pair >> U(7 - t)) & U(1)).astype(np.float64)
                n = np.bincount(of, count)[of]
                n1 = np.bincount(of, count * one)[of]
                n0 = n - n1
                if without_own:
                    n1, n0 = np.maximum(n1 - one, 0), np.maximum(n0 - (1 - one), 0)
                inputs.append(stretch(n0, n1)[number])
                if i >= len(self.counted) - 2:
                    seen.append(trust(n0 + n1)[number].astype(np.int64))
            yield inputs, (t * 4 + seen[-1]) * 4 + seen[-2], node, bit


def learn_bucket(bucket: Bucket, once: np.ndarray, mixer: Mixer, batch: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's weights, what each gate has seen, and ones and all of each cell of the map, from the weights of the
    mixer on; once: how often training texts make each key. Each key's own occurrence is taken out."""
    own = Mixer(mixer.settings, mixer.weights.copy(), mixer.refined)
    gates, cells = len(own.weights), 257 * mixer.settings.map_steps
    weight, ones, seen = np.zeros(gates), np.zeros(cells), np.zeros(cells)
    used = np.random.default_rng(5).permutation(np.flatnonzero(once))
    for inputs, gate, node, bit in bucket.features(without_own=True):
        for a in range(0, len(used), batch):
            rows = used[a : a + batch]
            x, g, y, m = [v[rows] for v in inputs], gate[rows], bit[rows], once[rows]
            logit = own.logit(x, g)
            share = m / m.mean()
            error = share * (y - 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            step = np.stack([np.bincount(g, error * v, gates) for v in [*x, 1.0]], axis=1)
            step /= np.sqrt(np.maximum(np.bincount(g, share, gates), 1))[:, None]
            own.weights += np.clip(mixer.settings.rate * 0.5 * step, -0.05, 0.05).astype(np.float32)
            weight += np.bincount(g, m, gates)
            low, upper = own.cell(node[rows], logit)
            near = low + (upper > 0.5)
            ones += np.bincount(near, m * y, cells)
            seen += np.bincount(near, m, cells)
    return own.weights, weight, ones, seen


def find_bucket(bucket: Bucket, mixer: Mixer) -> np.ndarray:
    """Natural logarithm of the probability of each key's byte."""
    out = np.zeros(len(bucket.byte))
    for inputs, gate, node, bit in bucket.features(without_own=False):
        out += mixer.cost(mixer.logit(inputs, gate), node, bit)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            release()


def _parts(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, held_out, text) some at a time: part, doc_ids, held_out, sizes, n_bytes and their joined bytes, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 20, [], 0

        def row() -> pa.RecordBatch:
            raws = [plain_bytes(t) for b in held for t in b.column(2).to_pylist()]
            blob, sizes = joined(raws)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(raws)], pa.int32()), pa.concat_arrays([b.column(i) for b in held])) for i in (0, 1)]
            blobs = [pa.array([b], pa.binary()) for b in (packed_bytes(sizes), packed_bytes(np.frombuffer(blob, np.uint8)))]
            return pa.RecordBatch.from_arrays([pa.array([part]), *lists, blobs[0], pa.array([int(sizes.sum())]), blobs[1]], names=["part", "doc_ids", "held_out", "sizes", "n_bytes", "bytes"])

        for piece in pieces(batches, "text", STEP_BYTES):
            held.append(piece)
            size += (pa.compute.sum(pa.compute.binary_length(piece.column(2))).as_py() or 0) + 16 * piece.num_rows
            if size >= PART_BYTES:
                yield row()
                part, held, size = part + 1, [], 0
        if held:
            yield row()

    return materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, f"part bigint, doc_ids array<{kind}>, held_out array<boolean>, sizes binary, n_bytes bigint, bytes binary"), "parts")


@dataclass
class Levels:
    """Tables (bucket, group, key, often, more, members, back) of merged messages: of parts first, of the groups before then;
    the last has one row for each bucket. more: what copies add, nearly always nothing; back: which of the row's keys each
    member has. widths: buckets of each table."""

    tables: list[DataFrame]
    widths: list[int]

    @property
    def top(self) -> DataFrame:
        return self.tables[-1]


def _messages(bucket: np.ndarray, member: int, key: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """Keys dealt to buckets, rising in each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    blobs = [pa.array([packed_bytes(x) for x in np.split(v[order], first[1:])] if len(first) else [], pa.binary()) for v in (key, *(c.astype(np.uint32) for c in counts))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.full(len(first), member)), *blobs], names=["bucket", "member", "key", "often", "more"])


def _levels(parts: DataFrame, settings: Settings) -> Levels:
    """The distinct keys of all parts by bucket, how often training documents make them, how often only copies within a part
    do, and which of them each part has."""
    found = parts.agg(F.sum("n_bytes"), F.count("*")).first()
    n_buckets = 1 << max(6, (max(1, -(-(found[0] or 0) // BUCKET_BYTES)) - 1).bit_length())
    width, groups, out = min(n_buckets, WIDTH), max(1, found[1]), Levels([], [])
    message = "bucket bigint, member bigint, key binary, often binary, more binary"

    def send(batches: Iterator[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            sizes, blob = unpacked(row["sizes"], np.int64), unpacked(row["bytes"], np.uint8).tobytes()
            often = 1 - np.array(row["held_out"], np.int64)
            begin = np.cumsum(sizes + BEFORE) - sizes
            text = [hash(blob[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
            once = np.zeros_like(often)
            once[np.flatnonzero(often)[np.unique(np.array(text, np.int64)[often == 1], return_index=True)[1]]] = 1
            key, often, once = part_counts(blob, sizes, often, once, settings)
            yield _messages(bucket_of(key, width), row["part"], key, often, often - once)

    def merge(given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("member")
        own = [unpacked(b, U) for b in given.key]
        key, number = np.unique(np.concatenate(own), return_inverse=True)
        counts = [packed_bytes(np.bincount(number, np.concatenate([unpacked(b, np.uint32) for b in given[c]]), len(key)).astype(np.uint32)) for c in ("often", "more")]
        back = [packed_bytes(np.diff(x, prepend=0).astype(np.int32)) for x in np.split(number, np.cumsum([len(k) for k in own])[:-1])]  # rising, as a member's keys are
        return pd.DataFrame({"bucket": given.bucket.iloc[:1], "group": given.group.iloc[:1], "key": [packed_bytes(key)], "often": counts[:1], "more": counts[1:], "members": [list(given.member)], "back": [back]})

    sent = parts.select("part", "held_out", "sizes", "bytes").mapInArrow(send, message)
    while True:
        groups = -(-groups // FAN)
        grouped = sent.withColumn("group", F.pmod(F.xxhash64("member"), F.lit(groups))).groupBy("bucket", "group")
        merged = grouped.applyInPandas(merge, "bucket bigint, group bigint, key binary, often binary, more binary, members array<bigint>, back array<binary>")
        out.tables.append(materialize(merged, "buckets"))
        out.widths.append(width)
        if groups == 1 and width == n_buckets:
            return out
        width = min(n_buckets, width * FAN)

        def deal(batches: Iterator[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                key = unpacked(row["key"], U)
                yield _messages(bucket_of(key, width), row["group"], key, unpacked(row["often"], np.uint32), unpacked(row["more"], np.uint32))

        sent = out.top.select("group", "key", "often", "more").mapInArrow(deal, message)


def _short_table(buckets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """short_counts of all buckets: 2^24 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, U), np.zeros(0))]
        for row in _rows(batches):
            held.append(short_counts(unpacked(row["key"], U), unpacked(row["often"], np.uint32).astype(np.float64)))
            held[:] = [counted(*(np.concatenate(c) for c in zip(*held, strict=True)))]
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], names=["pair", "n"])

    table = buckets.select("key", "often").mapInArrow(run, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    return table.column("pair").to_numpy().astype(U), table.column("n").to_numpy()


def _opened(row: dict, settings: Settings, short: tuple[np.ndarray, np.ndarray]) -> Bucket:
    return Bucket(unpacked(row["key"], U), unpacked(row["often"], np.uint32).astype(np.float64), settings, short)


def learn_mixer(buckets: DataFrame, settings: Settings, short: tuple[np.ndarray, np.ndarray]) -> Mixer:
    """Weights and map: learned online in each bucket from the same beginning, and averaged by what each gate and cell has seen."""
    mixer = Mixer.new(settings)
    start, gates = mixer.refined.astype(np.float64), len(mixer.weights)
    shapes = [gates * (settings.n + 1), gates, len(start), len(start)]
    for _ in range(settings.rounds):
        shared = buckets.sparkSession.sparkContext.broadcast((mixer, short))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat = np.zeros(sum(shapes))
            for row in _rows(batches):
                once = unpacked(row["often"], np.uint32).astype(np.float64) - unpacked(row["more"], np.uint32)
                w, seen, *cells = learn_bucket(_opened(row, settings, shared.value[1]), once, shared.value[0])
                flat += np.concatenate([(w * seen[:, None]).ravel(), seen, *cells])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "x"])

        sums = buckets.select("key", "often", "more").mapInArrow(learn, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(sum(shapes))
        flat[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
        weights, seen, ones, all_ = np.split(flat, np.cumsum(shapes)[:-1])
        mean = weights.reshape(gates, -1) / np.maximum(seen, 1)[:, None]
        mixer = Mixer(settings, np.where(seen[:, None] > 0, mean, mixer.weights).astype(np.float32), ((start * 30 + ones) / (30 + all_)).astype(np.float32))
    return mixer


def _values(levels: Levels, mixer: Mixer, short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(part, v): of each part the keys of its texts and their natural log-probabilities. They are found in the last level's
    buckets and handed down from level to level, to each member those of its own keys."""
    shared = levels.top.sparkSession.sparkContext.broadcast((mixer, short))
    given = levels.top
    for level in range(len(levels.tables) - 1, -1, -1):
        width, below = levels.widths[level], levels.widths[level - 1] if level else 0
        above = levels.widths[level + 1] if level + 1 < len(levels.tables) else 0

        def answer(batches: Iterator[pa.RecordBatch], width=width, above=above, below=below) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                key = unpacked(row["key"], U)
                if above:
                    value, finer = np.empty(len(key), np.float32), bucket_of(key, above)
                    for x in row["v"]:
                        value[finer == x["finer"]] = unpacked(x["value"], np.float32)
                else:
                    value = find_bucket(_opened(row, shared.value[0].settings, shared.value[1]), shared.value[0]).astype(np.float32)
                for member, back in zip(row["members"], row["back"], strict=True):
                    at = np.cumsum(unpacked(back, np.int32))
                    keys = b"" if below else packed_bytes(key[at])
                    bucket = row["bucket"] & (below - 1) if below else 0
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([member], pa.int64()), pa.array([row["bucket"]]), pa.array([keys], pa.binary()), pa.array([packed_bytes(value[at])], pa.binary())], names=["bucket", "group", "finer", "key", "value"])

        own = given.select("bucket", "key", *([] if above else ["often"]), "members", "back", *(["v"] if above else []))
        found = own.mapInArrow(answer, "bucket bigint, group bigint, finer bigint, key binary, value binary")
        if level:
            given = levels.tables[level - 1].join(found.groupBy("bucket", "group").agg(F.collect_list(F.struct("finer", "value")).alias("v")), ["bucket", "group"])
    return found.groupBy(F.col("group").alias("part")).agg(F.collect_list(F.struct("key", "value")).alias("v"))


def part_scores(blob: bytes, sizes: np.ndarray, key: np.ndarray, value: np.ndarray, settings: Settings) -> np.ndarray:
    """Log10 probability of each text of a part; key, value: the log-probabilities of all keys of its texts."""
    order = np.argsort(key, kind="stable")  # merges the buckets' keys, which rise
    key, value = key[order], value[order].astype(np.float64)
    out = np.zeros(len(sizes))
    for texts, n, own in steps_of(blob, sizes, settings):
        order = np.argsort(own)
        rising = own[order]
        new = np.r_[True, rising[1:] != rising[:-1]]
        of = np.empty(len(own))
        of[order] = value[np.searchsorted(key, rising[new])][np.cumsum(new) - 1]
        some = np.flatnonzero(n)
        out[texts[some]] += np.add.reduceat(of, (np.cumsum(n) - n)[some])
    return out / np.log(10)


def gather_words(train: DataFrame) -> DataFrame:
    """(word, c) of every distinct word of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, times = list(held.keys()), list(held.values())
            for a in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 20_000], pa.binary()).cast(pa.string()), pa.array(times[a : a + 20_000], pa.int64())], names=["word", "c"])
            held.clear()

        for batch in pieces(batches, "text"):
            for text in batch.column(0).to_pylist():
                held.update(plain_bytes(text).split())
            if len(held) > 300_000:
                yield from rows()
        yield from rows()

    return train.select("text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


_known: dict = {}


def known_words(key: str, shared) -> tuple[dict[bytes, int], np.ndarray]:
    """What a Python worker needs of the frequent words, made once and kept from task to task."""
    if _known.get("of") != key:
        known, logs = shared.value
        _known.update(of=key, made=({w: i for i, w in enumerate(known)}, logs))
    return _known["made"]


def score_documents(docs: DataFrame, held_out: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by a model of those for which held_out doesn't hold (null: holds not).

    Returns id_col, held_out, n_tokens (words between ASCII white space, A-Z lower-cased, and one
    end), n_known (tokens that training texts have), train_tokens, base_score (log10 of the
    smoothed unigram probability) and score (the mixing model's log10 probability). A null text is
    empty: its end alone. Repeated rows are scored each on its own, alike; without training
    documents all bits are even guesses and base_score is 0; extra columns aren't read.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    parts = _parts(plain)
    words = materialize(gather_words(plain.where(~F.col("held_out"))), "words")
    ends = parts.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    by_count = words.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c"))
    total, distinct, room, least = ends, int(ends > 0), settings.head, None
    for row in by_count.toLocalIterator():
        total, distinct = total + row["c"] * row["words"], distinct + row["words"]
        if room is not None and row["words"] <= room:
            room, least = room - row["words"], row["c"]
        else:
            room = None
    least = least if least is not None else 2**62
    below = total + 0.5 * (distinct + 1)
    head = words.where(F.col("c") >= least).toArrow()
    shared = spark.sparkContext.broadcast(([w.encode() for w in head.column("word").to_pylist()], np.log10((head.column("c").to_numpy() + 0.5) / below)))
    end_score = float(np.log10((ends + 0.5) / below))
    del head
    levels = _levels(parts, settings)
    short = _short_table(levels.top)
    values = _values(levels, learn_mixer(levels.top, settings, short), short)
    key_of_words = uuid.uuid4().hex
    kind = plain.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, logs = known_words(key_of_words, shared)
        get = number.get
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, blob = unpacked(batch.column(3)[i].as_py(), np.int64), unpacked(batch.column(4)[i].as_py(), np.uint8).tobytes()
                pairs = batch.column(5)[i].as_py()
                score = part_scores(blob, sizes, np.concatenate([unpacked(p["key"], U) for p in pairs]), np.concatenate([unpacked(p["value"], np.float32) for p in pairs]), settings)
                del pairs
                release()
                begin = np.cumsum(sizes + BEFORE) - sizes
                rows = (batch.column(0)[i].as_py() << 24) + np.arange(len(sizes))
                n_tokens, n_known, base, row, word, times = [], [], [], [], [], []
                for r, a, n in zip(rows.tolist(), begin.tolist(), sizes.tolist(), strict=True):
                    own = blob[a : a + n].split()
                    at = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                    found = at[at >= 0]
                    n_tokens.append(len(own) + 1)
                    n_known.append(len(found) + (ends > 0))
                    base.append(float(logs[found].sum()) + end_score)
                    if len(found) < len(own):
                        for w, k in Counter(own[j] for j in np.flatnonzero(at < 0).tolist()).items():
                            row.append(r)
                            word.append(w)
                            times.append(k)
                n, ids = len(rows), batch.column(1)[i].values
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, batch.column(2)[i].values, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
                n = len(row)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.nulls(n, ids.type), pa.nulls(n, pa.bool_()), *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array(word, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=names)

    joined_parts = parts.join(values, "part").select("part", "doc_ids", "held_out", "sizes", "bytes", "v")
    rows = materialize(joined_parts.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, word string, times bigint"), "scores")
    rest = rows.where("word IS NOT NULL").select("row", "word", "times").join(words.where(F.col("c") < least), "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(below))
    rest = rest.groupBy("row").agg(F.sum(log * F.col("times")).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"))
    out = rows.where("word IS NULL").join(rest, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
