"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures before exact intersections.

A document is the set of its word shingles, as sorted 64-bit hashes; equal sets are one from the
start. Under one order of all shingles, those that many sets share last, two sets that link share
one of the first fifth or so of either: sets that share such a shingle form a tile, sorted and
banded by size. The place of the shared shingle in either order bounds the overlap, so most pairs of a
tile are refused at once. Of the rest, bit counts of parity bitmaps bound the overlap of two sets from
above; pairs that pass are decided by intersecting the sorted arrays.

Small tiles give all their pairs. Copies and near copies make large ones, which would give the square of their
size: there each set goes first with the two outer ids of its band alone. Links are found in rounds, of
each set with its outer partners, then of what isn't connected yet; only sets of large tiles that are still
in different components are compared all with all, in blocks. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidscreen.llm.common import byte_values, materialize, mix, pieces, powers, release

U = np.uint64
#: Sets of a tile that give all pairs at once, rows worked on at a time, and sets of a block of a large tile.
SMALL_TILE, RUN_ROWS, BLOCK_SETS = 16, 1 << 20, 4096
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and where each word begins."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.zeros(0, U), np.zeros(0, np.int64)
    powers.reach(len(a) + 1)
    space = _space[a]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    total = np.r_[U(0), np.cumsum(byte_values[a] * powers.up[: len(a)])]
    return mix((total[end] - total[begin]) * powers.down[begin] + (end - begin).astype(U)), begin


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text, A-Z lower-cased; fewer words are one shingle."""
    raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    h, begin = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    last = np.searchsorted(begin, ends)
    first = np.r_[0, last[:-1]]
    if len(h) >= words:
        shingles = h[: len(h) - words + 1].copy()
        for j in range(1, words):
            shingles = shingles * U(0xD6E8FEB86659FD93) + h[j : len(h) - words + 1 + j]
        shingles = mix(shingles, 1).view(np.int64)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:
            whole = U(b - a)
            for x in h[a:b]:
                whole = U((int(whole) * 0xD6E8FEB86659FD93 + int(x)) % 2**64)
            out.append(mix(np.array([whole]), 2).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit sum that names a set."""
    return int((mix(s.view(U), 3).sum(dtype=U, keepdims=True) + mix(np.array([len(s)], U), 4)).view(np.int64)[0])


def signature(s: np.ndarray) -> bytes:
    """A bitmap of parities: a bit is set if an odd number of members hash to it. It has twice as many bits as
    the set has members, or up to four times, as a power of 2."""
    bits = 1 << max(10, (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures of `width` words: members that meet in a bit change its parity, so halves are put together by xor."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def words_of(signatures: list[bytes], width: int) -> np.ndarray:
    """Signatures folded to one width, a row of 64-bit words each."""
    return np.array([fold(np.frombuffer(x, U), width) for x in signatures], U).reshape(len(signatures), width)


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members whose signatures differ in `apart` bits may link: at most
    (n + m - apart) / 2 members are common."""
    common = (n + m - apart) // 2
    return 100 * common >= percent * (n + m - common)


def _chunks(batches: Iterator[pa.RecordBatch], words: int):
    for batch in pieces(batches, "text"):
        yield batch, shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), words)


def _describe(docs: DataFrame, words: int, often: int) -> DataFrame:
    """A row for each document: doc_id, text_key, n, set_id; and rows (shingle, times) of those that a
    chunk of documents holds at least `often` times."""
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n bigint, set_id bigint, shingle bigint, times bigint"
    names = ["doc_id", "text_key", "n", "set_id", "shingle", "times"]

    def run(batches):
        held: list[np.ndarray] = []
        size, kind = 0, None

        def frequent() -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shingle, times = shingle[times >= often], times[times >= often]
            none = [pa.nulls(len(shingle), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(shingle), pa.array(times)], names=names)

        for batch, sets in _chunks(batches, words):
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), *[pa.nulls(len(sets), pa.int64())] * 2], names=names)
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                yield frequent()
                size = 0
        if held:
            yield frequent()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, out)


def _ordered_prefix(s: np.ndarray, percent: int, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, so many that each set that links with it has one of them among its own first.
    values: shingles that come last in the order, sorted; ranks: the order among them."""
    p = len(s) - -(-percent * len(s) // 100) + 1
    if not len(values):
        return s[:p]
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    late = values[at] == s
    prefix = s[~late][:p]
    if len(prefix) < p:
        prefix = np.r_[prefix, s[late][np.argsort(ranks[at[late]], kind="stable")][: p - len(prefix)]]
    return prefix


def _prefixes(docs: DataFrame, words: int, percent: int, late: np.ndarray, places: bool) -> DataFrame:
    """Rows of each shingle of a set's prefix: (tile, n, place, set_id) or, without places, the shingle alone. late:
    the frequent shingles, rising in frequency, which come last in the order."""
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late, kind="stable")))

    def run(batches):
        values, ranks = shared.value
        seen: set[int] = set()
        for _, sets in _chunks(batches, words):
            prefixes, ids, n = [], [], []
            for s in sets:
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(i)
                prefixes.append(_ordered_prefix(s, percent, values, ranks))
                ids.append(i)
                n.append(len(s))
            if not prefixes:
                continue
            columns = [np.concatenate(prefixes)]
            if places:
                size = np.array([len(p) for p in prefixes])
                columns += [np.repeat(np.array(n, np.int64), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.array(ids, np.int64), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "n", "place", "set_id"][: len(columns)])

    return docs.select("text").mapInArrow(run, "tile bigint, n bigint, place bigint, set_id bigint" if places else "tile bigint")


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1, least: int = 0) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows of sorted batches as numpy arrays, `least` or more at a time, cut where the first `keys` columns change; and
    whether the end cuts nevertheless through a tile, as it does in one of very many rows."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            new[1:] |= columns[c][1:] != columns[c][:-1]
            new[0] |= bool(held) and held[-1][c][-1] != columns[c][0]
        border = np.flatnonzero(new)
        if len(border) and size + border[-1] > least:
            held.append([c[: border[-1]] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)], False
            held, size, columns = [], 0, [c[border[-1] :] for c in columns]
        held.append(columns)
        size += len(columns[0])
        if size >= RUN_ROWS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)], True
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)], False
    del held
    release()


def _shared(rows: DataFrame, most: int) -> np.ndarray:
    """The shingles that most prefixes share, `most` at most, rising in their number.

    Which ones come last in the order changes the work, not the result, so a bound is harmless here.
    """

    def run(batches):
        for (shingles,), _ in _runs(batches, least=100_000):
            found, n = np.unique(shingles, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["shingle", "n"])

    counted = materialize(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "shingle bigint, n bigint"), "shared")
    least = 2
    room = most
    for row in counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        least, room = row["n"], room - row["c"]
        if room < 0:
            least += 1
            break
    found = counted.where(F.col("n") >= least).toArrow()
    n = found.column("n").to_numpy()
    return found.column("shingle").to_numpy()[np.argsort(n, kind="stable")]


def overlap_allows(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members whose first common shingle has the places i and j may link."""
    common = 1 + np.minimum(n - i - 1, m - j - 1)
    return 100 * common >= percent * (n + m - common)


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """From rows (tile, n, place, set_id): pairs (a, b) that sizes and places let link, and the rows of large tiles.

    A pair is found in the tile of its first common shingle. A large tile gives of each set the pairs with the
    least and the greatest id of its band, which connect copies without comparing all with all.
    """
    names = ["a", "b", "tile", "n", "place", "set_id"]

    def run(batches):
        was_cut = False
        for (tile, n, place, ids), cut in _runs(batches, least=100_000):
            new = np.r_[True, (tile[1:] != tile[:-1]) | (n[1:] != n[:-1]) | (ids[1:] != ids[:-1])]
            tile, n, place, ids = tile[new], n[new], place[new], ids[new]
            border = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            count = np.diff(np.r_[border, len(tile)])
            large = count > SMALL_TILE
            large[0] |= was_cut
            large[-1] |= cut
            was_cut = cut
            after = np.repeat(border + count, count) - np.arange(len(tile)) - 1
            after[np.repeat(large, count)] = 0
            i = np.repeat(np.arange(len(tile)), after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            ok = (100 * n[i] >= percent * n[j]) & overlap_allows(n[i], place[i], n[j], place[j], percent)
            a, b = ids[i[ok]], ids[j[ok]]
            rest = np.repeat(large, count)
            tile, n, place, ids = tile[rest], n[rest], place[rest], ids[rest]
            if len(tile):
                band = np.r_[True, tile[1:] != tile[:-1]]
                for x, y in zip(*(np.flatnonzero(np.r_[band, True])[k:] for k in (0, 1)), strict=False):
                    while 100 * n[x] < percent * n[y - 1]:
                        x += int(np.searchsorted(n[x:y], n[x] * 100 // percent, side="right"))
                        band[x] = True
                start = np.flatnonzero(band)
                size = np.diff(np.r_[start, len(tile)])
                outer = [np.repeat(f.reduceat(ids, start), size) for f in (np.minimum, np.maximum)]
                a, b = np.r_[a, ids, ids], np.r_[b, *outer]
                a, b = a[a != b], b[a != b]
            pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs.a), pa.array(pairs.b), *[pa.nulls(len(pairs), pa.int64())] * 4], names=names)
            if len(tile):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(tile), pa.int64())] * 2, *map(pa.array, (tile, n, place, ids))], names=names)

    return rows.repartition("tile").sortWithinPartitions("tile", "n", "set_id").mapInArrow(run, "a bigint, b bigint, tile bigint, n bigint, place bigint, set_id bigint")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that sizes, places and signatures let link, from rows (tile, low, high,
    block, n, place, set_id, component, signature): a tile's blocks low and high meet in one group."""

    def run(batches):
        for (tile, low, high, block, n, place, ids, component, signatures), _ in _runs(batches, 3):
            border = np.r_[np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]), len(tile)]
            width = np.array([len(x) // 8 for x in signatures])
            for b, e in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                if component[b:e].max() == component[b:e].min():
                    continue
                top = np.searchsorted(n[b:e], n[b:e] * 100 // percent, side="right") + b  # sizes rise: the end of each one's band
                same = np.r_[b + np.flatnonzero(np.r_[True, width[b + 1 : e] != width[b : e - 1]]), e]
                for begin, end in zip(same[:-1].tolist(), same[1:].tolist(), strict=True):
                    w = width[begin]
                    bits = words_of(signatures[begin : int(top[end - 1 - b])], w)  # each one once for a width
                    for x in range(begin, end, 128):
                        y = min(x + 128, end)
                        for z in range(x, int(top[y - 1 - b]), 1024):
                            v = min(z + 1024, int(top[y - 1 - b]))
                            ok = (component[x:y, None] != component[None, z:v]) & (np.arange(x, y)[:, None] < np.arange(z, v))
                            if low[b] != high[b]:
                                ok &= block[x:y, None] != block[None, z:v]
                            i, j = np.nonzero(ok)
                            fine = overlap_allows(n[x + i], place[x + i], n[z + j], place[z + j], percent)
                            i, j = x + i[fine], z + j[fine]
                            apart, step = np.zeros(len(i), np.int64), max(1, (1 << 20) // w)
                            for q in range(0, len(i), step):
                                apart[q : q + step] = np.bitwise_count(bits[i[q : q + step] - begin] ^ bits[j[q : q + step] - begin]).sum(1, dtype=np.int64)
                            fine = may_link(n[i], n[j], apart, percent)
                            if fine.any():
                                one, other = ids[i[fine]], ids[j[fine]]
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _signature_filter(pairs: DataFrame, s: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and signatures let link. s: set_id, n, signature."""
    both = pairs.join(s.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a")), "a").join(s.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b")), "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sides = [batch.column(k).to_pylist() for k in (4, 5)]
            width = np.array([min(len(x), len(y)) // 8 for x, y in zip(*sides, strict=True)])
            apart = np.zeros(len(n), np.int64)
            for w in np.unique(width).tolist():  # all pairs of one width at once
                at = np.flatnonzero(width == w)
                for q in range(0, len(at), max(1, (1 << 20) // w)):
                    part = at[q : q + max(1, (1 << 20) // w)].tolist()
                    one, other = (words_of([side[r] for r in part], w) for side in sides)
                    apart[part] = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may_link(n, m, apart, percent)))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link: sorted arrays are intersected."""
    s = sets.select("set_id", "members")
    both = pairs.join(s.select(F.col("set_id").alias("b"), F.col("members").alias("m_b")), "b").join(s.select(F.col("set_id").alias("a"), F.col("members").alias("m_a")), "a")

    def run(batches):
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):  # no copies: a batch of long arrays is large enough as it is
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int64) for k in (2, 3))
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "m_a", "m_b").mapInArrow(run, "a bigint, b bigint")


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each id's place; bounded by bits and not by the number of ids."""

    def run(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            own[batch.column(0).to_numpy() & (bits - 1)] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(12).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(whole).astype(bool)


def _members(docs: DataFrame, words: int, wanted: np.ndarray) -> DataFrame:
    """set_id, n, members and signature of the documents whose place in the bitmap `wanted` is set. A set may come more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    marked = docs.select(F.xxhash64("doc_id").alias("at"), "text")

    def run(batches):
        bits = np.unpackbits(shared.value).astype(bool)

        def chosen():
            for batch in batches:
                yield batch.filter(pa.array(bits[batch.column(0).to_numpy() & (len(bits) - 1)]))

        seen: set[int] = set()
        for _, sets in _chunks(chosen(), words):
            rows = []
            for s in sets:
                if len(s) and (i := set_id(s)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(i)
                    rows.append((i, len(s), s.tobytes(), signature(s)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["set_id", "n", "members", "signature"])

    return marked.mapInArrow(run, "set_id bigint, n bigint, members binary, signature binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(a, b): root is the least node that links reach.

    Large and small stars in turn until nothing changes; each round is written to the shared folder.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        state = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "edges")


def _across(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets aren't in one component yet. component: node, root."""
    of = [component.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    both = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _classes(docs: DataFrame, words: int, percent: int, often: int, max_frequent: int, max_bitmap_bits: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text_key, n, set_id), and the component (set_id, root) of each set that links with another."""
    rows = materialize(_describe(docs, words, often), "sets")
    own = rows.where("n IS NOT NULL").select("doc_id", "text_key", "n", "set_id")
    frequent = rows.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(max_frequent).toArrow()
    hot = frequent.column("shingle").to_numpy()[::-1].copy()
    # prefixes that take in few shingles which others share make few tiles: what the first prefixes shared comes last
    late = _shared(_prefixes(docs, words, percent, hot, places=False), max_frequent * 8)
    late = np.concatenate([np.setdiff1d(late, hot, assume_unique=True), hot])
    found = materialize(_candidates(_prefixes(docs, words, percent, late, places=True), percent), "candidates")
    pairs = materialize(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    large = found.where("tile IS NOT NULL").select("tile", "n", "place", "set_id")

    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).union(large.select("set_id")).distinct()
    named = own.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    marks = materialize(named.join(ids, "set_id", "left_semi").select(F.xxhash64("doc_id").alias("at")), "marks")
    n, bits = marks.count(), 1 << 13
    while bits < min(max_bitmap_bits, 16 * n):
        bits *= 2
    sets = materialize(_members(docs, words, _bitmap(marks, bits)).join(ids, "set_id", "left_semi").dropDuplicates(["set_id"]), "members")

    passed = materialize(_signature_filter(pairs, sets, percent), "pairs")
    both = passed.union(passed.select("b", "a")).groupBy(F.col("a").alias("u")).agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("v"))
    outer = both.select("u", F.explode("v").alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    links = materialize(_links(outer, sets, percent), "links")
    component = materialize(components(links), "components")
    rest = materialize(_links(_across(passed, component), sets, percent), "links")
    if not rest.isEmpty():
        links = links.union(rest)
        component = materialize(components(links), "components")

    # sets of large tiles that are still apart: all with all, in blocks
    placed = large.join(component.withColumnRenamed("node", "set_id"), "set_id", "left").select(*large.columns, F.coalesce("root", "set_id").alias("component"))
    mixed = placed.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK_SETS).alias("blocks")).where("low != high").select("tile", "blocks")
    placed = placed.join(mixed, "tile").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.join(sets.select("set_id", "signature"), "set_id").select("tile", "low", "high", "block", "n", "place", "set_id", "component", "signature")
    dealt = dealt.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high", "n", "set_id")
    rest = materialize(_block_pairs(dealt, percent), "pairs")
    if not rest.isEmpty():
        links = links.union(materialize(_links(rest, sets, percent), "links"))
        component = materialize(components(links), "components")
    return own, component.select(F.col("node").alias("set_id"), "root")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, often: int = 8, max_frequent: int = 1 << 17, max_bitmap_bits: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_shingles and component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest id that links reach. Null and empty texts have no shingles and
    link with nothing; repeated rows are copies of each other; columns other than id and text aren't
    read; an empty table gives an empty result. A component whose ids are all null has a null id.

    often, max_frequent: which shingles come last in the order; they change the work, not the result.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    own, component = _classes(docs, words, percent, often, max_frequent, max_bitmap_bits)
    least = own.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    root = least.join(component, "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    named = root.select("set_id", "root").join(root.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("set_id", "component_id")
    whole = own.where("n > 0").join(named, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, max_broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", often: int = 8, max_frequent: int = 1 << 17, max_bitmap_bits: int = 1 << 26) -> DataFrame:
    """One row of each component: that with the smallest id, of rows with one id the one with the smallest text hash.

    Rows go by id and text, so a row whose text links with nothing stays even where its id repeats; of rows alike
    in both one stays. Null ids come after all others. Rows without a shingle all stay.
    """
    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    own, component = _classes(plain, words, percent, often, max_frequent, max_bitmap_bits)
    texts = own.where("n > 0").groupBy("doc_id", "text_key", "set_id").agg(F.count("*").alias("copies"))
    texts = materialize(texts.join(component, "set_id", "left").select("doc_id", "text_key", "copies", F.coalesce("root", "set_id").alias("root")), "texts")
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    decided = materialize(texts.join(first, "root").select("doc_id", "text_key", "copies", same.alias("stays")), "decided")

    def matched(ids: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        ids = ids.select("doc_id", "text_key")
        same = rows[id_col].eqNullSafe(ids["doc_id"]) & (F.xxhash64(rows[text_col].cast("string")) == ids["text_key"])
        return rows.join(F.broadcast(ids) if ids.count() <= max_broadcast_rows else ids, same, how)

    kept = matched(decided.where("NOT stays"), "left_anti", docs)
    repeated = decided.where("stays AND copies > 1")
    if repeated.isEmpty():
        return kept
    once = matched(repeated, "left_semi", kept)
    once = once.withColumn("_text_key_", F.xxhash64(once[text_col].cast("string"))).dropDuplicates([id_col, "_text_key_"]).drop("_text_key_")
    return matched(repeated, "left_anti", kept).unionByName(once)
