"""Best-fit packing of tokenized documents by the linear grouping scheme.

Lengths are bounded by the capacity, so the whole corpus enters the plan as a histogram of at most
`capacity` counts. Large lengths are put into groups of equal cardinality and rounded up to their
group's longest; the configuration program over these few sizes is solved by column generation;
actual lengths take the rounded ones' places; what is left over and all small ones go to the
fullest bin that has room. Bins that hold the same lengths are one run of the plan, so the plan's
size depends on the capacity and not on the number of documents, and the k-th document of a length
finds its place by arithmetic.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidscreen.llm.bpe import numpy_encoder
from bidscreen.llm.common import materialize, pieces


@dataclass
class Run:
    """n bins that hold the same lengths. slots: (length, rank of the first bin's first, how many in each bin)."""

    n: int
    room: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> tuple[Run, Run]:
        """The first n bins and the others."""
        return Run(n, self.room, list(self.slots)), Run(self.n - n, self.room, [(size, rank + n * k, k) for size, rank, k in self.slots])

    def put(self, size: int, rank: int, k: int) -> Run:
        self.slots.append((size, rank, k))
        self.room -= size * k
        return self


def best_fit(runs: list[Run], items: list[tuple[int, int, int]], capacity: int) -> list[Run]:
    """Add items (length, first rank, count), longest first, each to the fullest bin that has room for it."""
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def add(run: Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in runs:
        add(run)
    for size, rank, count in sorted(items, reverse=True):
        while count:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                run = Run(ceil(count / (capacity // size)), capacity)
            else:
                run = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del by_room[rooms.pop(at)]
            k = min(run.room // size, count)
            n = min(run.n, count // k)
            if n < run.n:
                run, rest = run.split(n)
                add(rest)
            add(run.put(size, rank, k))
            rank, count = rank + n * k, count - n * k
    return [run for runs in by_room.values() for run in runs]


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration (number of each size in a bin), by column generation and rounded down."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    for _ in range(60 * n):
        inverse = np.linalg.inv(basis)
        price = np.ones(n) @ inverse
        column = _knapsack(sizes, price, capacity)
        if price @ column <= 1 + 1e-9:
            break
        x, u = inverse @ d, inverse @ column
        ratio = np.where(u > 1e-12, np.maximum(x, 0) / np.where(u > 1e-12, u, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, d)
    return [(int(m + 1e-9), basis[:, j].astype(int)) for j, m in enumerate(x) if m + 1e-9 >= 1]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest price that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = [(s, p, g) for g, (s, p) in enumerate(zip(sizes, price.tolist(), strict=True)) if p > 1e-12]
    values = best.tolist()
    for room in range(min(sizes, default=1), capacity + 1):
        value, take = values[room - 1], -1
        for s, p, g in worth:
            if s <= room and values[room - s] + p > value + 1e-15:
                value, take = values[room - s] + p, g
        values[room], last[room] = value, take
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out[last[room]] += 1
            room -= sizes[last[room]]
    return out


def linear_grouping(counts: dict[int, int], capacity: int, small: float, groups: int) -> list[Run]:
    """A plan for counts of lengths up to capacity; lengths up to small * capacity are the small ones."""
    items = [(size, 0, n) for size, n in sorted(counts.items(), reverse=True) if n]
    large = [x for x in items if x[0] > small * capacity]
    rest = items[len(large) :]
    total = sum(n for _, _, n in large)
    if not total:
        return best_fit([], rest, capacity)
    each = ceil(total / groups)
    parts: list[list[list[int]]] = [[]]  # of each group: (length, first rank, count), longest first
    for size, rank, n in large:
        while n:
            room = each - sum(x[2] for x in parts[-1])
            if not room:
                parts.append([])
                continue
            take = min(n, room)
            parts[-1].append([size, rank, take])
            rank, n = rank + take, n - take
    # groups of one length are one size
    merged: dict[int, list[list[int]]] = {}
    for part in parts:
        merged.setdefault(part[0][0], []).extend(part)
    sizes, queues = list(merged), list(merged.values())
    runs: list[Run] = []
    for n, column in configurations(sizes, [sum(x[2] for x in q) for q in queues], capacity):
        places = [g for g in range(len(sizes)) for _ in range(column[g])]
        done = [Run(n, capacity)]
        for g in places:
            out = []
            for run in done:
                while run.n and queues[g]:
                    size, rank, left = queues[g][0]
                    take = min(run.n, left)
                    part, run = run.split(take)
                    out.append(part.put(size, rank, 1))
                    queues[g][0] = [size, rank + take, left - take]
                    if left == take:
                        queues[g].pop(0)
                if run.n:
                    out.append(run)
            done = out
        runs += [r for r in done if r.slots]
    return best_fit(runs, [tuple(x) for q in queues for x in q] + rest, capacity)


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The plan with the fewest bins over a few choices of what is small and of how many groups."""
    bound = ceil(sum(s * n for s, n in counts.items()) / capacity)
    best: list[Run] = []
    for small, groups in ((1 / 8, 16), (1 / 4, 24), (1 / 16, 12), (1 / 2, 32)):
        runs = linear_grouping(counts, capacity, small, groups)
        if not best or sum(r.n for r in runs) < sum(r.n for r in best):
            best = runs
        if sum(r.n for r in best) <= bound:
            break
    return best


def places(runs: list[Run], capacity: int) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: from the rank'th piece of a length on, k a bin, bins from sequence on, at offset."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for size, rank, k in run.slots:
            rows.append((size, rank, k, sequence, offset))
            offset += size * k
        sequence += run.n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "k": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece of each document: the first takes the remainder, all others `capacity` tokens.

    task and nth: the task that cut it and its number among that task's pieces of its length.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = f"id {kept.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = numpy_encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in pieces(batches, "text"):
            ids, at = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            raw = ids.astype("<u4", copy=False)
            row, piece, start, length, crc, nth, content = [], [], [], [], [], [], []
            end = np.array([end_id], "<u4")
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.concatenate([raw[a:b], end])
                n = len(own)
                cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = own[x:y].tobytes()
                    row.append(i)
                    piece.append(j)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(part))
                    nth.append(seen[y - x])
                    seen[y - x] += 1
                    if with_ids:
                        content.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(content, pa.binary())] * with_ids, names=["id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids])

    return kept.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the scheme finds.

    A document is its ids and then end_id; a null text is empty, so it is end_id alone. Documents
    that fit are never cut. Returns id_col, piece, start, length, ids_crc32, sequence_id, offset,
    and ids (binary, little-endian unsigned 32-bit) if with_ids. Repeated rows are packed each on
    its own; a null id stays null; an empty table gives an empty result. Columns of docs other
    than the id and the text aren't read.

    The driver gets one count for each length (at most `capacity`), and the plan is broadcast: its
    size depends on the capacity alone.
    """
    spark = docs.sparkSession
    cut = materialize(cut_documents(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    numbered = cut.join(by_task.drop("n"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    kept = [c for c in cut.columns if c not in ("task", "nth")]
    numbered = numbered.select(*kept, "rank")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "rank") + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            i = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            bin_, slot = np.divmod(rank - p["rank"][i], p["k"][i])
            columns = [batch.column(j) for j, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p["sequence"][i] + bin_), pa.array(p["offset"][i] + slot * length)], names=[*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(place, out).withColumnRenamed("id", id_col)
