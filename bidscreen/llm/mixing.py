"""Mixing sources to target weights: how often each document is taken so that sources meet their shares.

Documents with the same sources (their membership pattern) are alike to the mix, so documents are summed up by pattern
first. Words of patterns are routed to the quotas of sources by a minimum-cost flow: a word counts for one source, a
pattern can give its words `max_repeats` times, and each further share of a pattern costs more than the one before
(convex costs, `slices` steps for each repetition), so that repeats come last and patterns are drawn on evenly. Only
patterns, which are checked to be few, are on the driver. Then documents are chosen by pattern: whole repetitions of
all, and of the last one those first by a seeded hash, up to the words that the flow gave.

Where the hash order ends is found by digits of the hash: sums of words by pattern and digit, then only of the digit that
the end falls in, until a cell has few rows; no task orders a whole pattern. The last cell is filled in hash order by
documents that still fit; then one comes, goes or is exchanged for another while that comes nearer.

Handling: null text has size 0, null source is a source of its own (the last), '' another. Documents of size 0 are taken
0 words. Repeated rows are documents of their own; rows alike in id and text are told apart by a number given as the
sizes are written, so which of them is taken can't be told from the result. Other columns are not looked at. An empty
table gives no rows. Texts of any length are counted whole. More than max_patterns patterns are an error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscreen.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Digits (of base 16) that a hash has.
_HASH = 32


def targets(sizes: Mapping[str | None, int], total: Fraction, weights: Sequence[int], max_repeats: int) -> dict[str | None, Fraction]:
    """Shares of the total by weight; none is above max_repeats times its source's size, the excess goes to the others
    by weight. Sources are ordered by code point, null last, and the weights repeat along them."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    free, rest = set(order), Fraction(total)
    while free:
        each = rest / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] > max_repeats * sizes[s]}
        for s in full or free:
            out[s] = Fraction(max_repeats * sizes[s]) if full else each * weight[s]
        rest -= sum((out[s] for s in full), Fraction(0))
        free = free - full if full else set()
    return out


def route(sizes: Mapping[str, int], members: Mapping[str, Sequence], quotas: Mapping, max_repeats: int, slices: int) -> dict[str, int]:
    """Words that each pattern gives, by a flow to its sources' quotas that is largest, and of these cheapest.

    All costs stand on what a pattern gives, so a cheapest augmenting path starts from a pattern at the lowest step of
    cost and is else any path: to one of its sources, and from a source to another over a pattern that feeds the one
    and can feed the other. Steps are gone through once, in order of cost.
    """
    flow = {p: dict.fromkeys(members[p], 0) for p in sizes}
    feeds: dict = {s: set() for s in quotas}
    left = dict(quotas)
    given = dict.fromkeys(sizes, 0)
    for step in range(1, max_repeats * slices + 1):
        dead: set = set()  # sources from which no quota can be reached at this step
        for p in sorted(sizes):
            while (room := sizes[p] * step // slices - given[p]) > 0:
                came: dict = {s: (p, None) for s in members[p] if s not in dead}
                queue, end = deque(came), None
                while queue and end is None:
                    s = queue.popleft()
                    if left[s] > 0:
                        end = s
                        break
                    for other in sorted(feeds[s]):
                        for t in members[other]:
                            if t not in came and t not in dead:
                                came[t] = (other, s)
                                queue.append(t)
                if end is None:
                    dead |= set(came)
                    break
                path, s = [], end
                while s is not None:
                    via, before = came[s]
                    path.append((via, before, s))
                    s = before
                amount = min([room, left[end], *(flow[via][before] for via, before, _ in path if before is not None)])
                for via, before, to in path:
                    flow[via][to] += amount
                    feeds[to].add(via)
                    if before is not None:
                        flow[via][before] -= amount
                        if not flow[via][before]:
                            feeds[before].discard(via)
                given[p] += amount
                left[end] -= amount
    return given


def _digits(times: float) -> int:
    """Digits that a round of sums tells apart: up to three, but no more than the cells are to get smaller by."""
    return 1 + (times > 16) + (times > 256)


_PLAN = "pattern bigint, source_sizes array<bigint>, targets array<double>, full bigint, `left` bigint, cell string"


def _fill(cell: pd.DataFrame) -> pd.DataFrame:
    """The last repetition's documents within the cell that its end falls in."""
    cell = cell.sort_values("key", ignore_index=True)
    size, left = cell["size"].to_numpy(), int(cell["left"][0])
    more = np.zeros(len(size), bool)
    for i, n in enumerate(size.tolist()):
        more[i] = n <= left
        left -= n * bool(more[i])
    while left:  # one comes, goes or is exchanged for another, as long as that comes nearer
        away, there = (np.unique(np.r_[0, size[m]], return_index=True) for m in (~more, more))
        off = np.abs(left - (away[0][:, None] - there[0]))
        i, j = np.unravel_index(off.argmin(), off.shape)
        if off[i, j] >= abs(left):
            break
        left -= int(away[0][i] - there[0][j])
        come, go = np.flatnonzero(~more), np.flatnonzero(more)
        if away[1][i]:
            more[come[away[1][i] - 1]] = True
        if there[1][j]:
            more[go[there[1][j] - 1]] = False
    cell["copies"] = cell["full"] + more
    return cell.drop(columns=["left", "key"])


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), max_repeats: int = 2, seed: int = 13, slices: int = 4, cell_rows: int = 1024, max_patterns: int = 20_000) -> DataFrame:
    """doc_id, sources, source_sizes, targets (one for each source of the document), size, copies, taken (size times
    copies). `source` is a source or an array of them; all sources together get `share` times all words."""
    of_many = isinstance(docs.schema["source"].dataType, T.ArrayType)
    sources = F.array_sort(F.array_distinct("source")) if of_many else F.array(F.col("source").cast("string"))
    text = F.col("text").cast("string")
    hashed = lambda *c: F.lpad(F.hex(F.xxhash64(F.lit(seed), *c)), 16, "0")
    sized = docs.select("doc_id", sources.alias("sources"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed(F.col("doc_id"), text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    named = F.coalesce(F.to_json("sources"), F.lit(""))
    sized = materialize(sized.select("doc_id", "sources", F.xxhash64(named).alias("pattern"), "size", F.concat("hash", hashed("row")).alias("key")), "sized")

    patterns = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("rows")).limit(max_patterns + 1).collect()
    if len(patterns) > max_patterns:
        raise ValueError(f"more than {max_patterns} sets of sources")
    if len({r.pattern for r in patterns}) < len(patterns):
        raise ValueError("two sets of sources have the same hash")
    size, members = {r.pattern: r["size"] for r in patterns}, {r.pattern: list(r.sources or []) for r in patterns}
    source_size: dict = {}
    for p, of in members.items():
        for s in of:
            source_size[s] = source_size.get(s, 0) + size[p]
    target = targets(source_size, share * sum(size.values()), weights, max_repeats)
    given = route(size, members, {s: round(t) for s, t in target.items()}, max_repeats, slices)

    full = {p: given[p] // max(size[p], 1) for p in size}
    left = {p: given[p] - full[p] * size[p] for p in size}
    cell, rows = dict.fromkeys(size, ""), {r.pattern: r["rows"] for r in patterns}
    spark = docs.sparkSession
    while cut := [(p, left[p], cell[p], _digits(rows[p] / cell_rows)) for p in size if left[p] > 0 and rows[p] > cell_rows and len(cell[p]) < _HASH]:
        ends = F.broadcast(spark.createDataFrame(cut, "pattern bigint, `left` bigint, cell string, take int"))
        within = sized.where("size > 0").join(ends, "pattern").where("substring(key, 1, length(cell)) = cell")
        cells = within.groupBy("pattern", "left", F.expr("substring(key, length(cell) + 1, take)").alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        cells = cells.withColumn("before", F.sum("size").over(Window.partitionBy("pattern").orderBy("digit")) - F.col("size"))
        for r in cells.where("before <= left AND left < before + size").collect():
            left[r.pattern], cell[r.pattern], rows[r.pattern] = r["left"] - r.before, cell[r.pattern] + r.digit, r["rows"]

    plan = [(p, [source_size[s] for s in members[p]], [float(target[s]) for s in members[p]], full[p], left[p], cell[p]) for p in size]
    planned = sized.join(F.broadcast(spark.createDataFrame(plan, _PLAN)), "pattern")
    prefix = F.expr("substring(key, 1, length(cell))")
    at_end = (prefix == F.col("cell")) & (F.col("left") > 0) & (F.col("size") > 0)
    columns = ["doc_id", "sources", "source_sizes", "targets", "size"]
    clear = planned.where(~at_end).select(*columns, (F.col("full") + (prefix < F.col("cell")).cast("long")).alias("copies"))
    ends = planned.where(at_end).select(*columns, "pattern", "full", "left", "key")
    kind = ends.drop("left", "key").schema.add("copies", "long")
    filled = ends.groupBy("pattern").applyInPandas(_fill, kind).select(*columns, "copies")
    return clear.unionByName(filled).withColumn("taken", F.col("size") * F.col("copies"))
