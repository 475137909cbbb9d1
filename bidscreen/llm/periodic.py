"""Periodic run detection: stretches of words that repeat themselves at a lag, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are the same), at least max(12, 2 * q) long, that no
neighbouring word extends keeping the period.

A sparse diagonal dynamic program, online over places: for each place, each earlier occurrence of what stands there adds
one to the match length of that lag's active diagonal; a diagonal that isn't extended ends, and is emitted at once as a
run if it is long enough. Places are taken in steps of bounded numbers of occurrences, many documents at a time in flat
arrays, and only active diagonals are carried from step to step.

What is compared keeps the program sparse and exact: a run of period q repeats at least max(12 - q, q) >= 6 words at lag
q. So for lags under 12 the symbol at a place is the six words from there on, for lags from 12 to 23 twelve words, for
24 to 47 twenty-four and so on, numbered by doubling without hashes; places whose symbol doesn't recur drop out. A
symbol of w words that recurs within w / 2 places lies in a run of that period. Occurrences within that run are multiples
of the period apart and give no run of their own, so they are skipped. A stretch found at several lags has the smallest.

Time is about that of sorting the places whose symbols recur, times the levels; texts that nest long runs of one word in
long runs (a a a ... b a a a ... b) take more, as each place meets the occurrences in the neighbouring run.

Handling: null and empty texts have no words and no runs; documents are told apart by row, so repeated ids and rows give
rows of their own. Other columns are not looked at, whatever their names. An empty table gives no rows. A document has
to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidscreen.llm.common import pieces

#: The shortest run, and the words that each run repeats at least at its lag.
LEAST, SYMBOL = 12, 6


def _recurring(key: np.ndarray) -> np.ndarray:
    """A number for each different key that occurs more than once, -1 for others."""
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    return np.where(times[number] > 1, number, -1)


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Numbers of a at a place with b gap places on; -1 where either doesn't recur or both together don't."""
    out = np.full(len(a), -1, np.int64)
    at = np.flatnonzero((a[: max(len(a) - gap, 0)] >= 0) & (b[gap:] >= 0))
    if len(at):
        out[at] = _recurring(a[at] * len(a) + b[at + gap])
    return out


def _diagonals(symbol: np.ndarray, width: int, low: int, high: int, max_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lag, first, last later place) of each maximal diagonal of equal symbols at lags low to high - 1, as it ends."""
    n, at = len(symbol), np.flatnonzero(symbol >= 0)
    order = np.argsort(symbol[at], kind="stable")
    place, number = at[order], symbol[at][order]
    key = number * n + place
    begin, end = np.searchsorted(key, number * n + np.maximum(place - high + 1, 0)), np.searchsorted(key, key - low, "right")
    if low >= width:  # occurrences of the run that the symbol lies in are skipped
        head = np.flatnonzero(np.r_[True, np.diff(key) > width // 2])
        end = np.minimum(end, head[np.cumsum(np.isin(np.arange(len(key)), head, assume_unique=True)) - 1])
    pairs = np.maximum(end - begin, 0)
    online = np.argsort(place)
    online = online[pairs[online] > 0]
    cuts = np.cumsum(pairs[online])
    active = np.zeros((3, 0), np.int64)
    row = 0
    while row < len(online):
        stop = max(int(np.searchsorted(cuts, (cuts[row - 1] if row else 0) + max_pairs, "right")), row + 1)
        rows = online[row:stop]
        times = pairs[rows]
        later = np.repeat(place[rows], times)
        earlier = place[np.repeat(begin[rows] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        met = np.sort((later - earlier) * n + later)
        head = np.flatnonzero(np.r_[True, np.diff(met) != 1])
        lag, first, last = met[head] // n, met[head] % n, met[np.r_[head[1:], len(met)] - 1] % n
        k = np.minimum(np.searchsorted(active[0], lag), max(active.shape[1] - 1, 0))
        if active.shape[1]:
            goes_on = (active[0][k] == lag) & (active[2][k] == first - 1)
            first = np.where(goes_on, active[1][k], first)
            ended = np.ones(active.shape[1], bool)
            ended[k[goes_on]] = False
            yield tuple(active[:, ended])
        open_ = last == place[rows[-1]]
        yield lag[~open_], first[~open_], last[~open_]
        active = np.stack([lag[open_], first[open_], last[open_]])
        row = stop
    yield tuple(active)


def runs_of_words(words: np.ndarray, docs: np.ndarray, max_pairs: int = 1 << 20) -> np.ndarray:
    """Rows (start, length, period) by start, length of all runs; words: numbers of words, docs: of their documents."""
    found, n = [], len(words)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    one = _recurring(docs.astype(np.int64) * (int(words.max()) + 1) + words)
    two = _joined(one, one, 1)
    three = _joined(two, one, 2)
    symbol, width, low, high = _joined(three, three, 3), SYMBOL, 1, 2 * SYMBOL
    longest = int(np.bincount(docs).max())
    while 2 * low <= longest and (symbol >= 0).any():
        for lag, first, last in _diagonals(symbol, width, low, high, max_pairs):
            length = last - first + width + lag
            long_enough = length >= np.maximum(LEAST, 2 * lag)
            found.append(np.stack([first - lag, length, lag], 1)[long_enough])
        symbol, width, low, high = _joined(symbol, symbol, width), 2 * width, high, 2 * high
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(1)]] if len(runs) else runs


def _found(batches: Iterator[pa.RecordBatch], max_pairs: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words = [(t or "").encode().split() for t in piece.column(1).to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
        runs = runs_of_words(flat, np.repeat(np.arange(len(words)), sizes), max_pairs)
        doc = np.searchsorted(starts, runs[:, 0], "right") - 1
        repeats = np.cumsum(np.bincount(runs[:, 0] + runs[:, 2], minlength=len(flat) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(flat) + 1))[:-1] > 0
        kept = (~repeats).tolist()
        has_run = np.bincount(doc, minlength=len(words)) > 0
        collapsed = [b" ".join(w for w, k in zip(ws, kept[a : a + len(ws)], strict=True) if k) if has else b" ".join(ws) for ws, a, has in zip(words, starts.tolist(), has_run.tolist(), strict=False)]
        by_start = np.lexsort((runs[:, 2], runs[:, 0]))
        fields = [pa.array(c) for c in (runs[by_start, 0] - starts[doc[by_start]], runs[by_start, 1], runs[by_start, 2])]
        each = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(words) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes), each, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, max_pairs: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), and collapsed: the words that no
    run repeats, joined by a space, each run keeping its first period. max_pairs bounds a step, not the result."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: _found(batches, max_pairs), schema)
