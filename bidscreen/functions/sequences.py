"""Ratcliff and Obershelp's matching blocks of many pairs of sequences at once, in flat arrays.

The longest block of equal elements comes first (of equal ones that which begins first in a, then in b), then those to its
left and right, and so on. All pairs of a batch go through their rounds together: a round finds the best block of each
open rectangle among the places where elements are equal, and deals the places on to the rectangles beside it.

In a sequence b of 200 elements or more, elements that make up over a hundredth of it (and one more) start no block; a
block found without them is extended over them, and one may begin with them at a rectangle's corner.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

#: From how many elements on frequent ones start no block, and what share is frequent. Fixed values.
LONG, FREQUENT = 200, 100


def spread(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, `times` numbers long."""
    return np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())


def _places(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each element of a: its pair, where equal elements of b begin in b's order by pair and element, and how many."""
    kinds = int(max(a.max(initial=0), b.max(initial=0))) + 1
    pair_a, pair_b = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (a_at, b_at))
    key = pair_b * kinds + b
    order = np.argsort(key, kind="stable")
    begin, end = (np.searchsorted(key[order], pair_a * kinds + a, side) for side in ("left", "right"))
    n = np.diff(b_at)[pair_a]
    times = np.where((n >= LONG) & (end - begin > n // FREQUENT + 1), 0, end - begin)
    return pair_a, order, begin, times


def matching_blocks(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Rows (pair, i, j, size) by pair and i. a, b: elements as numbers from 0 of all pairs' sequences, one after another;
    a_at, b_at: where each begins, and the end."""
    pair, order, begin, times = _places(a, a_at, b, b_at)
    i, j = np.repeat(np.arange(len(a)), times), order[spread(begin, times)]
    box = pair[i]
    alo, ahi, blo, bhi = a_at[:-1].copy(), a_at[1:].copy(), b_at[:-1].copy(), b_at[1:].copy()
    own = np.arange(len(alo))
    corner = np.isin(own, np.flatnonzero(np.diff(b_at) >= LONG))  # boxes that may have a block without a place
    found = []
    while len(own):
        by = np.lexsort((i, i - j, box))
        i, j, box = i[by], j[by], box[by]
        head = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(box) != 0)]) if len(i) else np.zeros(0, np.int64)
        size = np.diff(np.r_[head, len(i)])
        best = np.lexsort((j[head], i[head], -size, box[head]))
        best = best[np.r_[True, np.diff(box[head][best]) != 0]] if len(best) else best
        x, y, k = alo.copy(), blo.copy(), np.zeros(len(own), np.int64)
        at = box[head][best]
        x[at], y[at], k[at] = i[head][best], j[head][best], size[best]
        go = np.flatnonzero(corner)
        while len(go := go[(x[go] > alo[go]) & (y[go] > blo[go])]) and len(go := go[a[x[go] - 1] == b[y[go] - 1]]):
            x[go], y[go], k[go] = x[go] - 1, y[go] - 1, k[go] + 1
        go = np.flatnonzero(corner)
        while len(go := go[(x[go] + k[go] < ahi[go]) & (y[go] + k[go] < bhi[go])]) and len(go := go[a[x[go] + k[go]] == b[y[go] + k[go]]]):
            k[go] += 1
        some = np.flatnonzero(k > 0)
        found.append(np.stack([own[some], x[some], y[some], k[some]], 1))
        left, right = (i < x[box]) & (j < y[box]), (i >= x[box] + k[box]) & (j >= y[box] + k[box])
        stays = (left | right) & (k[box] > 0)
        i, j, to = i[stays], j[stays], 2 * box[stays] + right[stays]
        alo, ahi, blo, bhi = (np.stack(s, 1).ravel() for s in ((alo, x + k), (x, ahi), (blo, y + k), (y, bhi)))
        own, corner, k2 = np.repeat(own, 2), np.repeat(corner, 2), np.repeat(k, 2)
        open_ = (k2 > 0) & (alo < ahi) & (blo < bhi) & (corner | np.isin(np.arange(len(own)), to))
        number = np.cumsum(open_) - 1
        box = number[to]
        own, corner, alo, ahi, blo, bhi = own[open_], corner[open_], alo[open_], ahi[open_], blo[open_], bhi[open_]
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows[:, 1] -= a_at[rows[:, 0]]
    rows[:, 2] -= b_at[rows[:, 0]]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _flat(pairs: list[tuple[Sequence, Sequence]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a_at, b_at = (np.cumsum([0, *(len(p[s]) for p in pairs)]) for s in (0, 1))
    both = [x for s in (0, 1) for p in pairs for x in p[s]]
    number = pd.factorize(np.array([*both, None], object)[:-1])[0]
    return number[: a_at[-1]], a_at, number[a_at[-1] :], b_at


def in_steps(pairs: list[tuple[Sequence, Sequence]], max_places: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last + 1, blocks) of consecutive pairs, as many at a time as have max_places places of equal elements, or
    one that has more."""
    if pairs:
        yield from flat_steps(*_flat(pairs), max_places)


def flat_steps(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, max_places: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray]]:
    """The same of pairs in flat arrays."""
    n = len(a_at) - 1
    pair, _, _, times = _places(a, a_at, b, b_at)
    sums = np.r_[0, np.cumsum(np.bincount(pair, times, n).astype(np.int64) + 1)]
    begin = 0
    while begin < n:
        end = max(int(np.searchsorted(sums, sums[begin] + max_places, "right")) - 1, begin + 1)
        part = [at[begin : end + 1] - at[begin] for at in (a_at, b_at)]
        yield begin, end, matching_blocks(a[a_at[begin] : a_at[end]], part[0], b[b_at[begin] : b_at[end]], part[1])
        begin = end


def ratios(pairs: list[tuple[Sequence, Sequence]]) -> np.ndarray:
    """Twice the matched elements over all elements; 1 for two empty sequences."""
    out = np.ones(len(pairs))
    for begin, end, blocks in in_steps(pairs):
        matched = np.bincount(blocks[:, 0], blocks[:, 3], end - begin)
        n = np.array([len(x) + len(y) for x, y in pairs[begin:end]])
        out[begin:end] = np.where(n > 0, 2.0 * matched / np.maximum(n, 1), 1.0)
    return out


#: Characters of the longest strings that `may_match` compares; it lets longer ones pass. Bits of a word with one to spare.
BITS = 62


def may_match(pairs: list[tuple[str, str]], threshold: float, step: int = 1 << 16) -> np.ndarray:
    """False where no ratio of threshold is possible: blocks make up a common subsequence, and the longest one is too short.

    Its length comes from bit vectors (Hyyro's recurrence), a word a pair, one character of b after another.
    """
    out = np.ones(len(pairs), bool)
    n_a, n_b = (np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1))
    few = np.flatnonzero((n_a <= BITS) & (n_b <= BITS) & (n_a + n_b > 0))
    for begin in range(0, len(few), step):
        own = few[begin : begin + step]
        x, y = (np.array([pairs[k][i] for k in own], str).view(np.int32).reshape(len(own), -1).copy() for i in (0, 1))
        for m, n, none in ((x, n_a[own], -1), (y, n_b[own], -2)):
            m[np.arange(m.shape[1]) >= n[:, None]] = none
        open_ = np.full(len(own), (1 << 63) - 1, np.int64)
        bit = np.int64(1) << np.arange(x.shape[1], dtype=np.int64)
        for j in range(y.shape[1]):
            u = open_ & ((x == y[:, j : j + 1]) @ bit)
            open_ = (open_ + u | open_ - u) & ((1 << 63) - 1)
        common = np.bitwise_count((~open_) & ((np.int64(1) << n_a[own]) - 1))
        out[own] = 2 * common >= threshold * (n_a + n_b)[own] - 1e-9
    return out
