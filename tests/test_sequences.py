"""Matching blocks of batches against the standard library's, one pair at a time."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscreen.functions import sequences
from bidscreen.operators.fields import sequence_blocks


def pairs_of(kind):
    rng = random.Random(kind)
    for _ in range(60):
        letters = rng.choice(["a", "ab", "abc", "abcdefghij", "".join(map(chr, range(200, 500)))])
        n, m = (rng.choice([0, 1, 2, 5, 30, 199, 200, 201, 500]) for _ in "ab")
        a, b = (rng.choices(letters, k=k) for k in (n, m))
        if rng.random() < 0.5:  # b is a with changes
            b = list(a)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(3))
        yield ("".join(a), "".join(b)) if kind % 2 else ([x * 3 for x in a], [x * 3 for x in b])


def blocks(a, b):
    return [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks() if m.size]


def merged(rows):
    out = []
    for i, j, n in rows:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


@pytest.mark.parametrize("kind", range(6))
@pytest.mark.parametrize("max_places", [1, 5000, 1 << 21])
def test_blocks_and_ratios(kind, max_places):
    pairs = list(pairs_of(kind))
    got = [[] for _ in pairs]
    for begin, _, rows in sequences.in_steps(pairs, max_places):
        for pair, i, j, n in rows.tolist():
            got[begin + pair].append((i, j, n))
    assert [merged(g) for g in got] == [blocks(a, b) for a, b in pairs]
    assert sequences.ratios(pairs).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abcd", max_size=12)), max_size=6))
def test_any_small_pairs(pairs):
    assert sequences.ratios(pairs).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_frequent_elements_of_long_lists():
    """A frequent element starts no block, extends one, and matches in a corner."""
    a, b = ["x"] * 150 + [str(i) for i in range(60)], ["x"] * 150 + [str(i) for i in range(0, 60, 2)] + ["y"] * 20
    assert len(b) == 200
    for p in ((a, b), (b, a), (a[::-1], b[::-1]), (a, b[:199])):
        assert sequences.ratios([p])[0] == SequenceMatcher(None, *p).ratio()


def test_titles():
    batch = pd.DataFrame({"id": [1, 2, 3], "titles_a": [np.array(["A", "B", "C"], object), np.array([], object), np.array(["q"], object)], "titles_b": [np.array(["A", "C"], object), np.array([], object), np.array(["r"], object)]})
    (out,) = sequence_blocks(iter([batch]))
    assert out.ratio.tolist() == [0.8, 1.0, 0.0] and out.matched.tolist() == [[{"a": "A", "b": "A"}, {"a": "C", "b": "C"}], [], []]
    assert sequences.ratios([]).tolist() == []
