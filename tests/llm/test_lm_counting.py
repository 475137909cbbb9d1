"""A part's keys are merged few times, however many steps it has."""

import numpy as np

from bidscreen.llm import lm


def test_keys_are_sorted_a_few_times(monkeypatch):
    rng = np.random.default_rng(1)
    blob, sizes = lm.joined([rng.integers(97, 123, 1 << 18, np.uint8).tobytes() for _ in range(24)])
    counted, seen = lm.counted, []

    def watched(values, *weights):
        seen.append(len(values) if weights else 0)
        return counted(values, *weights)

    monkeypatch.setattr(lm, "counted", watched)
    once = np.ones(len(sizes), np.int64)
    key, often, marked = lm.part_counts(blob, sizes, once, once, lm.Settings())
    assert sum(seen) < 4 * len(key), (sum(seen), len(key))
    every = np.concatenate([k for _, _, k in lm.steps_of(blob, sizes, lm.Settings())])
    want, times = np.unique(every, return_counts=True)
    assert (key == want).all() and (often == times).all() and (marked == times).all()
