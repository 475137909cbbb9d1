"""Values that resemble each other: few of a task compared all with all, many by signs, and the bound before the ratio."""

import random
from difflib import SequenceMatcher

import pytest

from bidscreen.functions import sequences
from bidscreen.operators import fields


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
            before = above
    return row[-1]


def test_bound_is_the_longest_common_subsequence():
    r = random.Random(5)
    word = lambda most: "".join(r.choices("ab甲\U0001f600", k=r.randrange(most)))
    pairs = [(word(12), word(12)) for _ in range(2000)] + [(word(80), word(80)) for _ in range(300)] + [("", ""), ("", "a"), ("x" * 62, "x" * 62), ("a\0", "a")]
    got = sequences.may_match(pairs, 0.7, step=100)
    short = [len(a) <= 62 and len(b) <= 62 for a, b in pairs]
    assert got.tolist() == [not s or 2 * longest_common(a, b) >= 0.7 * (len(a) + len(b)) - 1e-9 for (a, b), s in zip(pairs, short, strict=True)]
    assert 50 < sum(got) < len(pairs)


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_few_and_many_values(spark, few):
    r = random.Random(7)
    rows = [(t, i, i, kind, "".join(r.choices("甲乙丙", k=r.randrange(2, 7)))) for t, n in (("s", 12), ("t", 60)) for i in range(n) for kind in ("person", "company", "email")]
    df = spark.createDataFrame(rows, "task_id string, doc_id long, doc_ord long, field_type string, value string")
    got = [tuple(x) for x in fields.similar_values(df, 0.8, few).collect()]
    values = {(t, k): sorted({x[4] for x in rows if x[0] == t and x[3] == k}) for t in "st" for k in ("person", "company")}
    want = {(*key, a, b) for key, own in values.items() for a in own for b in own if a != b and SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
