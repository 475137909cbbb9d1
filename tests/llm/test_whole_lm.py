"""Language-model scoring against a plain model: one bit after another, counts in a dictionary."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidscreen.llm import lm
from bidscreen.llm.common import crc_of_id

S = lm.Settings()
SPACE = {0xFF, *range(0x21)}


def plain_contexts(text, settings):
    """Of each byte and the end: the byte and its contexts as byte strings."""
    padded = b"\xff" * 8 + text + b"\xff"
    for p in range(8, len(padded)):
        n = 0
        while padded[p - 1 - n] not in SPACE:
            n += 1
        yield padded[p], [padded[p - o : p] for o in (*settings.orders, max(n, settings.least))]


def plain_counts(texts, settings):
    out = Counter()
    for text in texts:
        for byte, found in plain_contexts(text, settings):
            for which, c in enumerate(found):
                for t in range(8):
                    out[which, c, t, byte >> (8 - t), byte >> (7 - t) & 1] += 1
    return out


def plain_score(text, counts, mixer):
    s, total = mixer.settings, 0.0
    for byte, found in plain_contexts(text, s):
        for t in range(8):
            prefix, bit = byte >> (8 - t), byte >> (7 - t) & 1
            n = [[counts[which, c, t, prefix, b] for b in (0, 1)] for which, c in enumerate(found)]
            seen = [sum(x >= e for e in (1, 4, 32)) for x in map(sum, n)]
            w = mixer.weights[(t * 4 + seen[-1]) * 4 + seen[-2]]
            logit = float(sum(a * math.log((n1 + 0.04) / (n0 + 0.04)) for a, (n0, n1) in zip(w, n, strict=False)) + w[-1])
            x = (min(max(logit, -11.99), 11.99) + 12) * (s.map_steps - 1) / 24
            node = (1 << t | prefix) * s.map_steps + int(x)
            refined = mixer.refined[node] * (1 - x % 1) + mixer.refined[node + 1] * (x % 1)
            p = min(max(0.5 / (1 + math.exp(-logit)) + 0.5 * refined, 1e-5), 1 - 1e-5)
            total += math.log10(p if bit else 1 - p)
    return total


TEXTS = ["The cat sat on the mat.", "the cat SAT on the mat.", "", None, "a dog sat on a log\nand extraordinarily extraordinarily", "aaaa aaaaaaaaaaaaa", "ünï\x00code \ufffd", "the cat sat on the mat."]


@pytest.mark.parametrize(("rounds", "least", "fan"), [(0, 6, 256), (1, 6, 256), (1, 5, 2)])
def test_scores(spark, monkeypatch, rounds, least, fan):
    """The whole operator, in small parts and steps, and over several levels of few messages each, against the plain model with
    the same weights and map."""
    monkeypatch.setattr(lm, "PART_BYTES", 60)
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "WIDTH", 4 if fan == 2 else 1024)
    settings, made = lm.Settings(rounds=rounds, least=least), []
    own = lm.learn_mixer
    monkeypatch.setattr(lm, "learn_mixer", lambda b, s, t: made.append(own(b, s, t)) or made[0])
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.score): r for r in lm.score_documents(df, F.col("doc_id").isin(1, 4), settings).collect()}
    counts = plain_counts([lm.plain_bytes(t) for i, t in rows if i not in (1, 4)], settings)
    want = sorted((i, plain_score(lm.plain_bytes(t), counts, made[0])) for i, t in rows)
    assert np.allclose(sorted(got), want, rtol=1e-4)
    assert rounds == 0 or not np.allclose(made[0].weights, lm.Mixer.new(settings).weights)


def test_steps_change_nothing(monkeypatch):
    raws = [b"", b"x" * 90, *(f"text {i} of some words {i % 3}".encode() for i in range(30)), b""]
    blob, sizes = lm.joined(raws)
    ones = np.ones(len(raws), int)
    whole = lm.part_counts(blob, sizes, ones, ones, S)
    monkeypatch.setattr(lm, "STEP_BYTES", 50)
    for a, b in zip(whole, lm.part_counts(blob, sizes, ones, ones, S), strict=True):
        assert np.array_equal(a, b)
    assert whole[1].sum() == sum(len(r) + 1 for r in raws)
    value = np.arange(len(whole[0]), dtype=float)
    at = {k: v for k, v in zip(whole[0].tolist(), value.tolist(), strict=True)}
    keys = {i: [] for i in range(len(raws))}
    for texts, n, key in lm.steps_of(blob, sizes, S):
        for i, k in zip(np.repeat(texts, n).tolist(), key.tolist(), strict=True):
            keys[i].append(k)
    assert [len(keys[i]) for i in range(len(raws))] == [len(r) + 1 for r in raws]
    assert np.allclose(lm.part_scores(blob, sizes, whole[0], value, S) * np.log(10), [sum(at[k] for k in keys[i]) for i in range(len(raws))])


def test_a_distribution():
    """After any bytes the probabilities of all next bytes sum to one, and a text seen before is likelier."""
    raws = [b"the cat sat on the mat", b"the dog sat on the log"] * 5
    blob, sizes = lm.joined(raws)
    key, often, once = lm.part_counts(blob, sizes, np.ones(10, int), np.ones(10, int), S)
    bucket = lm.Bucket(key, often, S, lm.short_counts(key, often.astype(float)))
    w, seen, ones, all_ = lm.learn_bucket(bucket, once, lm.Mixer.new(S))
    mixer = lm.Mixer(S, w, ((lm.Mixer.new(S).refined * 30 + ones) / (30 + all_)).astype(np.float32))
    for one in (key[5], key[20]):
        every = (one & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        both = np.concatenate([key[~np.isin(key, every)], every])
        count = dict(zip(key.tolist(), often.tolist(), strict=True))
        times = np.array([count.get(k, 0.0) for k in both.tolist()])
        bucket = lm.Bucket(both, times, S, lm.short_counts(both, times))
        assert np.exp(lm.find_bucket(bucket, mixer)[-256:]).sum() == pytest.approx(1, abs=1e-3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def test_partitions_do_not_decide(docs):
    score = lambda df: {r.doc_id: r.score for r in lm.score_documents(df, crc_of_id("doc_id") % 5 == 1).collect()}
    one, other = score(docs.coalesce(1)), score(docs.repartition(5))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 0.02 * abs(one[i]) for i in one)


def test_copies_do_not_fill_the_weights(spark, docs):
    texts = docs.where("text IS NOT NULL").dropDuplicates(["text"])
    once = {r.doc_id: r.score for r in lm.score_documents(texts, F.lit(False)).collect()}
    hot = texts.orderBy("doc_id").limit(1)
    copies = hot.select((F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + 2000)))).alias("doc_id"), "text")
    more = {r.doc_id: r.score for r in lm.score_documents(texts.unionByName(copies), F.lit(False)).collect()}
    assert sum(more[i] for i in once) == pytest.approx(sum(once.values()), rel=0.25)
