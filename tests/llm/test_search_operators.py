"""Neighbours, near-duplicates, language-model scores and URL filters against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidscreen.llm import lm, near_duplicates, neighbours, urls
from bidscreen.llm.common import crc_of_id


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "rank": F.lit(0)})


@pytest.mark.parametrize("shard", [64, 16384])
def test_neighbours(spark, shard):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 24)) + 2 * rng.standard_normal((12, 24))[rng.integers(0, 12, 700)]
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 24), (9002, [None] + [1.0] * 23), (9003, [float("nan")] + [1.0] * 23), (9004, [float("inf")] + [1.0] * 23), (9005, [1.0, 2.0]), (None, [1.0] * 24)]
    df = vectors(spark, rows + bad)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20, settings=neighbours.Settings(shard=shard, leaf=16, sample=128)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in range(700) if i % 20 == 0}
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        score = x @ x[q]
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.vec_id != q for r in own)
        assert np.allclose([r.score for r in own], score[[r.vec_id for r in own]], rtol=0, atol=1e-9)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:20]
        hits += len({r.vec_id for r in own} & set(best))
    assert hits / (20 * len(by)) >= 0.95
    copies = [r.vec_id for r in sorted(by[0], key=lambda r: r.rank) if 100 <= r.vec_id < 140]
    assert copies and copies == list(range(100, 100 + len(copies)))


def test_neighbours_of_few_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])])
    got = {(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)}
    assert neighbours.search(df.where("false"), F.lit(True)).count() == 0
    assert neighbours.search(df, F.lit(False)).count() == 0


def test_neighbours_of_two_lengths(spark):
    """Each length is searched by itself; a repeated query asks with its shortest, then smallest vector."""
    df = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0, 0.0]), (3, [2.0, 1.0, 0.0]), (20, [0.0, 1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 2.0, 0.0]), (40, [0.0, 1.0, 0.0])])
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=2).collect()}
    assert got == {(0, 1, 1, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (40, 1, 3, 1.0), (40, 2, 20, 1.0)}


def test_neighbours_stop(capsys):
    """At the registered settings the stopping test spares vectors: their share and recall against brute force."""
    settings, k, n, dim = neighbours.Settings(), 20, 8000, 64
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim)) + 1.5 * rng.standard_normal((40, dim))[rng.integers(0, 40, n)]
    ids, asked = np.arange(n), np.arange(0, n, 80)
    longest = float(np.sqrt((x * x).sum(1).max()))
    matrix = np.random.default_rng(settings.seed).standard_normal((dim + 1, settings.dims))
    model = neighbours.Model(settings, longest, matrix, None, None, ids, x)
    tree = neighbours._Shard(model, ids, x, k)
    query, vector, _, verified = tree.search(model, asked, x[asked], np.full(len(asked), np.inf), k, neighbours.chi_square_quantile(settings.found, settings.dims))
    hits = 0
    for i in asked.tolist():
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(set(np.argsort(-score)[:k].tolist()) & {v for q, v in zip(query, vector, strict=True) if q == i})
    share, recall = verified.mean() / n, hits / k / len(asked)
    with capsys.disabled():
        print(f"share verified {share:.2f}, recall {recall:.3f}")
    assert share < 0.6 and recall >= 0.9


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_quantile(0.9, 12) == pytest.approx(18.549, abs=1e-3)


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(70)]
    texts = ["", None, "one two", "One TWO", "one two three", "  "]
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(rng.randrange(5, 120))]))
        texts.append(" ".join([word() for _ in range(rng.randrange(5, 60))] + passage))
    base = [word() for _ in range(150)]
    for _ in range(60):  # a chain and a cloud of near copies
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            base = w
        texts.append(" ".join(w[: rng.randrange(120, 151)]))
    texts += [texts[10]] * 30
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n": F.lit("clash"), "component_id": F.lit(1)})
    got = sorted(near_duplicates.near_duplicates(df.repartition(6), often=2).collect())
    n, component = brute_components(texts)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == list(zip(range(len(texts)), n, component, strict=True))
    kept = sorted(r.doc_id for r in near_duplicates.keep_one(df).collect())
    assert kept == sorted(set(component))


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (None, None)], schema)
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 0, None), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (5, 0, 5)], key=str)
    assert sorted((r.doc_id or -1) for r in near_duplicates.keep_one(df).collect()) == [-1, 1, 5]


def test_keep_one_goes_by_row(spark):
    t, u, v, w = ("the common text of two rows " * 3, "another text that nothing else is like", "a third of its own with words", "and one more that differs from all")
    df = spark.createDataFrame([(1, t), (2, t), (2, u), (3, v), (3, w), (None, v), (None, None), (None, "lone row without an id and more")], "doc_id long, text string").withColumns({"root": F.lit(1), "text_key": F.lit("x"), "stays": F.lit(True)})
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, t), (2, u), (3, v), (3, w), (None, None), (None, "lone row without an id and more")], key=str)


def test_large_tiles(spark, monkeypatch):
    """Families larger than a small tile, of sets that link only by way of others, in blocks and cut runs."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(70):
        words = base.copy()
        for i in rng.sample(range(0, 120), rng.choice([1, 2, 3, 4, 5])):
            words[i] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words[: rng.choice([120, 120, 118, 100, 90])]))
    n, component = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(near_duplicates.near_duplicates(df.repartition(3), often=2).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == list(zip(range(len(texts)), n, component, strict=True))
    assert len(set(component)) > 3


def test_runs_cut_and_whole(monkeypatch):
    """A tile that a run cuts is large on both sides, and gives the same rows as a whole one."""
    rows = np.array(sorted((t, 50 + i % 9, 0, 1000 * t + i) for t, m in ((1, 3), (2, 30), (3, 16), (4, 1), (5, 40)) for i in range(m)))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[a : a + 7].T], names=["tile", "n", "place", "set_id"]) for a in range(0, len(rows), 7)]
    whole = [c for run, _ in near_duplicates._runs(iter(batches)) for c in [run]]
    assert np.array_equal(np.concatenate([np.array(c).T for c in whole]), rows)
    assert all(len({*a[0]} & {*b[0]}) == 0 for a, b in zip(whole, whole[1:], strict=False))
    monkeypatch.setattr(near_duplicates, "RUN_ROWS", 10)
    cut = list(near_duplicates._runs(iter(batches)))
    assert np.array_equal(np.concatenate([np.array(c).T for c, _ in cut]), rows) and any(end for _, end in cut)


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m, common = rng.integers(1, 900), rng.integers(1, 900), 0
        common = int(rng.integers(0, min(n, m) + 1))
        pool = np.unique(rng.integers(-(2**62), 2**62, n + m + 50))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:common], pool[n : n + m - common]])
        x, y = (np.frombuffer(near_duplicates.signature(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        apart = int(np.bitwise_count(near_duplicates.fold(x, w) ^ near_duplicates.fold(y, w)).sum())
        assert (len(a) + len(b) - apart) // 2 >= common


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm(spark, sf_dir):
    odd = [(10_000, None), (10_001, ""), (10_002, " A a\x0b"), (10_003, "zzz zzz " * 4000), (10_003, "zzz zzz " * 4000)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.collect()
    small = lm.Settings(head=500)
    got = lm.score_documents(docs.withColumns({"row": F.lit(1), "word": F.lit("clash")}), crc_of_id("doc_id") % 5 == 1, small).collect()
    out = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    words = [(r.text or "").encode().lower().split() for r in rows]
    counts, ends = Counter(), 0
    for w, held in zip(words, out, strict=True):
        if not held:
            counts.update(w)
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    want = sorted((r.doc_id, held, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(sum(log(counts[x]) for x in w) + log(ends), 5)) for r, w, held in zip(rows, words, out, strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in rows}
    bits = -sum(r.score for r in got if r.held_out) / math.log10(2) / sum(size[r.doc_id] for r in got if r.held_out)
    assert bits < 3.5


def test_lm_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_documents(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm.score_documents(docs.where("false"), F.lit(True)).count() == 0


RULES = [urls.UrlRule("org", "/", "allow"), urls.UrlRule("example.org", "/es/", "block"), urls.UrlRule("example.org", "/en/1", "block"), urls.UrlRule("com", "/fr/", "allow")]


def plain_url(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else ("block" if host in listed else "allow")


def test_urls(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.{d}" for i in range(800) for d in ("example.org", "net", "com")]
    some = ["http://A.Example.ORG/en/12?x#y", "https://x.net", "x.net/a", None, "", "a://b://c/d", "http:///p", "http://É.com?q", "http://a\nb.org/es/x", "ftp://com/fr/", "http://example.org/es/", "http://notexample.org/es/"]
    listed = {h for h in hosts if rng.random() < 0.3} | {"absent.net"}
    all_urls = some + [f"http://{h}/{rng.choice(['en/1', 'es/', 'fr/', ''])}" for h in hosts] + ["http://h1.net/"] * 500
    pages = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit(1)})
    marks = spark.createDataFrame([(h,) for h in [*listed, None, ""]], "host string")
    for bits in (1 << 27, 4000):  # one cascade for all hosts, and one for each group of them
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, marks, RULES, max_bits=bits).collect()}
        assert got == {i: plain_url(u, listed) for i, u in enumerate(all_urls)}
    assert urls.judge_urls(pages.where("false"), marks, RULES).count() == 0
    dealt = urls.by_group(pages.withColumn(urls._GROUP, F.col("page_id").cast("int") % 3), "pages").where(F.col(urls._GROUP) == 1)
    assert dealt.count() == pages.where("page_id % 3 = 1").count() and "PartitionFilters: [isnotnull(_group_of_hosts" in dealt._jdf.queryExecution().executedPlan().toString()
    assert urls.judge_urls(pages, marks.where("false"), RULES).where("rule IS NULL AND verdict = 'block'").count() == 0
