"""Source divergence, periodic runs and source mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidscreen.llm import divergence, mixing, oracles, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


# --- op11


def plain_audit(rows, min_docs, top):
    """All shares of all terms, and all pairs of groups over all terms."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in of for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        counts = {s: Counter(t for d in of if d[1] == s for t in d[2] if in_docs[t] >= min_docs) for s in {d[1] for d in of}}
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        whole, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(whole[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, name, -v, i) for i, (v, _, name) in enumerate(found, 1)}
    return out


def audited(df, **kw):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect() if not kw else divergence.audit(df, **kw).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize(("block_terms", "tile"), [(512, 8), (3, 2), (1, 1)])
def test_audit(spark, block_terms, tile):
    rng = random.Random(block_terms)
    words = ["Aa", "aa", "b-c", "É", "é", "日本", "x1y", "zz", "\x7fq", "[w]", "rare"] + [f"t{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["de", "en", None, ""]), rng.choice(["a", "b", "c", "d", "é", "z", None])) for _ in range(120)]
    rows += [(None, "en", "only null"), ("", "xx", "p"), ("12 34", "xx", "q"), ("same same", "yy", "one"), ("tie " * 3000, "en", "a")] * 2
    df = spark.createDataFrame([(1, *r) for r in rows], DOCS).withColumns({"n": F.lit("clash"), "item": F.lit(1), "term": F.lit(2)})
    got = audited(df, min_docs=4, top=3, block_terms=block_terms, tile=tile)
    assert got == plain_audit(rows, 4, 3)
    assert {r[3:] for r in got if r[0] == "xx"} == {("p", 0, 1), ("q", 0, 1)} and not [r for r in got if r[0] == "yy"]


def test_audit_of_nothing(spark):
    assert not divergence.audit(spark.createDataFrame([], DOCS)).collect()
    assert not divergence.audit(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()


def test_audit_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({oracles.ORACLES['op11_source_divergence']})").fetchall()}
    assert audited(queries.op11_source_divergence(spark, sf_dir)) == want and len(want) > 1000


def test_counts_are_sent_on_without_changing_sums(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {tuple(r) for r in divergence.count_terms(docs, max_entries=7).collect()} == {tuple(r) for r in divergence.count_terms(docs).collect()}


def test_gallop_and_shares():
    rng = np.random.default_rng(1)
    for n, m, stride in product((0, 1, 40, 500), (0, 1, 7, 3000), (1, 32)):
        small, large = (np.unique(rng.integers(0, 4000, k)) for k in (n, m))
        assert divergence.gallop(small, large, stride).tolist() == np.searchsorted(large, small).tolist()
    for total, terms in ((0, 1), (10**15, 10**9), (7, 3)):
        for n in (0, total // 3, total):
            assert divergence.shares(np.array([n]), total, terms)[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_share_of_large_counts(spark):
    r = spark.range(1).select(divergence.share(F.lit(7 * 10**14), F.lit(2 * 10**15), F.lit(10**9)).alias("p")).first()
    assert r.p == 1 + 10**9 * (7 * 10**14 + 5) // (2 * 10**15 + 5 * 10**9)


# --- op12


def plain_runs(words):
    """All maximal stretches of each period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def word_lists():
    rng = random.Random(5)
    for letters in (1, 2, 3, 5, 50):
        for n in (0, 1, 11, 12, 13, 40, 150):
            yield [str(rng.randrange(letters)) for _ in range(n)]
    for q in (1, 2, 5, 6, 7, 11, 12, 13, 23, 24, 25, 47, 48, 60):
        for more in (0, 1, q):
            yield ["y"] * rng.randrange(3) + [str(i % q) for i in range(max(12, 2 * q) + more)] + ["y", "z"]
            unit = [rng.choice("ab") for _ in range(q)]
            yield (unit * 30)[: 2 * q + 12 + more] + ["c"] + unit * 2
    for m in (3, 13, 30, 70):  # runs in runs
        yield (["a"] * m + ["b"]) * 4
        yield (["a", "b"] * m + ["a"]) * 3
        yield ((["a"] * m + ["b"]) * 3 + ["c"]) * 3
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]


@pytest.mark.parametrize("max_pairs", [1, 17, 1 << 20])
def test_runs(max_pairs):
    lists = list(word_lists())
    names: dict = {}
    flat = np.array([names.setdefault(w, len(names)) for ws in lists for w in ws])
    starts = np.r_[0, np.cumsum([len(ws) for ws in lists])]
    got = periodic.runs_of_words(flat, np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]), max_pairs)
    want = [(s + a, length, q) for ws, a in zip(lists, starts.tolist(), strict=False) for s, length, q in plain_runs(ws)]
    assert sorted(map(tuple, got.tolist())) == sorted(want) and len(want) > 500


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_find_runs(spark):
    texts = [" ".join(ws) for ws in word_lists()] + [None, "", " \n", "é日 " * 40, "a b " * 20, "one\ttwo\x0bthree\n" * 9, "w " * 60_000 + "x", "\x1c \x1c " * 9]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit(1), "collapsed": F.lit(2)})
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.find_runs(df, 1000).collect())
    want = Counter()
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        runs = [(0, 60_000, 1)] if len(words) > 50_000 else plain_runs(words)
        want[i // 2, len(words), tuple(sorted(runs, key=lambda r: (r[0], r[2]))), collapsed(words, runs)] += 1
    assert got == want
    assert not periodic.find_runs(df.limit(0)).collect()


def test_periodic_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    planted = 0
    assert len(got) == len(docs)
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), s, length, q, length and 1000 * length // q)
        assert (r.runs_sha256, r.collapsed_sha256) == (digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)))
    assert planted > 10


# --- op13


def test_targets():
    got = mixing.targets({"b": 10, "a": 100, None: 1, "": 5}, Fraction(174), (3, 1, 2), 2)
    # order: '', a, b, null; weights 3, 1, 2, 3
    assert got[""] == 10 and got["b"] == 20 and got[None] == 2 and got["a"] == 142
    assert mixing.targets({}, Fraction(0), (1,), 2) == {} and mixing.targets({"a": 0}, Fraction(0), (1,), 2) == {"a": 0}
    even = mixing.targets({"a": 100, "b": 100}, Fraction(90), (2, 1), 2)
    assert even == {"a": 60, "b": 30}


def test_route_is_a_cheapest_largest_flow():
    """Against all ways to share out small patterns."""
    rng = random.Random(2)
    for _ in range(60):
        sources = "xyz"
        members = {p: rng.sample(sources, rng.randrange(1, 4)) for p in "PQR"[: rng.randrange(1, 4)]}
        sizes = {p: rng.randrange(3) * 2 for p in members}
        quotas = {s: rng.randrange(5) for s in sources}
        got = mixing.route(sizes, members, quotas, 2, 2)
        cost = lambda given: sum(k // (max(sizes[p], 1) / 2) for p, n in given.items() for k in range(n))  # noqa: E731  halves of a repetition cost 0, 1, 2, 3

        def feasible(given):
            names = [p for p in members for _ in range(given[p])]

            def place(i, left):
                return i == len(names) or any(left[s] > 0 and place(i + 1, left | {s: left[s] - 1}) for s in members[names[i]])

            return place(0, dict(quotas))

        ways = [dict(zip(members, w, strict=True)) for w in product(*(range(2 * sizes[p] + 1) for p in members))]
        able = [w for w in ways if feasible(w)]
        most = max(sum(w.values()) for w in able)
        assert feasible(got) and sum(got.values()) == most
        assert cost(got) == min(cost(w) for w in able if sum(w.values()) == most)


@pytest.mark.parametrize(("cell_rows", "off"), [(4, None), (1024, 0.02)])
def test_mix(spark, sf_dir, cell_rows, off):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"size": F.lit("clash"), "left": F.lit(1), "pattern": F.lit(2)})
    rows = mixing.mix(docs, cell_rows=cell_rows).collect()
    again = mixing.mix(docs.repartition(3), cell_rows=cell_rows).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again) and len(rows) == docs.count()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    by_source: dict = defaultdict(list)
    for r in rows:
        assert r["size"] == words[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"]) and len(r.sources) == 1
        by_source[r.sources[0], r.source_sizes[0], r.targets[0]].append(r)
    sizes = {s: n for s, n, _ in by_source}
    want = mixing.targets(sizes, Fraction(3, 2) * sum(sizes.values()), (3, 1, 2), 2)
    for (s, n, target), of in by_source.items():
        assert n == sum(r["size"] for r in of) and target == float(want[s])
        assert abs(sum(r.taken for r in of) - target) <= (off * target if off else max(r["size"] for r in of))
    one = {r.doc_id: r.copies for r in rows}
    assert {r.doc_id: r.copies for r in mixing.mix(docs, seed=99).collect()} != one  # the seed decides


def test_mix_of_many_rows(spark):
    """Ends are found over several rounds of digits, and cells stay large enough to be filled well."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', CAST(1 + id % 300 AS INT))").alias("text"), F.expr("IF(id % 7 = 0, 'b', 'a')").alias("source"))
    by = mixing.mix(df, weights=(2, 3), share=Fraction(11, 10), cell_rows=32).groupBy("sources").agg(F.sum("taken").alias("taken"), F.first("targets").alias("targets"), F.max("copies").alias("copies")).collect()
    assert len(by) == 2 and all(abs(r.taken - r.targets[0]) <= 100 for r in by) and {r.copies for r in by} == {1, 2}


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None), (1, "a b", None), (1, "a b", None), (2, "", "s"), (3, " \n", ""), (4, "x " * 50_000, "long"), (5, "y", "long")] + [(6, "same text here", "copies")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, cell_rows=8).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    copies = [r for r in got if r.sources[0] == "copies"]
    assert abs(sum(r.taken for r in copies) - copies[0].targets[0]) <= 1.5
    assert [r for r in got if r.doc_id is None][0]["size"] == 0
    assert not mixing.mix(df.limit(0)).collect()
    with pytest.raises(ValueError, match="more than 2 sets"):
        mixing.mix(df, max_patterns=2)


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 30), rng.sample(["web", "code", "books"], rng.randrange(1, 3))) for i in range(400)] + [(-1, "none", [])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 4, 1), share=Fraction(1, 2)).collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - total / 2) < 0.01 * total and max(r.copies for r in got) == 1
    assert all(len(r.sources) == len(r.targets) == len(r.source_sizes) for r in got) and [r.taken for r in got if r.doc_id == -1] == [0]
    only = lambda s: sum(r.taken for r in got if r.sources == [s])
    target = {s: t for r in got for s, t in zip(r.sources, r.targets, strict=True)}
    for s in ("web", "code", "books"):  # what a source gets lies between what only it can use and what it has a part in
        assert only(s) <= target[s] * 1.02 <= 1.05 * sum(r.taken for r in got if s in r.sources) + 50


def test_fill_comes_near():
    cell = pd.DataFrame({"key": list("abcdefg"), "size": [70, 50, 33, 20, 9, 4, 100], "left": 141, "full": 1})
    out = mixing._fill(cell)
    assert sum(out["size"] * (out["copies"] - 1)) == 141 - 1 or sum(out["size"] * (out["copies"] - 1)) == 141
