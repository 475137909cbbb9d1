"""Quality rules, BPE, token counts, packing, language and chat formatting against plain versions."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidscreen.llm import bpe, chat, language, packing, quality, queries, token_counts
from bidscreen.llm.common import crc_of_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n", "a", "  a", "a  b   c", "a\n\n b \n c\n ", "x \t y", "a<|endoftext|> b  <|endoftext|>", "aaaaaaa aaaa", "don't we'll  it's", "é ü \u00a0 \u3000 x", "\x01 a", "日本語 テスト 😀😀", "1234 ٣٤ ² ½", "a\r\n\r\nb", "a\x1c b", "tail \n ", "word " * 3000, "x" * 5000]


def frame(spark, texts, more=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_words": F.lit("clash"), "id": F.lit(1), "score": F.lit("x"), "lang_pred": F.lit(2)}) if more else df


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_bpe_equals_the_library(spark, documents, tokenizer):
    texts = ODD + [r.text for r in documents.select("text").collect()]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts, True), queries.tokenizer_path()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_digests(spark):
    texts = ["a b", None]
    plain = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), queries.tokenizer_path()).collect()}
    for r in bpe.encode_decode(frame(spark, texts), queries.tokenizer_path(), with_ids=False).collect():
        assert r.ids_sha256 == hashlib.sha256(plain[r.doc_id].ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].decoded.encode()).hexdigest()


def test_bpe_cache_is_bounded_and_harmless(tokenizer):
    e = bpe.TextEncoder(bpe.numpy_encoder(queries.tokenizer_path()).encode_units, {}, max_units=5)
    for text in ("one two three four five six seven", "eight nine ten", "one two"):
        ids, at = e.encode([text])
        assert ids.tolist() == tokenizer.encode(text).ids and at.tolist() == [0, len(ids)]


def token_spans(tokenizer, text):
    """Character spans of tokens, from their bytes."""
    v = bpe.vocabulary(queries.tokenizer_path())
    raw, at, out = text.encode(), 0, []
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        end = at + int(v.length[i])
        first = len(raw[: at + 1].decode("utf-8", "ignore")) if (raw[at] & 0xC0) != 0x80 else len(raw[:at].decode("utf-8", "ignore"))
        head = sum((b & 0xC0) != 0x80 for b in raw[: at + 1]) - 1
        tail = sum((b & 0xC0) != 0x80 for b in raw[:end]) - 1
        out.append((head, tail))
        at = end
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, tokenizer, rule):
    texts = ["one two\nthree\n\nfour", "a\n\n\nb\n", "", None, "日本\n語😀\nx", "  \n \n  x"]
    got = token_counts.count_by_section(frame(spark, texts, True), queries.tokenizer_path(), rule).orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        t = t or ""
        rows = [r for r in got if r.doc_id == i]
        starts = [0] + [m.end() for m in re.finditer("\n", t)]
        assert [(r.begin, r.end) for r in rows] == list(zip(starts, [*starts[1:], len(t)], strict=True))
        want = [0.0] * len(starts)
        for a, b in token_spans(tokenizer, t) if t else []:
            share = Counter(max(k for k, s in enumerate(starts) if s <= c) for c in range(a, b + 1))
            if rule == "start":
                want[min(share)] += 1
            elif rule == "majority":
                want[min(share, key=lambda k: (-share[k], k))] += 1
            else:
                for k, n in share.items():
                    want[k] += n / (b - a + 1)
        assert [r.n_tokens for r in rows] == pytest.approx(want)
        ends = [(max(k for k, s in enumerate(starts) if s <= a), max(k for k, s in enumerate(starts) if s <= b)) for a, b in (token_spans(tokenizer, t) if t else [])]
        assert [r.n_crossing for r in rows] == [sum(a == k < b for a, b in ends) for k in range(len(starts))]
    whole = {r.doc_id: r for r in token_counts.count_by_document(frame(spark, texts), queries.tokenizer_path(), rule).collect()}
    assert all(whole[i].n_tokens == len(tokenizer.encode(t or "").ids) for i, t in enumerate(texts))
    for i in whole:  # the other columns, from the sections
        rows = [r for r in got if r.doc_id == i]
        told = (whole[i].n_sections, whole[i].n_crossing, whole[i].max_section_tokens, whole[i].section_crc32)
        assert told == (len(rows), sum(r.n_crossing for r in rows), max(r.n_tokens for r in rows), zlib.crc32(struct.pack(f"<{len(rows)}d", *[r.n_tokens for r in rows])))
    assert all(sum(r.n_tokens for r in got if r.doc_id == i) == pytest.approx(whole[i].n_tokens) for i in whole)


def test_token_counts_of_repeated_long_and_no_rows(spark, tokenizer):
    long = "some words of a line\n" * 60_000 + "x" * 3_000
    df = spark.createDataFrame([(1, "a\nb", 7), (1, "a\nb", 7), (2, long, 7)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_by_document(df, queries.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_sections) for r in got) == sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids), t.count("\n") + 1) for i, t, _ in df.collect())
    assert len({r for r in got if r.doc_id == 1}) == 1
    for f in (token_counts.count_by_document, token_counts.count_by_section):
        assert f(df.where("false"), queries.tokenizer_path()).count() == 0


def test_packing(spark, documents, tokenizer):
    texts = ODD + [r.text for r in documents.select("text").collect()] + ["same"] * 50
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    rows = packing.pack_documents(frame(spark, texts, True).repartition(5), queries.tokenizer_path(), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert len(by_doc) == len(texts)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids[i]
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert len(own) == ceil(len(ids[i]) / 2048) and all(r.length == 2048 for r in own[1:])
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert len(by_sequence) <= ceil(sum(map(len, ids)) / 2048) * 1.01 + 2
    assert packing.pack_documents(frame(spark, []), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plans(seed):
    rng = np.random.default_rng(seed)
    sizes = {0: rng.integers(1, 101, 3000), 1: np.clip(rng.lognormal(3, 1, 3000), 1, 100).astype(int), 2: rng.choice([34, 51, 35, 45], 3000), 3: np.full(1000, 100)}[seed]
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    runs = packing.plan(counts, 100)
    assert all(sum(s * k for s, _, k in r.slots) + r.room == 100 and r.room >= 0 for r in runs)
    placed = Counter()
    for r in runs:
        for size, rank, k in r.slots:
            placed.update((size, q) for q in range(rank, rank + k * r.n))
    assert set(placed.values()) == {1} and Counter(s for s, _ in placed) == Counter(counts)
    fitted = packing.best_fit([], [(s, 0, n) for s, n in counts.items()], 100)
    assert sum(r.n for r in runs) <= sum(r.n for r in fitted)


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents):
    rng = random.Random(3)
    few = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts = ODD + few + [r.text for r in documents.select("text").collect()] + ["# & |\nx\nx\n \n \nx"]
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts, True)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and not r.failed)
    kept = quality.keep(documents)
    assert kept.columns == documents.columns
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_keeps_good_documents_and_drops_bad_ones(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = quality.judge(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in found}
    assert share[1] > 0.99 and share[0] < 0.5


def plain_buckets(text, s):
    """One n-gram after another, by Python's integers."""
    out = []
    for n in s.orders:
        for i in range(len(text.lower()) - n + 1):
            h = 0
            for c in text.lower()[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out.append((h + n) % 2**64 % s.buckets)
    return out


def plain_posterior(text, model):
    total = model.log_prior + sum(model.log_prob[b] for b in plain_buckets(text, model.settings))
    return np.exp(total - total.max()) / np.exp(total - total.max()).sum()


def test_language_in_batches():
    rng = np.random.default_rng(3)
    s = language.Settings(buckets=256, orders=(1, 2, 3))
    model = language.Model(["a", "b", "c"], np.log([0.2, 0.3, 0.5]), rng.normal(-5, 0.05, (256, 3)), s)
    texts = ["", "x", "Éa", "12 3", "word " * 40, "\U0001d7d8 x", "İstanbul", "ab"]
    lang, score, fit = model.score(texts)
    for t, got, value in zip(texts, lang, score, strict=True):
        p = plain_posterior(t, model)
        assert (got, value) == ("und", 0) if not any(c.isalpha() for c in t) else got == model.languages[int(p.argmax())] and abs(value - p.max()) < 1e-9
    for t, got, value in zip(texts, lang, fit, strict=True):
        own = model.languages.index(got) if got in model.languages else 0
        buckets = plain_buckets(t, s)
        level = (np.exp(model.log_prob[:, own]) * model.log_prob[:, own]).sum()
        assert value == (0 if got == "und" else pytest.approx(model.log_prob[buckets, own].mean() - level))
    assert model.score([])[0] == []
    long = ["ab cd" * 400_000, "short one"]  # more n-grams than one part gathers
    assert [x for x in model.score(long)[1]] == pytest.approx([model.score([t])[1][0] for t in long])


def test_language_counts(spark):
    rows = [(1, "Ab ab", "en"), (2, "äb", "de"), (3, "ab", "en"), (3, "ab", "en"), (4, None, "en"), (5, "zz", None), (6, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = language.Settings(buckets=128, smoothing=1.0)
    model = language.train(df.repartition(3), s)
    assert model.languages == ["de", "en", "fr"]
    for i, lang in enumerate(model.languages):
        n = np.ones(128)
        for _, text, own in rows:
            if own == lang and text:
                np.add.at(n, plain_buckets(text, s), 1)
        assert np.allclose(model.log_prob[:, i], np.log(n / n.sum()))
    assert np.allclose(np.exp(model.log_prior), [1 / 5, 3 / 5, 1 / 5])
    with pytest.raises(ValueError):
        language.train(df, language.Settings(max_languages=2))
    copies = spark.createDataFrame([(i, "same text", "en") for i in range(4000)], "doc_id long, text string, lang string")
    drawn = language.train(copies, language.Settings(buckets=4096, orders=(1,), max_train_docs=1000, smoothing=1.0))
    p = np.exp(drawn.log_prob[plain_buckets("t", drawn.settings)[0], 0])  # two of nine characters of each text drawn
    assert 800 < (4096 * p - 1) / (2 - 9 * p) < 1200


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").withColumn("held_out", crc_of_id("doc_id") % 3 == 1)
    model = language.train(docs.where("NOT held_out"))
    found = language.predict(docs.where("held_out"), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95 and all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in language.predict(frame(spark, ODD, True), model).collect()}
    assert all((odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(ODD))
    plain = "ab é"
    want = plain_posterior(plain, model)
    assert model.score(["x", plain])[0][1] == model.languages[int(np.argmax(want))]
    empty = language.train(docs.where("false"))
    assert language.predict(frame(spark, ["a"]), empty).first().lang_pred == "und"


def test_long_texts_are_scored_whole():
    s = language.Settings(buckets=1 << 10)
    text = "abcdefghij" * 250_000
    parts = np.concatenate([b for b, _ in language.batch_buckets([text], s)])
    assert len(parts) == sum(len(text) - n + 1 for n in s.orders)
    short = np.bincount(np.concatenate([b for b, _ in language.batch_buckets([text[:1000]], s)]), minlength=1 << 10)
    assert set(np.flatnonzero(short)) >= set(np.flatnonzero(np.bincount(parts, minlength=1 << 10)))


CHAT = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ ok [/INST]\\"), (2, 1, "assistant", "b"), (2, 0, "sys\ntem\\", None), (2, 1, "assistant", "b"), (3, 0, None, ""), (None, 0, "user", "x"), (4, None, "assistant", "a\n</s>\n<s>")]


def test_chat(spark):
    c = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("begin", F.lit("clash"))
    rows = chat.format_conversations(c).collect()
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(c)).collect()}
    by_conv = {}
    for conv, turn, role, text in sorted(CHAT, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in by_conv.items():
        whole = chat.instruct_template(turns)
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        assert "".join(r.formatted for r in own) == whole and [whole[r.begin :].startswith(r.formatted) for r in own] == [True] * len(own)
        said = "".join(t for r, t in turns if r == "assistant")
        d = got[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars, d.rewritten) == (len(turns), len(said), len(whole), 0)
        assert d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(c.where("false"))).count() == 0


def test_chat_escapes_are_reversible_and_templates_that_rewrite_show():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<", "s", ">", "/", "[", "INST", "]", "</s>", "[/INST]", " ", "\n"]) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    last_only = lambda ts: "".join(t for _, t in ts[:-1]) + f"<{ts[-1][1]}>"
    assert [x[2] for x in chat.spans(last_only, turns)] == [0, 3, 3]
    assert [x[2] for x in chat.spans(chat.instruct_template, turns)] == [0, 0, 0]


def test_chat_segments(spark):
    c = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(25)], "conv_id long, turn long, role string, text string")
    one, many = (sorted(map(tuple, chat.format_conversations(c, segment_turns=n).collect())) for n in (512, 4))
    assert one == many
    assert json.dumps(one)


@pytest.mark.parametrize("name", ["header", "numbered", "last_marked"])
def test_chat_segments_refuse_templates_that_look_back(spark, name):
    """What a border between segments would change is an error, never another result."""
    templates = {
        "header": lambda ts: "# chat\n" + chat.instruct_template(ts),
        "numbered": lambda ts: "".join(f"{i} {t}\n" for i, (_, t) in enumerate(ts)),
        "last_marked": lambda ts: "".join(t for _, t in ts[:-1]) + f"<{ts[-1][1]}>",
    }
    c = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(c, templates[name]).count() == 9
    with pytest.raises(Exception, match="raise segment_turns"):
        chat.format_conversations(c, templates[name], segment_turns=4).collect()
