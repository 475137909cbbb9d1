"""Scores, verdicts, roll-up, synthesis, reports, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from bidscreen.operators import report, scoring, similarity, synthesis
from bidscreen.profile import ZH
from bidscreen.sources import ingest, sinks


def pair_of(spark, similarity_, listed=False, section="", kind="normal", keywords=("a", "b")):
    rows = [("t", f"c{i}", f"d{i}", i, 0, f"text {i}", section, kind, 0, listed) for i in (0, 1)]
    c = spark.createDataFrame(rows, "task_id string, chunk_id string, doc_id string, doc_ord int, chunk_index int, text string, section_title string, chunk_type string, page_num int, is_whitelisted boolean")
    k = spark.createDataFrame([("t", f"c{i}", list(keywords)) for i in (0, 1)], "task_id string, chunk_id string, keywords array<string>")
    near = spark.createDataFrame([("t", "c0", "c1", similarity_)], "task_id string, chunk_a string, chunk_b string, similarity double")
    return scoring.score_pairs(near, c, k).first()


def test_scores(spark):
    assert pair_of(spark, 1.0, section="s", kind="tech_spec").base_risk_score == 87.25
    assert pair_of(spark, 0.95, listed=True).base_risk_score < 55
    assert pair_of(spark, 0.80, section="s", kind="tech_spec", keywords=()).base_risk_score > 48
    p = pair_of(spark, 0.84996 / 0.6, keywords=())
    assert (p.base_risk_score, p.risk_level) == (85.0, "medium")


@pytest.mark.parametrize("score,kind", [(90.0, "high"), (70.0, "medium"), (50.0, "low"), (30.0, "none")])
def test_levels(spark, score, kind):
    assert spark.range(1).select(scoring.risk_level(F.lit(score)).alias("x")).first().x == kind


GOOD = {"risk_level": "high", "risk_type": "verbatim_copy", "confidence": 0.95, "reason_zh": "r" * 20, "score_adjustment": 15}


@pytest.mark.parametrize("content,final", [(json.dumps(GOOD), 75.0), ("see: " + json.dumps(GOOD) + " .", 75.0), (json.dumps(GOOD | {"score_adjustment": 25}), 60.0), (json.dumps(GOOD | {"reason_zh": "short"}), 60.0), (json.dumps(GOOD | {"confidence": 1.5}), 60.0), (json.dumps(GOOD | {"risk_type": "error_replication"}), 60.0), ("nothing", 60.0), (None, 60.0)])
def test_verdicts(spark, content, final):
    p = spark.createDataFrame([("t", "p", 60.0, 60.0, "low")], "task_id string, pair_id string, base_risk_score double, final_score double, risk_level string")
    v = spark.createDataFrame([("t", "p", content)], "task_id string, pair_id string, content string")
    r = scoring.apply_verdicts(p, scoring.parse_verdicts(v)).first()
    assert r.final_score == final and (r.reason_zh == scoring.NO_VERDICT) == (final == 60.0)


@pytest.mark.parametrize("levels,chunks,expect", [(["high"] * 3, 10, ("high", 0.3)), (["medium"] * 5, 20, ("medium", 0.25)), (["medium"] * 6, 20, ("high", 0.3)), (["none"], 5, ("low", 0.0))])
def test_text_risk(spark, levels, chunks, expect):
    pairs = spark.createDataFrame([("t", f"c{i}", k) for i, k in enumerate(levels)], "task_id string, chunk_a string, risk_level string")
    n = spark.createDataFrame([("t", "d0", 0, chunks), ("t", "d1", 1, 99)], "task_id string, doc_id string, doc_ord int, n_chunks int")
    r = scoring.text_risk(pairs, n).first()
    assert (r.text_level, r.text_rate) == expect


PAIR = "task_id string, doc_a string, doc_b string, ord_a int, ord_b int, "
KEY = ("t", "a", "b", 0, 1)


def final(spark, text=("low", 0.0), structure=None, overlaps=(), rare=0, price=None, meta=None):
    make = lambda row, schema: spark.createDataFrame([KEY + row], PAIR + schema)
    out = synthesis.assemble(
        text=make(text, "text_level string, text_rate double"),
        structure=make((float(structure), "x"), "overall_score double, structure_level string") if structure else None,
        overlaps=spark.createDataFrame([KEY + o for o in overlaps], PAIR + "field_type string, overlap_type string, value_a string") if overlaps else None,
        rare=make((rare, "x"), "total_match_count int, rare_level string") if rare else None,
        price=make((0.01, price), "proximity double, price_level string") if price else None,
        meta=make((*meta, 5.0, ["n"]), "meta_level string, is_timestamp_clustered boolean, time_gap_minutes double, risk_notes array<string>") if meta else None,
    )
    return synthesis.synthesize(out).first()


@pytest.mark.parametrize(
    "given,expect",
    [
        ({}, "low"), ({"text": ("high", 0.5)}, "high"), ({"overlaps": [("phone", "exact", "1")]}, "high"), ({"overlaps": [("team_member", "exact", "x")]}, "high"), ({"overlaps": [("person", "exact", "x")]}, "high"),
        ({"overlaps": [("company", "exact", "x")]}, "low"), ({"rare": 2}, "high"), ({"rare": 1}, "medium"), ({"rare": 1, "text": ("high", 0.4)}, "high"), ({"price": "high"}, "high"), ({"price": "medium"}, "medium"),
        ({"meta": ("high", False)}, "high"), ({"meta": ("medium", True), "text": ("low", 0.20)}, "medium"), ({"meta": ("medium", True), "text": ("low", 0.05)}, "low"), ({"structure": 75, "text": ("low", 0.35)}, "high"), ({"structure": 55, "overlaps": [("company", "fuzzy", "x")]}, "medium"),
    ],
)
def test_synthesis(spark, given, expect):
    r = final(spark, **given)
    assert r.final_level == expect
    assert bool(r.triggered_signals) == bool(set(given) - {"text"} and given != {"overlaps": [("company", "exact", "x")]} and given.get("text") != ("low", 0.05))


def test_retrieval_keeps_first_discovery_and_skips_whitelisted(spark):
    rows = [("t", d, d, f"c{d}", 0, d == 1) for d in range(3)]
    c = spark.createDataFrame(rows, "task_id string, doc_id int, doc_ord int, chunk_id string, chunk_index int, is_whitelisted boolean")
    both = [(a, b, s) for a, b, s in (("c0", "c1", 0.9), ("c0", "c2", 0.8), ("c1", "c2", 0.7))]
    near = spark.createDataFrame([("t", a, b, s) for a, b, s in both] + [("t", b, a, s) for a, b, s in both], "task_id string, chunk_q string, chunk_h string, similarity double")
    got = {(r.chunk_a, r.chunk_b) for r in similarity.retrieve(c, near).collect()}
    assert got == {("c0", "c1"), ("c0", "c2")}
    one = similarity.retrieve(c, near, top=1).collect()
    assert [(r.chunk_a, r.chunk_b) for r in one] == [("c0", "c1")]
    assert {(r.chunk_a, r.chunk_b) for r in similarity.retrieve(c, near, mode="pairwise", restrict_to_pair=True).collect()} == {("c0", "c1")}


def test_sources(spark):
    good, bad = ingest.format_gate(spark.createDataFrame([("a/b.PDF",), ("c.xls",), ("d",), (None,)], "path string"))
    assert [r.suffix for r in good.collect()] == [".pdf"] and bad.count() == 3
    texts, pages = ingest.assemble_pages(spark.createDataFrame([("d", 1, " ab "), ("d", 2, " "), ("d", 3, "c")], "doc_id string, page_num int, text string"))
    assert texts.first().text == "ab\n\nc" and sorted((r.offset, r.page_num) for r in pages.collect()) == [(0, 1), (4, 3)]
    cell = lambda i, t: {"id": i, "text": t}
    rows = [("d", 1, 0, [cell(1, "姓名"), cell(2, "岗位"), cell(3, "年限")]), ("d", 1, 1, [cell(4, "张三"), cell(5, "项目经理"), cell(6, "10年")]), ("d", 1, 2, [cell(7, "合并"), cell(7, "合并"), cell(8, "")]), ("d", 1, 3, [cell(9, ""), cell(10, " "), cell(11, "")])]
    t = spark.createDataFrame(rows, "doc_id string, table_id int, row_idx int, cells array<struct<id:int,text:string>>")
    lines = ingest.render_table_rows(t, ZH)
    assert [r.line for r in lines.orderBy("row_idx").collect()] == ["§H§[表格标题] 姓名 | 岗位 | 年限", "[表格] 姓名:张三 | 岗位:项目经理 | 年限:10年", "[表格] 合并"]
    blocks = spark.createDataFrame([("d", 0, "p", "Heading 1", "总则"), ("d", 1, "tbl", None, None), ("d", 2, "p", None, " ")], "doc_id string, block_idx int, kind string, style string, text string")
    assert ingest.flatten_blocks(blocks, lines, ZH).first().text.startswith("§H§总则\n\n§H§[表格标题]")
    apart = [("e", 1, 0, [cell(1, "甲"), cell(2, "乙"), cell(1, "甲"), cell(None, "丙"), cell(None, "丁")])]
    t = spark.createDataFrame(apart, "doc_id string, table_id int, row_idx int, cells array<struct<id:int,text:string>>")
    assert ingest.render_table_rows(t, ZH).first().line == "§H§[表格标题] 甲 | 乙 | 丙 | 丁"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("质量".encode())
    (tmp_path / "b.txt").write_bytes("质量".encode("gb18030"))
    for setting in ("true", "false"):  # what a file is read as doesn't depend on the session
        spark.conf.set("spark.sql.legacy.javaCharsets", setting)
        try:
            assert sorted((r.encoding, r.text) for r in ingest.read_texts(spark, f"file://{tmp_path}").collect()) == [("gb18030", "质量"), ("utf-8", "质量")]
        finally:
            spark.conf.unset("spark.sql.legacy.javaCharsets")
    (tmp_path / "p.list").write_text("# c\n\nGB\\s*\\d+\n[\n")
    assert ingest.read_patterns(spark, f"file://{tmp_path}/p.list") == ["GB\\s*\\d+"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("t", "c1", 1, "old"), ("t", "c2", 1, "old"), ("u", "c1", 1, "old")], "task_id string, chunk_id string, version int, v string")
    new = spark.createDataFrame([("t", "c1", 2, "new")], old.schema)
    merged = sinks.upsert(old, new)
    assert sorted((r.task_id, r.chunk_id, r.v) for r in merged.collect()) == [("t", "c1", "new"), ("t", "c2", "old"), ("u", "c1", "old")]
    assert sinks.without_tasks(merged, spark.createDataFrame([("t",)], "task_id string")).count() == 1
    sinks.write_partitions(old, f"file://{tmp_path}/chunks")
    sinks.write_json(spark.createDataFrame([("t", "质量", None)], "task_id string, a string, b string"), f"file://{tmp_path}/json")
    text = "".join(p.read_text() for p in (tmp_path / "json").rglob("*.json"))
    assert json.loads(text) == {"task_id": "t", "a": "质量", "b": None}


def test_report_counts_and_evaluation(spark):
    c = spark.createDataFrame([("t", "a", "b", "high"), ("t", "a", "c", "low")], "task_id string, doc_a string, doc_b string, final_level string")
    e = spark.createDataFrame([("t", "a", "b", "high"), ("t", "a", "c", "high"), ("t", "b", "c", "low")], "task_id string, doc_a string, doc_b string, expected string")
    found = {r.expected: r for r in report.evaluate(c, e).collect()}
    assert found["high"].hit_rate == 0.5 and found["low"].hit_rate == 1.0 and found["high"].actual_low == 1


def test_encodings():
    text = "投标文件 No. 12, 质量保证\n价格：100元"
    for name in ("utf-8", "utf-8-sig", "gb18030", "utf-16"):
        assert ingest.decode(text.encode(name))[1] == text
    for name in ("utf-16-le", "utf-16-be"):
        assert ingest.decode("plain text, 质量 once in a long line".encode(name)) == (name, "plain text, 质量 once in a long line")
    assert ingest.decode("标".encode() + b"\xff\xff") == ("utf-8", "标\ufffd\ufffd") and ingest.decode(b"") == ("utf-8", "")
    assert ingest.decode("𠀀㐀é".encode("gb18030")) == ("gb18030", "𠀀㐀é")


def test_metadata_and_phrases(spark):
    meta = spark.createDataFrame([("a.docx", None, "M", None, 1), ("b.PDF", "x", None, None, 1), ("c.DOCX", "y", None, "C", 1)], "path string, author string, last_modified_by string, company string, doc_id int")
    assert sorted((r.path, r.author, r.last_modified_by, r.company) for r in ingest.clean_metadata(meta).collect()) == [("a.docx", "", "M", ""), ("c.DOCX", "y", "", "C")]
    assert ingest.clean_metadata(meta.drop("path")).count() == 3
    lines = spark.createDataFrame([(0, "# comment"), (1, " one phrase "), (2, ""), (3, "another"), (4, "without vector")], "n int, value string")
    vectors = spark.createDataFrame([("one phrase", [1.0]), ("another", [2.0])], "text string, embedding array<double>")
    assert sorted(tuple(r) for r in ingest.read_phrases(lines, vectors).select("phrase_id", "text", "embedding").collect()) == [("wl_000001", "one phrase", [1.0]), ("wl_000003", "another", [2.0])]


def test_csv_and_json_come_back(spark, tmp_path):
    odd = ' a "quoted", line\nand \\ more'
    pair = spark.createDataFrame([("p", "high", 80.5, 0.9, 0.5, "s", 1, odd, None, 2, "x" * 300)], "pair_id string, risk_level string, final_score double, similarity double, keyword_overlap double, section_title_a string, page_num_a int, text_a string, section_title_b string, page_num_b int, text_b string")
    sinks.write_csv(pair, f"file://{tmp_path}/csv")
    (row,) = sinks.read_csv(spark, f"file://{tmp_path}/csv").collect()
    assert len(row) == 15 and (row.doc_a_text, row.doc_b_text, row.doc_b_section, row.final_score, row.doc_b_page) == (odd, "x" * 200, None, "80.5", "2")
    sinks.write_json(spark.createDataFrame([("t", odd, None)], "task_id string, a string, b string"), f"file://{tmp_path}/json")
    (back,) = spark.read.json(f"file://{tmp_path}/json").select("task_id", "a").collect()
    assert tuple(back) == ("t", odd)
