"""Chunking: paragraphs, sections, types, merging and packing."""

import pytest
import random

from pyspark.sql import functions as F

from bidscreen.operators import chunking
from bidscreen.profile import LATIN, ZH


def docs(spark, *texts):
    return spark.createDataFrame([("t", f"d{i}", i, t) for i, t in enumerate(texts)], "task_id string, doc_id string, doc_ord int, text string")


def chunk(spark, *texts, profile=ZH):
    return sorted(chunking.chunk_documents(docs(spark, *texts), profile).collect(), key=lambda r: (r.doc_id, r.chunk_index))


LONG = "本公司拥有完善的质量管理体系并且长期从事医疗设备的生产与销售工作"


def test_heading_is_kept_without_its_mark(spark):
    rows = chunk(spark, "§H§总则\n\n" + LONG)
    assert [(r.text, r.is_heading) for r in rows] == [("总则", True), (LONG, False)]


def test_short_paragraphs_merge_by_fives(spark):
    rows = chunk(spark, "\n\n".join(f"条目{i}" for i in range(6)))
    assert [r.text for r in rows] == ["条目0\n条目1\n条目2\n条目3\n条目4"]


def test_a_long_paragraph_ends_a_run(spark):
    rows = chunk(spark, f"短\n\n{LONG}\n\n短2")
    assert [r.text for r in rows] == [LONG]


def test_table_rows(spark):
    rows = chunk(spark, "[表格] 姓名:张三 | 岗位:项目经理 | 年限:10年\n\n[表格] 姓名:李四 | 岗位:项目经理 | 年限:12年")
    assert {r.chunk_type for r in rows} == {"table_row"}


def test_long_paragraph_is_packed_by_sentences(spark):
    sentence = "这是一个用于测试的完整句子它的长度并不是很长。"
    rows = chunk(spark, sentence * 60)
    assert len(rows) >= 2 and all(len(r.text) <= 600 for r in rows)
    assert "".join(r.text for r in rows) == sentence * 60


def test_section_goes_on_to_the_next_title(spark):
    rows = chunk(spark, f"一、技术方案\n\n{LONG}\n\n二、商务条款\n\n{LONG}。")
    by_text = {r.text: r.section_title for r in rows}
    assert by_text[LONG] == "一、技术方案" and by_text[LONG + "。"] == "二、商务条款"


@pytest.mark.parametrize("text,kind", [("报价单见附件", "price_param"), ("依照第三条的规定", "normal"), ("依照第三条，规定", "legal_ref"), ("GB/T 19001 标准", "standard_ref"), ("接口与协议", "tech_spec"), ("[表格标题] a", "table_header")])
def test_types(spark, text, kind):
    assert docs(spark, text).select(chunking.chunk_type(F.col("text"), ZH).alias("k")).first().k == kind


def test_ids_number_densely_and_beyond_four_digits(spark):
    rows = chunk(spark, "\n\n".join(LONG + str(i) for i in range(3)))
    assert [r.chunk_index for r in rows] == [0, 1, 2] and len({r.chunk_id for r in rows}) == 3
    assert spark.range(1).select(F.format_string("%04d", F.lit(12345)).alias("x")).first().x == "12345"


def test_sliding_windows(spark):
    sizes = docs(spark, "x" * 1300, "y" * 10, "").select(F.transform(chunking.sliding_windows(F.col("text"), ZH), F.length).alias("n")).collect()
    assert [r.n for r in sizes] == [[600, 600, 600, 400], [10], []]


def test_pages_are_found_by_the_beginning_of_a_chunk(spark):
    d = docs(spark, f"{LONG}\n\n{LONG[::-1]}")
    pages = spark.createDataFrame([("d0", 0, 1), ("d0", len(LONG) + 2, 2)], "doc_id string, offset int, page_num int")
    rows = chunking.chunk_documents(d, ZH, pages).orderBy("chunk_index").collect()
    assert [r.page_num for r in rows] == [1, 2]


def test_null_and_empty_texts_have_no_chunks(spark):
    assert chunk(spark, None, "", "  \n\n ") == []


def test_result_does_not_depend_on_partitions(spark):
    d = docs(spark, *[f"A title\n{'word ' * (50 + i)}.\nshort\nlines\n" for i in range(20)])
    one = chunking.chunk_documents(d.repartition(1), LATIN).collect()
    many = chunking.chunk_documents(d.repartition(7), LATIN).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_first_places():
    rng = random.Random(4)
    text = "".join(rng.choices("ab ü日😀", k=3000)) + "the end"
    prefixes = ["", "the end", "no such", text[:30], text[700:730], text[699:729], text[2999:], text, text + "x", "ab", "😀", text[10:40], text[10:40]] + [text[i : i + rng.randrange(1, 30)] for i in range(0, 2900, 37)]
    for block in (1, 7, 1000, 1 << 18):
        assert chunking.first_places(text, prefixes, block) == [text.find(p) for p in prefixes]
    assert chunking.first_places("", ["", "a"]) == [0, -1]


def test_pages_of_a_long_document(spark):
    """5 MB and 10,000 chunks: no text beside a chunk but its own."""
    lines = [f"{i:06d} " + "word " * 100 for i in range(10_000)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([("t", "long", text), ("t", "null", None), ("u", "long", "other")], "task_id string, doc_id string, text string")
    chunks = spark.createDataFrame([("t", "long", i, line[:50]) for i, line in enumerate(lines)] + [("t", "null", 0, "x"), ("t", "gone", 0, "y"), ("t", "long", -1, "not there"), ("u", "long", 0, "other")], "task_id string, doc_id string, n int, text string")
    pages = spark.createDataFrame([("long", i * 50_700, i + 1) for i in range(100)], "doc_id string, offset int, page_num int")
    found = chunking.look_up_pages(chunks, docs, pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "locate" not in plan and found.columns == ["task_id", "doc_id", "n", "text", "page_num"]
    at, place = {}, 0
    for i, line in enumerate(lines):
        at[i] = place // 50_700 + 1
        place += len(line) + 1
    got = {(r.task_id, r.doc_id, r.n): r.page_num for r in found.collect()}
    assert len(text) > 5_000_000 and got == {("t", "long", i): min(p, 100) for i, p in at.items()} | {("t", "null", 0): 0, ("t", "gone", 0): 0, ("t", "long", -1): 0, ("u", "long", 0): 1}
