"""Composite risk from all evidence of two documents."""

from difflib import SequenceMatcher

import duckdb
import pytest

from bidscreen.plans import base
from bidscreen.plans.catalog import ORACLES, QUERIES, composite_risk

OPENINGS = ["Opening remarks", "Second heading", "Third heading", "Closing words"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    texts = {
        1: "\n".join([*OPENINGS, "mail to one@a.example, call +1 (555) 123-4567"]),
        2: "\n".join([*OPENINGS, "letters go to two@b.example or ring +1 (555) 123-4568"]),
        3: "\n".join([OPENINGS[0], "quite another text", "of other lines", "and no number"]),
        4: "nothing shared with any other one",
    }
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), texts


def test_structure_and_fuzzy_fields_are_evidence(spark, sf):
    folder, texts = sf
    got = {(r.doc_a, r.doc_b): r for r in base.signals(spark, folder).collect()}
    lines = {i: t.split("\n") for i, t in texts.items()}
    want = {}
    for a in lines:
        for b in lines:
            common = len({*lines[a]} & {*lines[b]})
            if a < b and common:
                jaccard = common / len({*lines[a]} | {*lines[b]})
                want[a, b] = round((jaccard + SequenceMatcher(None, lines[a], lines[b]).ratio()) * 50, 2)
    assert {k: r.overall_score for k, r in got.items() if r.overall_score} == want and set(want) == {(1, 2), (1, 3), (2, 3)}
    phones = [r.value for r in base.key_fields(spark, folder).where("field_type = 'phone'").collect()]
    assert len(phones) == 2 and got[1, 2].fuzzy_count >= 1
    assert got[1, 3].fuzzy_count == 0 and not any(4 in k for k in got)


def test_alike_rule_fires_in_the_flagship(spark, sf):
    r = composite_risk(spark, sf[0]).where("doc_a = 1 AND doc_b = 2").first()
    assert r.n_signals >= 1 and r.final_level in ("medium", "high")
    c = base.composite(spark, sf[0]).where("doc_a = 1 AND doc_b = 2").first()
    assert any(s.startswith("structure") for s in c.triggered_signals)


@pytest.mark.parametrize("name", ["all_overlaps", "structure_signal", "composite_risk"])
def test_sql_with_fuzzy_fields_and_structure(spark, sf, name):
    """On documents that do share similar phones and headings: the given tables have no such phones."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf[0]}/documents.parquet/*.parquet')")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf[0]).collect()), key=repr) == want and want
