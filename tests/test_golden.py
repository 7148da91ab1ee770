"""The six sample cases, all at once through the verification graph."""

import pytest
from pyspark.sql import functions as F

from milaan.operators import pairs, scoring
from milaan.plans.verify import Verification
from tests.golden import CASES, FORMS

DOCS_DDL = "case_id long, doc_ord int, doc_type string, source_file string, fields map<string,string>"
FORMS_DDL = "case_id long, service_id string, answers map<string,string>"


@pytest.fixture(scope="module")
def graph(spark):
    docs = [(n, i, d, f"f{i}.jpg", f) for n, case in enumerate(CASES) for i, (d, f) in enumerate(case[2])]
    forms = [(n, case[0], FORMS[case[1]]) for n, case in enumerate(CASES)]
    return Verification(
        spark.createDataFrame(forms, FORMS_DDL), spark.createDataFrame(docs, DOCS_DDL), F.lit("2026-01-01").cast("date"), keep=True
    )


def by_case(frame, *columns):
    return {r["case_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_pair_counts(graph):
    got = by_case(graph.summary, "matches", "variants", "blockers", "uncertain")
    assert got == {n: (*case[3], 0) for n, case in enumerate(CASES)}


def test_blockers_and_primary(graph):
    got = {}
    for r in graph.blocker_counts.collect():
        got.setdefault(r["case_id"], {})[r["doc_type"]] = r["blockers"]
    assert got == {n: case[4] for n, case in enumerate(CASES) if case[4]}
    assert by_case(graph.primary, "primary_doc") == {n: (case[5],) for n, case in enumerate(CASES) if case[5]}


def test_scores(graph):
    assert by_case(graph.scores, "score", "grade") == {n: (case[6], case[7]) for n, case in enumerate(CASES)}
    ready = by_case(graph.scores, "ready_for_portal")
    assert ready[0] == (True,) and ready[2] == (False,)


def test_document_accuracy(graph):
    got = {}
    for r in graph.accuracy.orderBy("doc_ord").collect():
        got.setdefault(r["case_id"], []).append((r["doc_type"], r["overall_pct"]))
    assert got == {n: case[8] for n, case in enumerate(CASES)}
    assert by_case(scoring.case_accuracy(graph.accuracy), "accuracy_pct") == {n: (case[9],) for n, case in enumerate(CASES)}


def test_first_case_in_detail(graph):
    found = graph.comparisons.where("case_id = 0 AND status = 'CRITICAL'").select("field", "doc_a", "doc_b").collect()
    assert {tuple(r) for r in found} == {
        ("address", "Aadhaar Card", "Driving License"), ("address", "Bank Passbook", "Driving License"),
    }
    assert {r["status"] for r in graph.checks.where("case_id = 0").collect()} == {"MATCH"}
    impact = graph.impact.where("case_id = 0").first()
    assert (impact["caught"], impact["minutes_saved"], impact["ready"]) == (2, 16, False)


def test_form_checks_of_the_partial_form(graph):
    got = {r["form_key"]: r["status"] for r in graph.checks.where("case_id = 2").collect()}
    assert got == {
        "full_name": "MATCH", "dl_number": "MATCH", "dob": "MATCH", "old_address": "MATCH", "new_address": "VARIANT",
        "father_name": "UNCERTAIN", "pan_number": "UNCERTAIN",
    }


def test_counts_add_up(graph):
    total = graph.comparisons.agg(F.sum("n_pairs")).first()[0]
    parts = graph.summary.agg(F.sum(F.expr("matches + variants + blockers + uncertain"))).first()[0]
    assert total == parts == pairs.verdict_by_field(graph.comparisons).agg(F.sum("pairs")).first()[0]


def test_packs_hold_the_whole_case(graph):
    pack = graph.packs.where("case_id = 0").collect()
    assert sorted(r["kind"] for r in pack) == ["document"] * 4 + ["head"]
    head = next(r["pack"] for r in pack if r["kind"] == "head")
    assert '"grade":"READY"' in head and '"flags"' not in head
