"""Registered queries against their check SQL at the smallest scale."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.queries import ORACLE_SQL
from milaan.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
# One query per family here; `python -m checks.compare` runs all of them.
SAMPLE = [
    "cross_doc_pairs", "majority_vote", "form_vs_docs", "check_detail", "validate_answers", "case_score", "rejection_risks",
    "doc_overall_pct", "extract_fields", "parse_model_replies", "matrix_vs_reference", "turn_outcomes", "form_fill_stream",
    "case_patch_stream", "apply_case_patches", "verify_stream", "quarantine_stream", "verify",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_check(spark, con, name):
    problem, _, rows = differences(spark, con, name, SF)
    assert problem is None and rows > 0


def test_every_query_has_a_check():
    assert set(ORACLE_SQL) == set(QUERIES) <= set(contract.queries())


def test_entry_has_a_row_per_case(spark):
    assert contract.entry(spark).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
