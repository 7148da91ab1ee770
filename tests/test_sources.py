"""Reading and writing."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from milaan.sources import readers, writers
from tests.golden import FORMS, SANIKA_DOCS


def fresh():
    return tempfile.mkdtemp(prefix="run-")


def test_extraction_files_keep_document_order(spark):
    folder = fresh()
    records = [{"doc_type": d, "source_file": "x.jpg", "language": "en-IN", "ocr_text": "t", "fields": f} for d, f in SANIKA_DOCS]
    with open(os.path.join(folder, "case7.json"), "w") as out:
        json.dump(records, out, indent=1)
    rows = readers.load_extraction_files(spark, folder).orderBy("doc_ord").collect()
    assert [r["doc_type"] for r in rows] == [d for d, _ in SANIKA_DOCS[:-1]]
    assert {r["case_id"] for r in rows} == {"case7"}


def test_answer_files_drop_nulls(spark):
    folder = fresh()
    with open(os.path.join(folder, "c1.json"), "w") as out:
        json.dump({**FORMS["rto"], "age": 31, "gone": None}, out)
    row = readers.load_answer_files(spark, folder, "rto_dl_update").first()
    assert row["case_id"] == "c1" and row["answers"]["age"] == "31" and "gone" not in row["answers"]


def test_catalogue_is_flattened(spark):
    folder = fresh()
    service = {
        "id": "s1", "title": "T", "category": "C", "fill_mode": "m", "portal": {"name": "P", "url": "u"},
        "form_fields": [{"key": "a", "label": "A", "high_stakes": True, "compare_to": None}, {"key": "b", "label": "B", "compare_to": "dob"}],
        "field_rules": {"a": {"validators": ["nonempty"]}, "b": {"validators": ["dob"], "optional": True}},
        "required_docs": ["Aadhaar Card"], "optional_docs": ["PAN Card", "Voter ID"], "rejection_reasons": ["r"], "accuracy_weights": {"format_ok": 1.0},
    }
    with open(os.path.join(folder, "services.json"), "w") as out:
        out.write(json.dumps(service))
    tables = readers.load_catalogue(spark, folder)
    assert {n: t.count() for n, t in tables.items()} == {
        "services": 1, "form_fields": 2, "field_rules": 2, "service_docs": 3, "rejection_reasons": 1, "score_weights": 1,
    }
    assert [r["form_key"] for r in tables["form_fields"].orderBy("field_ord").collect()] == ["a", "b"]


def test_pages_are_joined_in_name_order(spark):
    rows = [(1, "b.md", "two"), (1, "a.md", "one"), (1, "c.md", "  "), (2, "a.md", ""), (2, "b.md", None)]
    docs = readers.assemble_ocr_pages(spark.createDataFrame(rows, "doc_id long, page_name string, text string"))
    assert sorted(map(tuple, docs.collect())) == [(1, "one\n\ntwo", None), (2, None, "Digitization returned no readable text")]


def test_materialized_tables_are_read_back(spark):
    table = spark.range(5).select("id", F.array(F.lit("x")).alias("a"))
    kept = writers.materialized(table, "t")
    assert kept.schema.simpleString() == table.schema.simpleString() and kept.count() == 5
    assert "FileScan" in kept._jdf.queryExecution().executedPlan().toString()
