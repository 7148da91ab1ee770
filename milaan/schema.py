"""Explicit schemas of the source tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())

# One extraction record: what was read from one document of a case.
EXTRACTION = T.StructType(
    [
        T.StructField("doc_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("handwritten", T.BooleanType()),
        T.StructField("ocr_text", T.StringType()),
        T.StructField("fields", STRINGS),
    ]
)

# A stored case; the three JSON columns are text in the store.
CASE_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("service_id", T.StringType()),
        T.StructField("citizen_label", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("answers", T.StringType()),
        T.StructField("extractions", T.StringType()),
        T.StructField("verify_result", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("form_reviewed", T.IntegerType()),
        T.StructField("ocr_reviewed", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("updated_at", T.DoubleType()),
    ]
)
