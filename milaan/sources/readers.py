"""Reading extraction records, form answers, catalogues, case rows and scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milaan import schema
from milaan.functions import text
from milaan.operators.documents import drop_form_docs

EXTRACTIONS = T.ArrayType(schema.EXTRACTION)


def explode_extractions(cases: DataFrame, column: str = "extractions") -> DataFrame:
    """Document rows from a JSON array column; the array order is the document order.  Forms are dropped."""
    parsed = cases.select("case_id", F.posexplode(F.from_json(column, EXTRACTIONS)).alias("doc_ord", "d"))
    return drop_form_docs(parsed.select("case_id", "doc_ord", "d.*"))


def load_extractions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"case_id": ..., "extractions": [...]}``."""
    lines = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("extractions", EXTRACTIONS)])
    rows = spark.read.schema(lines).json(path)
    return drop_form_docs(rows.select("case_id", F.posexplode("extractions").alias("doc_ord", "d")).select("case_id", "doc_ord", "d.*"))


def load_extraction_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file, one file per case; the file name (without ending) is the case id."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    cases = files.select(F.regexp_replace("file", r"\.json$", "").alias("case_id"), F.col("value").alias("extractions"))
    return explode_extractions(cases)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"case_id": ..., "service_id": ..., "answers": {...}}``; values become text, nulls go."""
    lines = T.StructType(
        [
            T.StructField("case_id", T.LongType()),
            T.StructField("service_id", T.StringType()),
            T.StructField("answers", schema.STRINGS),
        ]
    )
    return _without_nulls(spark.read.schema(lines).json(path))


def answers_from_json(rows: DataFrame, column: str = "answers") -> DataFrame:
    """Parse a JSON object column of answers."""
    return _without_nulls(rows.withColumn(column, F.from_json(column, schema.STRINGS)), column)


def _without_nulls(rows: DataFrame, column: str = "answers") -> DataFrame:
    return rows.withColumn(column, F.map_filter(column, lambda _, v: v.isNotNull()))


def load_answer_files(spark: SparkSession, path: str, service_id: str) -> DataFrame:
    """One flat JSON object per file; the file name (without ending) is the case id."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = files.select(
        F.regexp_replace("file", r"\.json$", "").alias("case_id"), F.lit(service_id).alias("service_id"),
        F.col("value").alias("answers"),
    )
    return answers_from_json(rows)


def load_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A nested service catalogue (JSON lines, one service each) as flat dimension tables.

    Every service may hold ``form_fields``, ``field_rules``, ``required_docs``, ``optional_docs``, ``rejection_reasons``
    and ``accuracy_weights``; the result has one table per part.
    """
    field = "struct<key:string,label:string,compare_to:string,compare_doc:string,high_stakes:boolean,prompt_hi:string,prompt_en:string>"
    rule = "struct<validators:array<string>,optional:boolean,must_match_doc:string>"
    ddl = (
        "id string, title string, category string, fill_mode string, portal struct<name:string,url:string>, "
        f"form_fields array<{field}>, field_rules map<string,{rule}>, required_docs array<string>, "
        "optional_docs array<string>, rejection_reasons array<string>, accuracy_weights map<string,double>"
    )
    raw = spark.read.schema(ddl).json(path).withColumnRenamed("id", "service_id")

    def listed(column: str, name: str) -> DataFrame:
        return raw.select("service_id", F.posexplode(column).alias("ord", name))

    fields = listed("form_fields", "f").select("service_id", F.col("ord").alias("field_ord"), "f.*")
    rules = raw.select("service_id", F.explode("field_rules").alias("form_key", "r")).select(
        "service_id", "form_key", F.col("r.validators").alias("validators"),
        F.coalesce("r.optional", F.lit(False)).alias("optional"), "r.must_match_doc",
    )
    docs = listed("required_docs", "doc_type").withColumn("kind", F.lit("required")).unionByName(
        listed("optional_docs", "doc_type").withColumn("kind", F.lit("optional"))
    )
    return {
        "services": raw.select("service_id", "title", "category", "fill_mode", "portal.name", "portal.url"),
        "form_fields": fields.withColumnRenamed("key", "form_key"),
        "field_rules": rules,
        "service_docs": docs,
        "rejection_reasons": listed("rejection_reasons", "reason"),
        "score_weights": raw.select("service_id", F.explode("accuracy_weights").alias("part", "weight")),
    }


def load_cases(rows: DataFrame) -> DataFrame:
    """Stored case rows with JSON text columns decoded, 0/1 flags as booleans, epoch seconds as timestamps."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) != 0

    return rows.select(
        F.col("id").alias("case_id"), "user_id", "service_id", "citizen_label", "step",
        F.from_json(F.coalesce(F.nullif("answers", F.lit("")), F.lit("{}")), schema.STRINGS).alias("answers"),
        F.from_json(F.coalesce(F.nullif("extractions", F.lit("")), F.lit("[]")), EXTRACTIONS).alias("extractions"),
        F.try_parse_json(F.nullif("verify_result", F.lit(""))).alias("verify_result"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        flag("form_reviewed").alias("form_reviewed"), flag("ocr_reviewed").alias("ocr_reviewed"), "status",
        F.timestamp_micros((F.col("created_at") * 1000000).cast("long")).alias("created_at"),
        F.timestamp_micros((F.col("updated_at") * 1000000).cast("long")).alias("updated_at"),
    )


def assemble_ocr_pages(pages: DataFrame) -> DataFrame:
    """doc_id with ocr_text, or with an error when no page is readable, from pages (doc_id, page_name, text).

    Pages are joined in page-name order with a blank line between; blank pages are left out.
    """
    # A value no page text can sort before keeps empty documents in the result of the aggregation.
    filled = F.when(text.strip(F.coalesce("text", F.lit(""))) != "", F.struct("page_name", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda p: p["text"]), "\n\n")
    docs = pages.groupBy("doc_id").agg(F.nullif(joined, F.lit("")).alias("ocr_text"))
    return docs.withColumn("error", F.when(F.col("ocr_text").isNull(), F.lit("Digitization returned no readable text")))


_TEXT_PROPERTY = r'"(?:text|content|markdown|value)"\s*:\s*"((?:[^"\\]|\\.)*)"'


def ocr_json_to_text(json: Column) -> Column:
    """Every string under text, content, markdown or value at any depth, in document order, one per line."""
    found = F.regexp_extract_all(json, F.lit(_TEXT_PROPERTY), 1)
    as_list = F.concat(F.lit('["'), F.array_join(found, '","'), F.lit('"]'))
    return F.when(F.size(found) == 0, F.lit("")).otherwise(F.array_join(F.from_json(as_list, "array<string>"), "\n"))


def with_outcome(scans: DataFrame) -> DataFrame:
    """Add ``outcome`` (good or failed) and ``error``: a scan without text fails, the others go on."""
    blank = text.strip(F.coalesce("ocr_text", F.lit(""))) == ""
    error = F.concat(F.lit("Could not digitize "), F.col("source_file"), F.lit(" as "), F.col("doc_type"))
    return scans.withColumns({"outcome": F.when(blank, F.lit("failed")).otherwise(F.lit("good")), "error": F.when(blank, error)})


def split_failures(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans that can be processed, quarantine rows).  One frame with both is ``with_outcome``."""
    marked = with_outcome(scans)
    failed = marked.where("outcome = 'failed'").select("case_id", F.col("source_file").alias("file"), "doc_type", "error")
    return marked.where("outcome = 'good'").drop("outcome", "error"), failed
