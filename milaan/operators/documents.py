"""Document tables: long form, filters, type guesses, upload dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import facts
from milaan.functions import text

FIELD_ORDER = [r[0] for r in facts.rows(facts.IDENTITY_FIELDS)]


def field_ord(field: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in FIELD_ORDER]), field).cast("int") - 1


def doc_priority(doc_type: Column) -> Column:
    return F.coalesce(F.try_element_at(text.literal_map(facts.DOC_PRIORITY), doc_type), F.lit(facts.OTHER_PRIORITY))


def drop_form_docs(docs: DataFrame) -> DataFrame:
    """Keep identity documents; scanned application forms are not proof of anything."""
    return docs.where(~F.coalesce(F.col("doc_type"), F.lit("")).isin(*facts.FORM_DOC_TYPES))


def unpivot_fields(docs: DataFrame, fields: list[str] | None = None, absent: str = text.UNCERTAIN) -> DataFrame:
    """One row per (document, identity field); a field the record lacks reads ``absent``."""
    names = F.array(*[F.lit(f) for f in (fields or FIELD_ORDER)])
    return docs.select("case_id", "doc_ord", "doc_type", F.explode(names).alias("field"), "fields").select(
        "case_id", "doc_ord", "doc_type", "field", F.coalesce(F.try_element_at("fields", F.col("field")), F.lit(absent)).alias("value")
    )


def readable_only(long_docs: DataFrame) -> DataFrame:
    return long_docs.where(text.readable(F.col("value")))


def guess_doc_type(files: DataFrame, preferred: Column, with_forms: bool = True) -> DataFrame:
    """Add ``doc_type``: the first keyword rule the file name meets, else the first preferred document, else Other.

    ``with_forms`` keeps the last rule, which spots scanned application forms.
    """
    rules = [(facts.items(keys), doc) for keys, doc in facts.rows(facts.FILE_NAME_RULES)]
    name = F.replace(F.lower(F.col("file_name")), F.lit(" "), F.lit(""))
    guess = F.coalesce(F.get(preferred, 0), F.lit("Other"))
    for keys, doc in reversed(rules if with_forms else rules[:-1]):
        guess = F.when(text.any_of([F.contains(name, F.lit(k)) for k in keys]), F.lit(doc)).otherwise(guess)
    return files.withColumn("doc_type", guess)


def dedupe_uploads(uploads: DataFrame) -> DataFrame:
    """Drop repeats of the same (name, size) within a case.

    On a stream, give ``uploads`` a watermark and include its event-time column bound; see ``streaming.jobs``.
    """
    return uploads.dropDuplicates(["case_id", "file_name", "size"])


def readable_of_five(docs: DataFrame) -> DataFrame:
    """Readable identity fields per document (only blank and UNCERTAIN count as unreadable here)."""
    return docs.select("case_id", "doc_ord", "doc_type", _count_fields(docs, _present).alias("readable"))


def uncertain_count(docs: DataFrame) -> DataFrame:
    """Unreadable cells of the five fields over all documents of a case."""
    per_doc = docs.select("case_id", (F.lit(len(FIELD_ORDER)) - _count_fields(docs, _present_trimmed)).alias("n"))
    return per_doc.groupBy("case_id").agg(F.sum("n").cast("long").alias("uncertain"))


def _present(v: Column) -> Column:
    return ~F.upper(F.coalesce(v, F.lit(""))).isin("", text.UNCERTAIN)


def _present_trimmed(v: Column) -> Column:
    return F.coalesce((v != "") & (F.upper(text.strip(v)) != text.UNCERTAIN), F.lit(False))


def _count_fields(docs: DataFrame, test) -> Column:
    return sum((test(docs["fields"][f]).cast("int") for f in FIELD_ORDER), F.lit(0))


def side_by_side_rows(docs: DataFrame) -> DataFrame:
    """One row per case, field and document type: the value of the first document of that type.  Any type has rows."""
    return unpivot_fields(docs).groupBy("case_id", "field", "doc_type").agg(F.min_by("value", "doc_ord").alias("value"))


def side_by_side(docs: DataFrame, doc_types: list[str] | None = None) -> DataFrame:
    """Fields as rows, document types as columns; types without a column stand together in ``Other`` as ``type: value``."""
    types = doc_types or [r[0] for r in facts.rows(facts.DOC_TYPES)]
    named = F.coalesce(F.col("doc_type").isin(*types), F.lit(False))
    shown = F.when(named, F.col("value")).otherwise(F.concat_ws(": ", "doc_type", "value"))
    slot = F.when(named, F.col("doc_type")).otherwise("Other").alias("slot")
    cells = side_by_side_rows(docs).select("case_id", "field", slot, shown.alias("shown")).groupBy("case_id", "field", "slot").agg(
        F.array_join(F.sort_array(F.collect_list("shown")), "; ").alias("shown")
    )
    return cells.groupBy("case_id", "field").pivot("slot", [*types, "Other"]).agg(F.min("shown"))
