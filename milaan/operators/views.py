"""The desk view and the matrix view: the same questions with rules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims, facts
from milaan.functions import compare, text
from milaan.operators.documents import unpivot_fields
from milaan.operators.forms import form_rows
from milaan.operators.pairs import value_groups, within_case_pairs
from milaan.operators.scoring import STATUS_SCORE, grade, missing_required_docs, whole_percent

DESK_FIELDS = ["full_name", "father_name", "dob", "address"]
MATRIX_FIELDS = [r[0] for r in facts.rows(facts.MATRIX_FIELDS)]
SPREAD = 1024


# --- desk view ---------------------------------------------------------------------------------------------------------


def cross_doc_pairs_desk(docs: DataFrame) -> DataFrame:
    """All value pairs of four fields; unreadable ones stay, as UNCERTAIN."""
    long_docs = unpivot_fields(docs, DESK_FIELDS)
    shown = long_docs.withColumn("value", F.when(F.col("value") == "", text.UNCERTAIN).otherwise(F.col("value")))
    pairs = within_case_pairs(value_groups(shown))
    status = compare.desk_view_status(F.col("field"), F.col("value_a"), F.col("value_b"))
    return pairs.withColumn("status", status)


def blocker_counts_desk(pairs: DataFrame) -> DataFrame:
    """Critical pairs charged to the side that is not the Aadhaar card, else to the later document."""
    a, b = F.col("doc_a"), F.col("doc_b")
    charged = F.when(F.contains(a, F.lit("Aadhaar")), b).when(F.contains(b, F.lit("Aadhaar")), a).otherwise(b)
    return (
        pairs.where("status = 'CRITICAL'")
        .groupBy("case_id", charged.alias("doc_type"))
        .agg(F.sum("n_pairs").cast("long").alias("blockers"))
    )


def form_checks_desk(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Per compared form field the best document verdict in visiting order (preferred document first).

    Of several documents of the preferred type only the last one is visited.  The visit stops at the first agreement; without
    one the best rank seen first wins.  Unreadable values are passed over unless they belong to the only document visited.
    """
    rank = {"MATCH": 4, "VARIANT": 3, "UNCERTAIN": 2, "CRITICAL": 1}
    compared = form_rows(forms).where("compare_to IS NOT NULL")
    long_docs = unpivot_fields(docs, absent="").withColumnRenamed("field", "compare_to")
    groups = long_docs.groupBy("case_id", "compare_to", "doc_type", "value").agg(
        F.min("doc_ord").alias("first_ord"), F.max("doc_ord").alias("last_ord")
    )
    count = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("case_docs"))
    same_type = docs.groupBy("case_id", F.col("doc_type").alias("compare_doc")).agg(
        F.count(F.lit(1)).alias("preferred_docs"), F.max("doc_ord").alias("preferred_last")
    )
    met = compared.join(same_type, ["case_id", "compare_doc"], "left").join(groups, ["case_id", "compare_to"]).join(count, "case_id")
    status = compare.desk_view_status(F.col("compare_to"), F.col("form_value"), F.col("value"))
    visited = F.col("case_docs") - F.coalesce(F.col("preferred_docs") - 1, F.lit(0))
    considered = ~compare.desk_view_missing(F.col("value")) | (visited == 1)
    preferred = F.coalesce(F.col("compare_doc") == F.col("doc_type"), F.lit(False))
    met = met.where(~preferred | (F.col("last_ord") == F.col("preferred_last")))
    visit = F.struct(F.when(preferred, 0).otherwise(1).alias("late"), F.col("first_ord").alias("ord"))
    agrees = F.col("status").isin("MATCH", "VARIANT")
    score = F.lit(0)
    for name, value in rank.items():
        score = F.when(F.col("status") == name, F.lit(-value)).otherwise(score)
    key = F.struct(F.when(agrees, 0).otherwise(1), F.when(agrees, 0).otherwise(score), visit, "doc_type", "value", "status")
    return (
        met.withColumn("status", F.when(considered, status))
        .unionByName(compared, allowMissingColumns=True)
        .groupBy("case_id", "service_id", "form_key", "field_ord", "label", "high_stakes", "form_value")
        .agg(F.min(F.when(F.col("status").isNotNull(), key)).alias("b"))
        .select(
            "case_id", "service_id", "form_key", "field_ord", "label", "high_stakes", "form_value",
            F.col("b.doc_type").alias("doc_type"), F.nullif("b.value", F.lit("")).alias("doc_value"),
            F.coalesce("b.status", F.lit("UNCERTAIN")).alias("status"),
        )
    )


def case_scores_desk(forms: DataFrame, docs: DataFrame, checks: DataFrame) -> DataFrame:
    """The desk view's score: match counts twice, completeness is over all form fields."""
    status = F.lit(0.5)
    for name, value in STATUS_SCORE.items():
        status = F.when(F.col("status") == name, F.lit(value)).otherwise(status)
    matched = checks.groupBy("case_id", "service_id").agg(
        F.avg(status).alias("match"), F.bool_or(F.col("status") == "CRITICAL").alias("conflict"),
        F.bool_or(F.col("status") == "UNCERTAIN").alias("unsure"),
    )
    filled = form_rows(forms).groupBy("case_id", "service_id").agg(
        (F.count_if(F.col("form_value") != "") / F.count(F.lit(1))).alias("complete")
    )
    missing = missing_required_docs(forms, docs).groupBy("case_id", "service_id").agg(F.count(F.lit(1)).alias("lacking"))
    needed = dims.required_docs(forms.sparkSession).select("service_id", F.size("required").alias("needed"))
    lacking = F.coalesce("lacking", F.lit(0))
    m = F.coalesce("match", F.lit(0.5))
    share = 0.35 * m + 0.2 * (1 - lacking / F.col("needed")) + 0.35 * m + 0.1 * F.col("complete")
    return (
        filled.join(needed, "service_id")
        .join(matched, ["case_id", "service_id"], "left")
        .join(missing, ["case_id", "service_id"], "left")
        .withColumn("score", whole_percent(F.bround(share, 9)))
        .withColumn(
            "grade",
            grade(
                F.col("score"), F.coalesce("conflict", F.lit(False)) | (lacking > 0), F.coalesce("unsure", F.lit(False))
            ),
        )
        .select("case_id", "service_id", "score", "grade", (F.col("grade") == "READY").alias("graded_ready"))
    )


# --- matrix view -------------------------------------------------------------------------------------------------------


def _present_cells(docs: DataFrame) -> DataFrame:
    """One row per (document, matrix field) the record has; ``unsure`` marks a value the reader could not make out."""
    names = F.array(*[F.lit(f) for f in MATRIX_FIELDS])
    rows = docs.select("case_id", "doc_ord", "doc_type", F.explode(names).alias("field"), "fields")
    value = F.try_element_at("fields", F.col("field"))
    unsure = F.upper(text.strip(value)) == text.UNCERTAIN
    return rows.select("case_id", "doc_ord", "doc_type", "field", value.alias("value"), unsure.alias("unsure"))


def reference_doc(docs: DataFrame) -> DataFrame:
    """Per case and field the reference value: the Aadhaar card when readable, else the first readable, else the first."""
    tier = (
        F.when((F.col("doc_type") == "Aadhaar Card") & ~F.col("unsure"), 0).when(~F.col("unsure"), 1).otherwise(2)
    )
    best = F.min(F.struct(tier.alias("tier"), "doc_ord", "doc_type", "value", "unsure"))
    cells = _present_cells(docs).where("value IS NOT NULL")
    return (
        cells.groupBy("case_id", "field")
        .agg(best.alias("b"), F.max("doc_ord").alias("last_ord"))
        .select(
            "case_id", "field", F.col("b.doc_ord").alias("ref_ord"), F.col("b.doc_type").alias("ref_doc"),
            F.col("b.value").alias("ref_value"), F.col("b.unsure").alias("ref_unsure"), "last_ord",
        )
    )


def matrix_cells(docs: DataFrame) -> DataFrame:
    """Every document against the reference of its case, field by field.

    The reference row is replicated to the position blocks of its case, so a giant case is joined by many tasks.
    """
    cells = _present_cells(docs).withColumn("block", F.expr(f"doc_ord div {SPREAD}"))
    # A field nobody has makes no row; a document after the last one that has it still gets its ``missing`` cell.
    last = docs.groupBy("case_id").agg(F.max("doc_ord").alias("case_last"))
    refs = reference_doc(docs).join(last, "case_id").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"case_last div {SPREAD}")))
    )
    is_reference = F.col("doc_ord") == F.col("ref_ord")
    status = (
        F.when(F.col("value").isNull(), "missing")
        .when(is_reference, F.when(F.col("unsure"), "uncertain").otherwise("match"))
        .otherwise(
            compare.matrix_status(
                F.col("field"), F.col("ref_value"), F.col("value"), F.col("unsure") | F.col("ref_unsure")
            )
        )
    )
    return cells.join(refs, ["case_id", "field", "block"]).select(
        "case_id", "field", "doc_ord", "doc_type", F.coalesce("value", F.lit("—")).alias("value"), status.alias("status")
    )


def matrix_blockers(cells: DataFrame) -> DataFrame:
    """Blocker cells per document."""
    return (
        cells.where("status = 'blocker'")
        .groupBy("case_id", "doc_ord", "doc_type")
        .agg(F.count(F.lit(1)).alias("blockers"), F.min(_matrix_ord(F.col("field"))).alias("first_field"))
    )


def _matrix_ord(field: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in MATRIX_FIELDS]), field)


def matrix_summary(cells: DataFrame) -> DataFrame:
    names = {"matches": "match", "variants": "variant", "blockers": "blocker", "uncertain": "uncertain"}
    return cells.groupBy("case_id").agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()])


def primary_blocker_matrix(cells: DataFrame) -> DataFrame:
    """The first PAN card when it has a blocker; else the document with most blockers (first charged on a tie); else the
    first document of the case."""
    blocked = F.count_if(F.col("status") == "blocker")
    first = F.min(F.when(F.col("status") == "blocker", _matrix_ord(F.col("field"))))
    per_doc = cells.groupBy("case_id", "doc_ord", "doc_type").agg(blocked.alias("n"), first.alias("first_field"))
    first_pan = F.min_by(F.struct("doc_ord", "doc_type", "n"), F.when(F.col("doc_type") == "PAN Card", F.col("doc_ord")))
    most = F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), "first_field", "doc_ord", "doc_type", "n")))
    opening = F.min(F.struct("doc_ord", "doc_type", "n"))
    picked = F.when(F.col("pan.n") > 0, F.col("pan")).otherwise(
        F.coalesce(F.when(F.col("most").isNotNull(), F.struct("most.doc_ord", "most.doc_type", "most.n")), F.col("opening"))
    )
    return (
        per_doc.groupBy("case_id")
        .agg(first_pan.alias("pan"), most.alias("most"), opening.alias("opening"))
        .select("case_id", picked.alias("p"))
        .select("case_id", F.col("p.doc_ord").alias("doc_ord"), F.col("p.doc_type").alias("doc_type"), F.col("p.n").alias("blockers"))
    )
