"""Review and output tables: flags, blockers, findings, remediation, audit rows, result packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims, facts
from milaan.functions import text
from milaan.operators.documents import unpivot_fields


def _label(field: Column) -> Column:
    labels = dict(facts.rows(facts.IDENTITY_FIELDS))
    return F.coalesce(F.try_element_at(text.literal_map(labels), field), field)


def flag_board(issues: DataFrame, checks: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Everything an operator must look at: failed rules, doubtful form checks, critical pairs."""
    rules = issues.where(F.col("severity").isin("FAIL", "WARN")).select(
        "case_id", F.lit(0).alias("source"), "severity", F.col("form_key").alias("title"), F.col("message").alias("detail"),
        F.lit(1).cast("long").alias("times"),
    )
    forms = checks.where(F.col("status").isin("CRITICAL", "UNCERTAIN")).select(
        "case_id", F.lit(1).alias("source"), F.col("status").alias("severity"), F.col("label").alias("title"), "detail",
        F.lit(1).cast("long").alias("times"),
    )
    pairs = comparisons.where("status = 'CRITICAL'").select(
        "case_id", F.lit(2).alias("source"), F.col("status").alias("severity"), _label(F.col("field")).alias("title"),
        F.concat(F.col("doc_a"), F.lit(" vs "), F.col("doc_b"), F.lit(": "), F.col("detail")).alias("detail"),
        F.col("n_pairs").alias("times"),
    )
    return rules.unionByName(forms).unionByName(pairs)


def all_blockers(comparisons: DataFrame, checks: DataFrame) -> DataFrame:
    """Critical pairs, and critical form checks recast as pairs with the form."""
    columns = ["case_id", "field", "doc_a", "doc_b", "value_a", "value_b", "detail", "n_pairs"]
    form = checks.where("status = 'CRITICAL'").select(
        "case_id", F.col("label").alias("field"), F.lit("Form").alias("doc_a"),
        F.coalesce("doc_type", F.lit("—")).alias("doc_b"), F.col("form_value").alias("value_a"),
        F.coalesce("doc_value", F.lit("—")).alias("value_b"), "detail", F.lit(1).cast("long").alias("n_pairs"),
    )
    return comparisons.where("status = 'CRITICAL'").select(*columns).unionByName(form)


def review_split(checks: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Form checks in order or at risk, and pairs worth a look, as rows with their bucket."""
    agreed = F.col("status").isin("MATCH", "VARIANT")
    form = checks.select(
        "case_id", F.when(agreed, "form_ok").otherwise("form_risk").alias("bucket"), F.col("form_key").alias("item"),
        "status", F.lit(1).cast("long").alias("times"),
    )
    pairs = comparisons.where(F.col("status").isin("VARIANT", "UNCERTAIN")).select(
        "case_id", F.lit("pair_variant").alias("bucket"),
        F.concat_ws("/", "field", "doc_a", "doc_b").alias("item"), "status", F.col("n_pairs").alias("times"),
    )
    return form.unionByName(pairs)


def findings(comparisons: DataFrame) -> DataFrame:
    """Pairs to report, with the rank that puts CRITICAL before UNCERTAIN before VARIANT."""
    rank = F.when(F.col("status") == "CRITICAL", 0).when(F.col("status") == "UNCERTAIN", 1).when(F.col("status") == "VARIANT", 2)
    return comparisons.withColumn("rank", rank).where("rank IS NOT NULL")


FINDINGS_ORDER = ["case_id", "rank", "ord_a", "ord_b", "field"]


def findings_order(comparisons: DataFrame) -> DataFrame:
    return findings(comparisons).orderBy(*FINDINGS_ORDER)


def remediation_route(forms: DataFrame, primary: DataFrame) -> DataFrame:
    """Where each case goes next: the portal of its primary blocker, or the portal of the service when none."""
    spark = forms.sparkSession
    portals = dims.remediation(spark)
    other = next(r for r in facts.rows(facts.REMEDIATION) if r[0] == "Other")
    blocked = F.col("primary_doc").isNotNull()
    known = portals.select(F.col("doc_type").alias("primary_doc"), "portal", "url", "how")

    def choose(found: str, fallback: str | None, without: Column) -> Column:
        return F.when(blocked, F.coalesce(found, F.lit(fallback or ""))).otherwise(without)

    return (
        forms.select("case_id", "service_id")
        .join(dims.services(spark).select("service_id", "portal_name", "portal_url"), "service_id")
        .join(primary, "case_id", "left")
        .join(known, "primary_doc", "left")
        .select(
            "case_id", "service_id", "primary_doc", F.coalesce("blocker_count", F.lit(0)).cast("long").alias("blocker_count"),
            choose("portal", other[1], F.col("portal_name")).alias("portal_name"),
            choose("url", other[2], F.col("portal_url")).alias("portal_url"),
            choose("how", other[3], F.lit(facts.NO_BLOCKER_HOW)).alias("how"),
        )
    )


def audit_rows(
    forms: DataFrame, docs: DataFrame, summary: DataFrame, primary: DataFrame, checks: DataFrame, comparisons: DataFrame
) -> DataFrame:
    """The audit report as rows: ``section`` and ``place`` give the reading order within a case."""
    counts = forms.select("case_id").join(summary, "case_id", "left")

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("string")

    head = counts.select(
        "case_id", F.lit(1).alias("section"), F.array(F.lit(0)).cast("array<long>").alias("place"),
        F.concat(
            F.lit("Critical blockers: "), n("blockers"), F.lit(" | Uncertain (manual review): "), n("uncertain"),
            F.lit(" | Harmless variants: "), n("variants"),
        ).alias("line"),
    )
    count = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_docs"))
    titles = dims.services(forms.sparkSession).select("service_id", "title")
    opening = forms.select("case_id", "service_id").join(count, "case_id", "left").join(titles, "service_id", "left").select(
        "case_id", F.lit(0).alias("section"), F.array(F.lit(0)).cast("array<long>").alias("place"),
        F.concat(n("n_docs"), F.lit(" documents reconciled"), F.coalesce(F.concat(F.lit(" | Service: "), F.col("title")), F.lit(""))).alias("line"),
    )
    route = remediation_route(forms, primary).where("primary_doc IS NOT NULL")
    fix = route.select(
        "case_id", F.lit(2).alias("section"), F.array(F.lit(0)).cast("array<long>").alias("place"),
        F.concat(
            F.lit("FIX FIRST: "), F.col("primary_doc"), F.lit(" (implicated in "), F.col("blocker_count").cast("string"),
            F.lit(" critical mismatch(es)) Where: "), F.col("portal_name"), F.lit("  "), F.col("portal_url"),
            F.lit(" How: "), F.col("how"),
        ).alias("line"),
    )
    dash = F.lit("—")
    form = checks.select(
        "case_id", F.lit(3).alias("section"), F.array("field_ord").cast("array<long>").alias("place"),
        F.concat(
            F.lit("["), F.col("status"), F.lit("] "), F.col("label"), F.lit(" Form: '"), F.col("form_value"), F.lit("' | "),
            F.coalesce("doc_type", dash), F.lit(": '"), F.coalesce("doc_value", dash), F.lit("' - "), F.col("detail"),
        ).alias("line"),
    )
    headers = docs.select(
        "case_id", F.lit(4).alias("section"), F.array(F.col("doc_ord"), F.lit(0)).cast("array<long>").alias("place"),
        F.concat(F.col("doc_type"), F.lit("  ("), F.coalesce("source_file", F.lit("sample")), F.lit(")")).alias("line"),
    )
    values = unpivot_fields(docs).select(
        "case_id", F.lit(4).alias("section"),
        F.array("doc_ord", F.array_position(F.array(*[F.lit(r[0]) for r in facts.rows(facts.IDENTITY_FIELDS)]), F.col("field")))
        .cast("array<long>").alias("place"),
        F.concat(F.col("doc_type"), F.lit(" "), _label(F.col("field")), F.lit(": "), F.col("value")).alias("line"),
    )
    found = findings(comparisons).select(
        "case_id", F.lit(5).alias("section"), F.array("rank", "ord_a", "ord_b").cast("array<long>").alias("place"),
        F.concat(
            F.lit("["), F.col("status"), F.lit("] "), _label(F.col("field")), F.lit(": "), F.col("doc_a"), F.lit(" vs "),
            F.col("doc_b"), F.lit(" '"), F.col("value_a"), F.lit("' vs '"), F.col("value_b"), F.lit("' - "), F.col("detail"),
        ).alias("line"),
    )
    told = findings(comparisons).select("case_id").distinct()
    clear = forms.select("case_id").join(told, "case_id", "left_anti").select(
        "case_id", F.lit(5).alias("section"), F.array(F.lit(0)).cast("array<long>").alias("place"),
        F.lit("All compared fields match across all documents.").alias("line"),
    )
    out = head
    for part in (opening, fix, form, headers, values, found, clear):
        out = out.unionByName(part)
    printable = F.regexp_replace("line", r"[^\x00-\xFF]", "?")
    return out.withColumn("line", printable)


def matrix_audit_rows(cells: DataFrame) -> DataFrame:
    """Field findings of the matrix report: every cell that is a blocker, a variant or uncertain (ID numbers left out)."""
    labels = dict(facts.rows(facts.MATRIX_FIELDS))
    return cells.where(F.col("status").isin("blocker", "variant", "uncertain") & (F.col("field") != "id_number")).select(
        "case_id", "field", "doc_ord", "status",
        F.concat(
            F.try_element_at(text.literal_map(labels), F.col("field")), F.lit(" — "), F.col("doc_type"), F.lit(": "), F.col("value")
        ).alias("line"),
    )


def result_packs(
    forms: DataFrame, docs: DataFrame, scores: DataFrame, issues: DataFrame, notes: DataFrame | None = None
) -> DataFrame:
    """JSON rows of one shape at every size: a ``head`` per case and a ``document`` row per document beside it.

    The head (service, portal, accuracy, answers, notes, flags) is bounded by the catalogue; ``doc_ord`` orders the documents.
    """
    spark = forms.sparkSession
    flags = (
        issues.where(F.col("severity").isin("FAIL", "WARN"))
        .groupBy("case_id", "service_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("source", "ord", F.col("form_key").alias("field"), "severity", "message"))
            ).alias("flags")
        )
        .withColumn("flags", F.transform("flags", lambda x: x.dropFields("source", "ord")))
    )
    told = forms.select("case_id", "service_id", "answers")
    told = told.join(notes.select("case_id", "notes"), "case_id", "left") if notes is not None else told.withColumn("notes", F.lit(""))
    heads = (
        told.join(dims.services(spark).select("service_id", "portal_name", "portal_url"), "service_id")
        .join(scores.select("case_id", "service_id", "score", "grade"), ["case_id", "service_id"], "left")
        .join(flags, ["case_id", "service_id"], "left")
    )
    head = F.to_json(
        F.struct(
            F.col("service_id").alias("service"), F.struct(F.col("portal_name").alias("name"), F.col("portal_url").alias("url")).alias("portal"),
            F.when(F.col("score").isNotNull(), F.struct("score", "grade")).alias("accuracy"), "answers",
            F.coalesce("notes", F.lit("")).alias("operator_notes"), "flags",
        )
    )
    document = F.to_json(F.struct("doc_type", "source_file", "fields"))
    columns = ["case_id", "service_id", "kind", "doc_ord", "pack"]
    top = heads.select("case_id", "service_id", F.lit("head").alias("kind"), F.lit(None).cast("int").alias("doc_ord"), head.alias("pack"))
    listed = docs.join(forms.select("case_id", "service_id"), "case_id").withColumns({"kind": F.lit("document"), "pack": document})
    return top.select(*columns).unionByName(listed.select("case_id", "service_id", "kind", F.col("doc_ord").cast("int").alias("doc_ord"), "pack"))
