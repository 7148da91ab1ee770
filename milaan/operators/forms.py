"""Form answers: service filter, rule evaluation, and checks of each answer against the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims, facts
from milaan.functions import compare, text, validators
from milaan.operators.documents import doc_priority, unpivot_fields
from milaan.operators.pairs import judged, standardized, value_groups

BLANK_FORM_VALUE = "—"


def answer_fields(forms: DataFrame) -> DataFrame:
    """Long form of the answers: one row per (case, service, key)."""
    return forms.select("case_id", "service_id", F.explode("answers").alias("form_key", "value"))


def service_answers_only(forms: DataFrame) -> DataFrame:
    """Answer rows whose key belongs to the form of the service."""
    keys = dims.form_fields(forms.sparkSession).select("service_id", "form_key")
    return answer_fields(forms).join(keys, ["service_id", "form_key"], "left_semi")


KEY = ["case_id", "service_id", "form_key"]


def service_lookup(forms: DataFrame) -> DataFrame:
    """The forms with the service columns and an ``outcome``: known, or rejected with those columns null.  One scan, one join."""
    services = dims.services(forms.sparkSession).withColumn("outcome", F.lit("known"))
    return forms.join(services, "service_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("rejected")))


def form_rows(forms: DataFrame) -> DataFrame:
    """One row per form field of the service, answered or not; the answer is trimmed, blank when absent."""
    return forms.join(dims.form_fields(forms.sparkSession), "service_id").select(
        "case_id", "service_id", "form_key", "field_ord", "label", "compare_to", "compare_doc", "high_stakes",
        text.strip(F.coalesce(F.try_element_at("answers", F.col("form_key")), F.lit(""))).alias("form_value"),
    )


def answers_with_rules(forms: DataFrame) -> DataFrame:
    """One row per rule of the service, answered or not."""
    return forms.join(dims.field_rules(forms.sparkSession), "service_id").select(
        "case_id", "service_id", "form_key", "rule_ord", "validator", "optional",
        text.strip(F.coalesce(F.try_element_at("answers", F.col("form_key")), F.lit(""))).alias("value"),
    )


def validate_answers(forms: DataFrame, today: Column) -> DataFrame:
    """Outcome of every rule: required, skipped (optional and blank), or the format check of the answer."""
    date = F.when(F.col("validator") == "dob", text.day_first_date(F.col("value")))
    rules = answers_with_rules(forms).withColumns({"date": date, "today": today})
    blank = F.col("value") == ""
    check = F.when(~blank, validators.rule_check())
    outcome = (
        F.when(blank & F.col("optional"), "skipped")
        .when(blank, "missing")
        .when(F.col("validator").isNull(), "unchecked")
        .when(F.col("ok"), "ok")
        .otherwise("fail")
    )
    told = F.when(blank & ~F.col("optional"), "Required field is empty").otherwise(F.col("message"))
    # The check comes out of a generator, so later filters on the outcome do not evaluate it a second time.
    checked = rules.select("*", F.inline(F.array(check)))
    return checked.withColumns({"outcome": outcome, "message": told}).drop("ok", "date", "today")


def validator_scorecard(validated: DataFrame) -> DataFrame:
    ran = validated.where(F.col("outcome").isin("ok", "fail"))
    passed = F.count_if(F.col("outcome") == "ok")
    return ran.groupBy("service_id", "form_key", "validator").agg(
        passed.alias("passed"),
        F.count_if(F.col("outcome") == "fail").alias("failed"),
        (passed / F.count(F.lit(1))).alias("pass_rate"),
    )


# --- answers against documents -------------------------------------------------------------------------------------------


def _compared_rows(forms: DataFrame) -> DataFrame:
    return form_rows(forms).where("compare_to IS NOT NULL")


def _candidates(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Every compared form field with every value group of its document field; unreadable values come as NULL.

    An inner join, so that either side of a hot case can be split; :func:`best_form_checks` brings the fields without
    documents back by a union.
    """
    form_std = F.when(text.readable(F.col("form_value")), text.standard_form_of("compare_to", "form_value"))
    nulled = unpivot_fields(docs).withColumn("value", F.when(text.readable(F.col("value")), F.col("value")))
    groups = value_groups(standardized(nulled)).withColumnRenamed("field", "compare_to")
    return _compared_rows(forms).withColumn("form_std", form_std).join(groups, ["case_id", "compare_to"])


def _preference(name: str = "doc_type") -> list[Column]:
    """Sort key of the documents of one form field: the preferred one, then by priority, then by position."""
    chosen = F.coalesce(F.col("compare_doc") == F.col(name), F.lit(False))
    return [
        F.when(chosen, 0).otherwise(1).alias("other"),
        doc_priority(F.col(name)).alias("priority"),
        F.col("first_ord").alias("ord"),
    ]


def _judged_candidates(forms: DataFrame, docs: DataFrame) -> DataFrame:
    rows = _candidates(forms, docs)
    pair = judged(
        rows.withColumns(
            {
                "field": F.col("compare_to"),
                "value_a": F.col("form_value"),
                "value_b": F.col("value"),
                "std_a": F.col("form_std"),
                "std_b": F.col("std"),
            }
        )
    )
    empty = ~text.readable(F.col("form_value"))
    has_value = F.col("value").isNotNull()
    return pair.withColumns(
        {
            "detail": F.when(has_value, F.when(empty, "Form field is empty — citizen must answer").otherwise(F.col("detail"))),
            "status": F.when(has_value, F.col("status")),
        }
    ).drop("field", "value_a", "value_b", "std_a", "std_b", "std", "form_std")


def form_vs_docs(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """All readable document values each compared answer meets, with their verdict."""
    return _judged_candidates(forms, docs).where("value IS NOT NULL").select(
        "case_id", "service_id", "form_key", "label", "high_stakes", _shown_form_value().alias("form_value"),
        "doc_type", F.col("value").alias("doc_value"), "status", "detail", "n_docs", "first_ord",
    )


def _shown_form_value() -> Column:
    return F.when(F.col("form_value") == "", BLANK_FORM_VALUE).otherwise(F.col("form_value"))


def best_form_checks(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """One verdict per compared form field, with the document it rests on and the full detail text.

    Tiers: agreement with the preferred document, any agreement, a conflict, the rest.  Within a tier the document
    priority decides, then position.  The pick is a ``min`` over a struct, so it combines map-side; the ignored documents
    are collected per document type, which bounds the list.
    """
    agrees = F.col("status").isin("MATCH", "VARIANT")
    preferred = F.coalesce(F.col("compare_doc") == F.col("doc_type"), F.lit(False))
    tier = F.when(agrees & preferred, 0).when(agrees, 1).when(F.col("status") == "CRITICAL", 2).otherwise(3)
    order = _preference()
    key = F.struct(
        tier.alias("tier"), F.when(tier == 3, order[0]).otherwise(0).alias("late"), order[1], order[0], order[2],
        F.col("doc_type"), F.col("value").alias("doc_value"), F.col("status"), F.col("detail"),
    )
    # A document type may be unreadable in several documents: one entry per type, repeated when it is written out.
    ignored = F.struct(*order, F.col("doc_type"), F.col("n_docs"))
    keys = ["case_id", "service_id", "form_key", "field_ord", "label", "compare_to", "high_stakes", "form_value"]
    unread = F.col("value").isNull() & F.col("doc_type").isNotNull()
    met = _judged_candidates(forms, docs).unionByName(_compared_rows(forms), allowMissingColumns=True)
    grouped = met.groupBy(*keys).agg(
        F.min(F.when(F.col("value").isNotNull(), key)).alias("best"),
        F.sort_array(F.collect_list(F.when(unread, ignored))).alias("ignored"),
    )
    names = F.array_join(
        F.flatten(F.transform("ignored", lambda x: F.array_repeat(x["doc_type"], x["n_docs"].cast("int")))), ", "
    )
    skip_note = F.when(
        F.size("ignored") > 0,
        F.concat(F.lit(" Ignored "), names, F.lit(" (no readable "), F.col("compare_to"), F.lit(" on those docs).")),
    ).otherwise("")
    doc, told = F.col("best.doc_type"), F.col("best.detail")
    usual = {field: ", ".join(facts.items(docs_)) for field, docs_ in facts.rows(facts.USUALLY_ON)}
    hint = F.concat(
        F.lit("None of the uploaded documents have a readable '"), F.col("compare_to"),
        F.lit("'. Skipped (field absent): "), F.when(F.size("ignored") > 0, names).otherwise("—"), F.lit(". "),
        F.coalesce(
            F.concat(F.lit("Usually found on: "), F.try_element_at(text.literal_map(usual), F.col("compare_to")), F.lit(".")),
            F.lit(""),
        ),
    )
    detail = (
        F.when(F.col("best").isNull(), hint)
        .when(
            F.col("best.status").isin("MATCH", "VARIANT"),
            F.concat(F.lit("Checked against "), doc, F.lit(" as source of truth. "), told, skip_note),
        )
        .when(
            F.col("best.status") == "CRITICAL",
            F.concat(F.lit("Mismatch vs "), doc, F.lit(" (preferred readable source). "), told, skip_note),
        )
        .otherwise(told)
    )
    return grouped.select(
        "case_id", "service_id", "form_key", "field_ord", "label", "compare_to", "high_stakes",
        _shown_form_value().alias("form_value"), doc.alias("doc_type"), F.col("best.doc_value").alias("doc_value"),
        F.coalesce("best.status", F.lit("UNCERTAIN")).alias("status"), detail.alias("detail"),
    )


def unmatched_form_fields(checks: DataFrame) -> DataFrame:
    """Compared form fields no document could confirm or deny."""
    return checks.where("doc_type IS NULL")


def other_sources(forms: DataFrame, docs: DataFrame, checks: DataFrame) -> DataFrame:
    """For each checked form field, the readable values on document types other than the chosen one (rows)."""
    chosen = checks.where("doc_type IS NOT NULL").select("case_id", "service_id", "form_key", F.col("doc_type").alias("chosen"))
    rows = form_vs_docs(forms, docs).join(chosen, ["case_id", "service_id", "form_key"])
    return rows.where("doc_type <> chosen").select(
        "case_id", "service_id", "form_key", F.concat_ws(": ", "doc_type", "doc_value").alias("source"), "n_docs", "first_ord"
    )


def carry_forward(forms: DataFrame) -> DataFrame:
    """Answers no document could be compared with go straight through."""
    return form_rows(forms).where("compare_to IS NULL AND form_value <> ''").select(
        "case_id", "service_id", "form_key", "field_ord", F.col("form_value").alias("value")
    )


def approved_values(forms: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows of approved answers: carried forward, or in agreement with a document."""
    agreed = checks.where(F.col("status").isin("MATCH", "VARIANT") & (F.col("form_value") != BLANK_FORM_VALUE))
    return carry_forward(forms).unionByName(
        agreed.select("case_id", "service_id", "form_key", "field_ord", F.col("form_value").alias("value"))
    )


def approved_fields(forms: DataFrame, checks: DataFrame) -> DataFrame:
    """One map of approved answers per case (its size is bounded by the form)."""
    entry = F.struct("field_ord", "form_key", "value")
    listed = F.array_sort(F.collect_list(entry))
    pairs = F.transform(listed, lambda e: F.struct(e["form_key"], e["value"]))
    return approved_values(forms, checks).groupBy("case_id", "service_id").agg(F.map_from_entries(pairs).alias("approved"))


def form_complete(forms: DataFrame) -> DataFrame:
    """All high-stakes fields filled (all fields when the form has none)."""
    filled = F.col("form_value") != ""
    stakes = F.col("high_stakes")
    return form_rows(forms).groupBy("case_id", "service_id").agg(
        F.when(F.bool_or(stakes), F.bool_and(filled | ~stakes)).otherwise(F.bool_and(filled)).alias("complete")
    )


def next_empty_field(forms: DataFrame) -> DataFrame:
    """The first empty high-stakes field in form order, NULL when all are filled."""
    open_field = F.when((F.col("form_value") == "") & F.col("high_stakes"), F.struct("field_ord", "form_key"))
    return form_rows(forms).groupBy("case_id", "service_id").agg(F.min(open_field)["form_key"].alias("next_field"))


def best_readable_values(docs: DataFrame, prefer: dict[str, str] | None = None) -> DataFrame:
    """Per case and field: the readable value of the document with the best priority (``prefer``: field -> document)."""
    rows = unpivot_fields(docs).where(text.readable(F.col("value")))
    rank = doc_priority(F.col("doc_type"))
    for field, doc in (prefer or {}).items():
        rank = F.when((F.col("field") == field) & (F.col("doc_type") == doc), -1).otherwise(rank)
    best = F.min(F.struct(rank.alias("rank"), "doc_ord", "doc_type", "value"))
    return (
        rows.groupBy("case_id", "field")
        .agg(best.alias("b"))
        .select("case_id", "field", F.col("b.doc_type").alias("doc_type"), text.strip(F.col("b.value")).alias("value"))
    )


def prefill_form(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Fill each compared field from its best document: preferred first, then priority; other answers stay.

    A document offers the compared field, or a field named like the form key when it has none of the former.
    """
    compared = form_rows(forms).where("compare_to IS NOT NULL")
    keys = sorted({r[3] for r in facts.rows(facts.FORM_FIELDS) if r[3]} | {r[1] for r in facts.rows(facts.FORM_FIELDS) if r[3]})
    offers = docs.select(
        "case_id", "doc_ord", "doc_type",
        F.explode(F.map_filter("fields", lambda k, v: k.isin(*keys) & (v != ""))).alias("offered", "value"),
    )
    # An offer under the compared field hides the offer under the form key of the same document, readable or not.
    wanted = compared.select(
        "case_id", "service_id", "form_key", "compare_to", "compare_doc",
        F.explode(F.array_distinct(F.array("compare_to", "form_key"))).alias("offered"),
    )
    met = wanted.join(offers, ["case_id", "offered"]).withColumn("first_ord", F.col("doc_ord"))
    by_doc = met.groupBy("case_id", "service_id", "form_key", "compare_doc", "doc_type", "doc_ord", "first_ord").agg(
        F.min_by("value", F.when(F.col("offered") == F.col("compare_to"), 0).otherwise(1)).alias("value")
    )
    usable = by_doc.where(F.upper(text.strip(F.col("value"))) != text.UNCERTAIN)
    # Answers are the last tier of the same pick, so offers are made once and no answer is looked up again.
    places = [p.alias(f"place{i}") for i, p in enumerate(_preference())]
    offered = usable.select(*KEY, F.lit(0).alias("tier"), *places, "value")
    spare = [F.lit(None).cast(f.dataType).alias(f.name) for f in offered.schema.fields if f.name.startswith("place")]
    answered = service_answers_only(forms).select(*KEY, F.lit(1).alias("tier"), *spare, "value")
    pick = F.min(F.struct("tier", *[f.name for f in offered.schema.fields if f.name.startswith("place")], "value")).alias("b")
    return offered.unionByName(answered).groupBy(*KEY).agg(pick).select(*KEY, F.col("b.value").alias("value"))


def filled_form_rows(forms: DataFrame) -> DataFrame:
    """The printed form: label and upper-case value, a line for blanks, ``?`` for characters the printer lacks."""
    value = F.coalesce(F.nullif(F.try_element_at("answers", F.col("form_key")), F.lit("")), F.lit("_" * 16))

    def printable(c: Column) -> Column:
        return F.regexp_replace(c, r"[^\x00-\xFF]", "?")

    rows = forms.join(dims.form_fields(forms.sparkSession), "service_id")
    return rows.select(
        "case_id", "service_id", "field_ord", "form_key", printable(F.col("label")).alias("label"),
        printable(F.upper(value)).alias("value"),
    )
