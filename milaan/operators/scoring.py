"""Scores, grades and risks of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims, facts
from milaan.functions import text
from milaan.functions.similarity import bind

CASE = ["case_id", "service_id"]


def whole_percent(c: Column) -> Column:
    """Round a ratio to whole percent, halves up."""
    return F.floor(c * 100 + 0.5).cast("int")


# --- parts of the score --------------------------------------------------------------------------------------------------


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rule_scores(validated: DataFrame) -> DataFrame:
    """Per case: passed checks over run checks, and filled fields over expected fields."""
    outcome = F.col("outcome")
    ran = F.count_if(outcome.isin("ok", "fail"))
    expected = F.count_if(outcome != "skipped")
    return validated.groupBy(*CASE).agg(
        _ratio(F.count_if(outcome == "ok"), ran).alias("format_score"),
        _ratio(F.count_if(~outcome.isin("skipped", "missing")), expected).alias("completeness"),
        F.bool_or(outcome.isin("fail", "missing")).alias("rule_fails"),
    )


def format_score(validated: DataFrame) -> DataFrame:
    return rule_scores(validated).select(*CASE, "format_score")


def completeness(validated: DataFrame) -> DataFrame:
    return rule_scores(validated).select(*CASE, "completeness")


STATUS_SCORE = {"MATCH": 1.0, "VARIANT": 0.85, "UNCERTAIN": 0.4, "CRITICAL": 0.0}


def _status_value(status: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def match_score(checks: DataFrame) -> DataFrame:
    """Per case: mean score of the form checks, with their worst findings."""
    return checks.groupBy(*CASE).agg(
        F.avg(_status_value(F.col("status"), STATUS_SCORE, 0.5)).alias("match_score"),
        F.count_if(F.col("status") == "CRITICAL").alias("form_blockers"),
        F.count_if(F.col("status") == "UNCERTAIN").alias("form_uncertain"),
    )


def missing_required_docs(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Required documents the case lacks, one row each."""
    needed = dims.service_docs(forms.sparkSession).where("kind = 'required'").select("service_id", "doc_type", "ord")
    return (
        forms.select(*CASE)
        .join(needed, "service_id")
        .join(docs.select("case_id", "doc_type").distinct(), ["case_id", "doc_type"], "left_anti")
        .select(*CASE, "doc_type", "ord")
    )


def docs_score(forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Per case: missing documents in order, the share present, and whether there is any document at all.

    Only document types some service requires are collected, so the set per case is bounded by the catalogue.
    """
    spark = forms.sparkSession
    kinds = sorted({d for r in facts.rows(facts.SERVICES) for d in facts.items(r[4])})
    present = docs.groupBy("case_id").agg(
        F.collect_set(F.when(F.col("doc_type").isin(*kinds), F.col("doc_type"))).alias("present")
    )
    missing = F.filter("required", lambda d: ~F.array_contains(F.coalesce("present", F.array().cast("array<string>")), d))
    share = 1 - _ratio(F.size("missing"), F.size("required"))
    return (
        forms.select(*CASE)
        .join(dims.required_docs(spark), "service_id")
        .join(present, "case_id", "left")
        .select(*CASE, missing.alias("missing"), F.col("present").isNotNull().alias("has_docs"), "required")
        .select(*CASE, "missing", "has_docs", F.greatest(F.lit(0.0), share).alias("docs_score"))
    )


def _schemes() -> Column:
    return F.array(
        *[F.struct(F.lit(r[0]).alias("name"), F.lit(r[1]).alias("eligibility")) for r in facts.rows(facts.SCHEMES)]
    )


def _named_scheme(answer: Column) -> Column:
    """First catalogue scheme whose name holds, or is held by, the answer (case ignored); NULL if none."""
    name = F.lower(answer)
    met = F.filter(_schemes(), lambda s: F.contains(name, F.lower(s["name"])) | F.contains(F.lower(s["name"]), name))
    return F.when(answer != "", F.get(met, 0))


def scheme_match(forms: DataFrame) -> DataFrame:
    answer = text.strip(F.coalesce(F.try_element_at("answers", F.lit("scheme_name")), F.lit("")))
    return (
        forms.where("service_id = 'scheme_apply'")
        .withColumn("scheme_name", answer)
        .select(*CASE, "scheme_name", _named_scheme(F.col("scheme_name")).alias("m"))
        .select(*CASE, "scheme_name", F.col("m.name").alias("matched"), "m.eligibility")
    )


def _eligibility(answers: Column) -> Column:
    """``struct<score, risk>`` of a scheme application."""

    def get(key: str) -> Column:
        return F.coalesce(F.try_element_at(answers, F.lit(key)), F.lit(""))

    def said(score: float, risk: Column) -> Column:
        return F.struct(F.lit(score).alias("score"), risk.alias("risk"))

    asked = text.strip(get("scheme_name"))
    unknown = F.concat(
        F.lit("Scheme '"), get("scheme_name"),
        F.lit("' not in local catalogue — operator must confirm the correct portal and eligibility manually"),
    )

    def judge(s: Column) -> Column:
        return (
            F.when(asked == "", said(0.0, F.lit("No scheme selected")))
            .when(s.isNull(), said(0.55, unknown))
            .when(
                text.strip(get("category")) == "",
                said(0.6, F.lit("Category (SC/ST/OBC/EWS/General) missing — many schemes reject without it")),
            )
            .when(
                ~get("annual_income").rlike(r"\p{Nd}"),
                said(0.65, F.lit("Annual income should include a number for eligibility screening")),
            )
            .otherwise(
                said(0.95, F.concat(F.lit("Matched catalogue scheme: "), s["name"], F.lit(" — "), s["eligibility"]))
            )
        )

    return bind(_named_scheme(asked), judge)


def eligibility_hint(forms: DataFrame) -> DataFrame:
    return (
        forms.where("service_id = 'scheme_apply'")
        .select(*CASE, _eligibility(F.col("answers")).alias("e"))
        .select(*CASE, F.col("e.score").alias("eligibility_score"), F.col("e.risk").alias("risk"))
    )


# --- the score -----------------------------------------------------------------------------------------------------------


def case_scores(forms: DataFrame, docs: DataFrame, checks: DataFrame, validated: DataFrame) -> DataFrame:
    """Score, grade, portal readiness, missing documents and risks of every case.

    All inputs are reduced to one row per case before they meet, so the joins shuffle case rows only.
    """
    spark = forms.sparkSession
    eligible = F.when(F.col("service_id") == "scheme_apply", _eligibility(F.col("answers")))
    case = (
        forms.select(*CASE, eligible.alias("e"))
        .join(dims.score_weights(spark), "service_id")
        .join(F.broadcast(dims.rejection_reasons(spark).where(F.col("ord") < facts.SHOWN_REASONS).groupBy("service_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", "reason"))), lambda r: r["reason"]).alias("reasons")
        )), "service_id", "left")
        .join(rule_scores(validated), CASE, "left")
        .join(docs_score(forms, docs), CASE, "left")
        .join(match_score(checks), CASE, "left")
    )
    zero = F.lit(0.0)
    parts = {
        "format_score": F.coalesce("format_score", zero),
        "completeness": F.coalesce("completeness", zero),
        "match_score": F.coalesce("match_score", F.when(F.col("has_docs"), 0.5).otherwise(0.0)),
        "eligibility_score": F.coalesce("e.score", F.lit(1.0)),
        "rule_fails": F.coalesce("rule_fails", F.lit(False)),
        "form_blockers": F.coalesce("form_blockers", F.lit(0)),
        "form_uncertain": F.coalesce("form_uncertain", F.lit(0)),
    }
    exact = 100.0 * (
        F.col("w_format") * F.col("format_score")
        + F.col("w_docs") * F.col("docs_score")
        + F.col("w_match") * F.col("match_score")
        + F.col("w_complete") * F.col("completeness")
        + F.col("w_eligible") * F.col("eligibility_score")
    )
    fails = F.col("rule_fails") | (F.col("form_blockers") > 0)
    lacks = F.size("missing") > 0
    risks = F.array_distinct(
        F.concat(
            F.array_compact(F.array("e.risk")),
            F.array_compact(
                F.array(F.when(lacks, F.concat(F.lit("Missing required documents: "), F.array_join("missing", ", "))))
            ),
            F.when(fails, F.coalesce("reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        )
    )
    return (
        case.withColumns(parts)
        .withColumn("exact_score", exact)
        .withColumn("grade", grade(F.col("exact_score"), fails | lacks, F.col("form_uncertain") > 0))
        .withColumn("rejection_risks", risks)
        .withColumn(
            "ready_for_portal",
            (F.col("form_blockers") == 0) & (F.col("form_uncertain") == 0) & (F.col("grade") == "READY"),
        )
        .select(
            *CASE, F.bround("exact_score", 1).alias("score"), "exact_score", "grade", "ready_for_portal",
            "format_score", "docs_score", "match_score", "completeness", "eligibility_score",
            "form_blockers", "form_uncertain", "missing", "rejection_risks",
        )
    )


def grade(score: Column, fails: Column, warns: Column) -> Column:
    return (
        F.when(fails, F.when(score < 60, "BLOCKED").otherwise("FIX_REQUIRED"))
        .when(warns, F.when(score < 85, "FIX_REQUIRED").otherwise("READY"))
        .otherwise(F.when(score >= 80, "READY").otherwise("FIX_REQUIRED"))
    )


def field_issues(validated: DataFrame, checks: DataFrame) -> DataFrame:
    """Rule outcomes and document conflicts as one issue list."""
    rules = validated.where(F.col("outcome").isin("ok", "fail", "missing")).select(
        *CASE, "form_key", F.when(F.col("outcome") == "ok", "OK").otherwise("FAIL").alias("severity"), "message",
        F.lit(0).alias("source"), F.col("rule_ord").alias("ord"),
    )
    conflict = F.col("status") == "CRITICAL"
    told = F.when(conflict, "Form value conflicts with supporting document").otherwise(
        "Could not verify against documents — operator must check"
    )
    found = checks.where(F.col("status").isin("CRITICAL", "UNCERTAIN")).select(
        *CASE, "form_key", F.when(conflict, "FAIL").otherwise("WARN").alias("severity"), told.alias("message"),
        F.lit(1).alias("source"), F.col("field_ord").alias("ord"),
    )
    return rules.unionByName(found)


def rejection_risks(scores: DataFrame) -> DataFrame:
    """Risk lines of each case in order."""
    return scores.select(*CASE, F.posexplode("rejection_risks").alias("ord", "risk"))


# --- accuracy per document ---------------------------------------------------------------------------------------------------

VERIFY_WEIGHT = {"MATCH": 1.0, "VARIANT": 0.85, "UNCERTAIN": 0.35, "CRITICAL": 0.0}


def _expected(doc_type: Column) -> Column:
    pairs = []
    for doc, fields in facts.rows(facts.EXPECTED_FIELDS):
        pairs += [F.lit(doc), F.array(*[F.lit(f) for f in facts.items(fields)])]
    usual = F.array(*[F.lit(f) for f in facts.EXPECTED_BY_DEFAULT])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), doc_type), usual)


def doc_ocr_pct(docs: DataFrame) -> DataFrame:
    """Readable expected fields over expected fields, per document.  A projection: no shuffle."""

    def found(fields: Column) -> Column:
        def test(f: Column) -> Column:
            v = F.try_element_at("fields", f)
            return F.coalesce(~F.upper(text.strip(v)).isin("", text.UNCERTAIN), F.lit(False))

        return F.filter(fields, test)

    return (
        docs.withColumn("expected", _expected(F.col("doc_type")))
        .withColumn("found", found(F.col("expected")))
        .select(
            "case_id", "doc_ord", "doc_type", F.size("found").alias("ocr_readable"), F.size("expected").alias("ocr_expected"),
            whole_percent(F.size("found") / F.size("expected")).alias("ocr_pct"),
            F.array_join(F.array_except("expected", "found"), ", ").alias("ocr_unsure"),
        )
    )


def doc_verify_pct(comparisons: DataFrame, checks: DataFrame) -> DataFrame:
    """Weighted agreement of everything that touches a document type of a case."""
    touched = comparisons.select(
        "case_id", F.explode(F.array_distinct(F.array("doc_a", "doc_b"))).alias("doc_type"), "status", "n_pairs"
    )
    checked = checks.where("doc_type IS NOT NULL").select("case_id", "doc_type", "status", F.lit(1).cast("long").alias("n_pairs"))
    n = F.col("n_pairs")
    weight = _status_value(F.col("status"), VERIFY_WEIGHT, 0.0)

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).cast("long")

    status = F.col("status")
    return touched.unionByName(checked).groupBy("case_id", "doc_type").agg(
        F.sum(n).cast("long").alias("verify_total"),
        count(status == "MATCH").alias("match"),
        count(status == "VARIANT").alias("variant"),
        count(status == "CRITICAL").alias("blocker"),
        count(~status.isin("MATCH", "VARIANT", "CRITICAL")).alias("unsure"),
        whole_percent(F.bround(F.sum(weight * n) / F.sum(n), 9)).alias("verify_pct"),
    )


def doc_accuracy(docs: DataFrame, comparisons: DataFrame, checks: DataFrame) -> DataFrame:
    """Per document: reading rate, agreement of its type, and their blend (40 : 60)."""
    blend = F.floor(F.bround(F.col("ocr_pct") * 0.4 + F.col("verify_pct") * 0.6, 9) + 0.5).cast("int")
    return (
        doc_ocr_pct(docs)
        .join(doc_verify_pct(comparisons, checks), ["case_id", "doc_type"], "left")
        .withColumn("overall_pct", F.coalesce(blend, F.col("ocr_pct")))
    )


def case_accuracy(accuracy: DataFrame) -> DataFrame:
    mean = F.avg("overall_pct")
    return accuracy.groupBy("case_id").agg(F.floor(mean + 0.5).cast("int").alias("accuracy_pct"))


def case_impact(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """What the check was worth: mismatches caught and minutes saved.  Cases without comparisons count as zero."""
    joined = scores.join(summary, "case_id", "left")
    variants, blockers = F.coalesce("variants", F.lit(0)), F.coalesce("blockers", F.lit(0))
    return joined.withColumn("caught", blockers + F.col("form_blockers")).select(
        *CASE, F.col("caught").cast("long").alias("caught"), variants.cast("long").alias("variants"),
        F.greatest(F.lit(8), 4 + 3 * F.col("caught") + variants).cast("long").alias("minutes_saved"),
        (F.col("ready_for_portal") & (F.col("caught") == 0)).alias("ready"),
    )


def cases_by_mode(scores: DataFrame) -> DataFrame:
    """Cases and grades by fill mode and service, with totals (NULL = all)."""
    spark = scores.sparkSession
    modes = dims.services(spark).select("service_id", "fill_mode")
    graded = [F.count_if(F.col("grade") == g).alias(g.lower()) for g in ("READY", "FIX_REQUIRED", "BLOCKED")]
    return (
        scores.join(modes, "service_id")
        .rollup("fill_mode", "service_id")
        .agg(F.count(F.lit(1)).alias("cases"), *graded)
        .withColumn("ready_rate", F.col("ready") / F.col("cases"))
    )


