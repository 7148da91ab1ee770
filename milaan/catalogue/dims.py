"""Dimension tables over the fixed facts.

Each is a literal ``VALUES`` relation, so Catalyst knows its exact (small, constant) size and may broadcast it on its
own size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milaan.catalogue import facts


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "array(" + ", ".join(_sql_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A constant table with the column names and types of ``ddl``; its size is fixed here, so joins may broadcast it."""
    columns = [c.strip().split(" ", 1) for c in ddl.split(",")]
    values = ",\n".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})"))


def service_rows() -> list[tuple]:
    return [
        (sid, title, category, mode, portal, url or "", kb_category, n)
        for n, (sid, title, category, mode, _req, _opt, portal, url, kb_category) in enumerate(facts.rows(facts.SERVICES))
    ]


def service_doc_rows() -> list[tuple]:
    """Required documents first, then optional ones, in one running order per service."""
    out = []
    for row in facts.rows(facts.SERVICES):
        required, optional = facts.items(row[4]), facts.items(row[5])
        for n, doc in enumerate(required + optional):
            out.append((row[0], "required" if n < len(required) else "optional", doc, n))
    return out


def form_field_rows() -> list[tuple]:
    out, seen = [], {}
    for sid, key, label, compare_to, compare_doc, stakes in facts.rows(facts.FORM_FIELDS):
        n = seen.setdefault(sid, 0)
        seen[sid] = n + 1
        out.append((sid, key, n, label, compare_to, compare_doc, stakes == "yes"))
    return out


def field_rule_rows() -> list[tuple]:
    """(service, key, rule order, validator or None, optional)."""
    out: list[tuple] = []
    for sid, key, rule, need in facts.rows(facts.FIELD_RULES):
        out.append((sid, key, sum(r[0] == sid for r in out), None if rule == "none" else rule, need == "optional"))
    return out


def weight_rows() -> list[tuple]:
    return [(r[0], *[float(x) for x in r[1:]]) for r in facts.rows(facts.SCORE_WEIGHTS)]


def reason_rows() -> list[tuple]:
    out: list[tuple] = []
    for service, reason in facts.rows(facts.REJECTION_REASONS):
        out.append((service, sum(r[0] == service for r in out), reason))
    return out


def services(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        "service_id string, title string, category string, fill_mode string, portal_name string, portal_url string, "
        "rule_category string, service_ord int",
        service_rows(),
    )


def service_docs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "service_id string, kind string, doc_type string, ord int", service_doc_rows())


def form_fields(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        "service_id string, form_key string, field_ord int, label string, compare_to string, compare_doc string, "
        "high_stakes boolean",
        form_field_rows(),
    )


def field_rules(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        "service_id string, form_key string, rule_ord int, validator string, optional boolean",
        field_rule_rows(),
    )


def score_weights(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        "service_id string, w_format double, w_docs double, w_match double, w_complete double, w_eligible double",
        weight_rows(),
    )


def required_docs(spark: SparkSession) -> DataFrame:
    """One row per service: its required documents in order."""
    return literal_table(
        spark,
        "service_id string, required array<string>",
        [(r[0], facts.items(r[4])) for r in facts.rows(facts.SERVICES)],
    )


def rejection_reasons(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "service_id string, ord int, reason string", reason_rows())


def scheme_catalogue(spark: SparkSession) -> DataFrame:
    rows = [("scheme_apply", n, r[0], r[1]) for n, r in enumerate(facts.rows(facts.SCHEMES))]
    return literal_table(spark, "service_id string, ord int, name string, eligibility string", rows)


def identity_fields(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], n) for n, r in enumerate(facts.rows(facts.IDENTITY_FIELDS))]
    return literal_table(spark, "field string, label string, field_ord int", rows)


def remediation(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], r[2] or "", r[3]) for r in facts.rows(facts.REMEDIATION)]
    return literal_table(spark, "doc_type string, portal string, url string, how string", rows)


def languages(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "language string, code string", [tuple(r) for r in facts.rows(facts.LANGUAGES)])


def doc_types(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "doc_type string, ord int", [(r[0], n) for n, r in enumerate(facts.rows(facts.DOC_TYPES))])


def spelling_words(spark: SparkSession) -> DataFrame:
    """One row per (group, word) of the spelling groups."""
    rows = [(n, w) for n, line in enumerate(facts.SPELLING_GROUPS.strip().splitlines()) for w in line.split()]
    return literal_table(spark, "group_id int, word string", rows)
