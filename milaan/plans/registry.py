"""The registered queries: every operator on tables derived from the test data.

Each query is a callable (spark, sf_dir) -> DataFrame with scalar columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milaan.catalogue import dims, facts
from milaan.functions import compare, spoken, text, validators
from milaan.operators import cases, dialogue, documents, extraction, forms, pairs, review, scoring, views
from milaan.plans.verify import Verification
from milaan.session import tuned
from milaan.sources import bridge, readers, writers
from milaan.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CASE = ["case_id", "service_id"]


def today() -> Column:
    """The day the registered queries are run for, fixed so that results repeat."""
    return F.lit("2026-01-01").cast("date")


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tuned(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def verification(spark: SparkSession, sf_dir: str, keep: bool = False) -> Verification:
    return Verification(bridge.forms(spark, sf_dir), bridge.documents(spark, sf_dir), today(), keep)


def id_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.drop_form_docs(bridge.documents(spark, sf_dir))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- sources and sinks ----------------------------------------------------------------------------------------------------


@query
def load_extractions(spark, sf_dir):
    record = F.struct("doc_ord", "doc_type", "source_file", F.lit("en-IN").alias("language"), "fields")
    listed = bridge.documents(spark, sf_dir).groupBy("case_id").agg(F.collect_list(F.to_json(record)).alias("l"))
    path = writers.scratch_path(spark, "extractions")
    in_order = F.transform(
        F.array_sort(F.transform("l", lambda j: F.from_json(j, "doc_ord int, doc_type string, source_file string, language string, fields map<string,string>"))
                     .cast("array<struct<doc_ord:int,doc_type:string,source_file:string,language:string,fields:map<string,string>>>"),
                     lambda a, b: a["doc_ord"] - b["doc_ord"]),
        lambda d: d.dropFields("doc_ord"),
    )
    listed.select("case_id", in_order.alias("extractions")).write.json(path)
    return readers.load_extractions(spark, path).select(
        "case_id", F.col("doc_ord").cast("long").alias("doc_ord"), "doc_type", "source_file", "language",
        F.col("fields.full_name").alias("full_name"), F.col("fields.id_number").alias("id_number"),
        F.col("fields")["gender"].alias("gender"),
    )


@query
def load_answers(spark, sf_dir):
    path = writers.scratch_path(spark, "answers")
    bridge.forms(spark, sf_dir).write.json(path)
    return forms.answer_fields(readers.load_answers(spark, path))


def catalogue_file(spark):
    """The built-in catalogue in the nested form of catalogue files, one service a line."""
    listed = lambda table, order, item, name: table.groupBy("service_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, item.alias("x")))), lambda r: r["x"]).alias(name)
    )
    field = F.struct(F.col("form_key").alias("key"), "label", "compare_to", "compare_doc", "high_stakes")
    rules = dims.field_rules(spark).groupBy("service_id", "form_key").agg(F.collect_list("validator").alias("validators"), F.max("optional").alias("optional"))
    rules = rules.groupBy("service_id").agg(F.map_from_entries(F.collect_list(F.struct("form_key", F.struct("validators", "optional")))).alias("field_rules"))
    docs = lambda kind: listed(dims.service_docs(spark).where(F.col("kind") == kind), "ord", F.col("doc_type"), f"{kind}_docs")
    weights = [c for c in dims.score_weights(spark).columns if c != "service_id"]
    pairs_ = F.map_from_arrays(F.array(*[F.lit(w.removeprefix("w_")) for w in weights]), F.array(*weights)).alias("accuracy_weights")
    out = dims.services(spark).select(
        "service_id", F.col("service_id").alias("id"), "title", "category", "fill_mode", F.struct(F.col("portal_name").alias("name"), F.col("portal_url").alias("url")).alias("portal")
    )
    for part in (
        listed(dims.form_fields(spark), "field_ord", field, "form_fields"), rules, docs("required"), docs("optional"),
        listed(dims.rejection_reasons(spark), "ord", F.col("reason"), "rejection_reasons"), dims.score_weights(spark).select("service_id", pairs_),
    ):
        out = out.join(part, "service_id", "left")
    return out.drop("service_id")


@query
def load_catalogue(spark, sf_dir):
    path = writers.scratch_path(spark, "catalogue")
    catalogue_file(spark).write.json(path)
    read = readers.load_catalogue(spark, path)
    per_service = bridge.forms(spark, sf_dir).groupBy("service_id").agg(F.count(F.lit(1)).alias("cases"))
    fields = read["form_fields"].groupBy("service_id").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if("high_stakes").alias("high_stakes"), F.count("compare_to").alias("compared"),
        F.max_by("form_key", "field_ord").alias("last_field"),
    )
    rules = read["field_rules"].groupBy("service_id").agg(F.count(F.lit(1)).alias("ruled_fields"), F.sum(F.size("validators")).alias("validators"), F.count_if("optional").alias("optional"))
    docs = read["service_docs"].groupBy("service_id").agg(F.count_if(F.col("kind") == "required").alias("required_docs"), F.count(F.lit(1)).alias("docs"))
    reasons = read["rejection_reasons"].groupBy("service_id").agg(F.count(F.lit(1)).alias("reasons"), F.max_by("reason", "ord").alias("last_reason"))
    weights = read["score_weights"].groupBy("service_id").agg(r6(F.sum("weight")).alias("weight_sum"))
    out = read["services"].select("service_id", "title", "fill_mode", F.col("name").alias("portal_name")).join(per_service, "service_id")
    for part in (fields, rules, docs, reasons, weights):
        out = out.join(part, "service_id")
    return out


@query
def load_cases(spark, sf_dir):
    customer = bridge.read_table(spark, sf_dir, "customer")
    raw = customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("u"), F.expr("c_custkey % 20")).alias("user_id"),
        F.expr(bridge.SERVICE_OF_CASE).alias("service_id"), F.col("c_name").alias("citizen_label"), F.expr("CAST(c_custkey % 5 AS INT)").alias("step"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('{\"full_name\":\"', c_name, '\",\"age\":', c_custkey, '}') END").alias("answers"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '[{\"doc_type\":\"PAN Card\",\"fields\":{\"dob\":\"14/06/1992\"}}]' END").alias("extractions"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN '{\"grade\":\"READY\"}' END").alias("verify_result"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END").alias("notes"),
        F.expr("CAST(c_custkey % 2 AS INT)").alias("form_reviewed"), F.lit(None).cast("int").alias("ocr_reviewed"), F.lit("draft").alias("status"),
        F.expr("CAST(1700000000 + c_custkey AS DOUBLE)").alias("created_at"), F.expr("1700000000.5 + c_custkey").cast("double").alias("updated_at"),
    )
    return readers.load_cases(raw).select(
        "case_id", "user_id", "step", F.col("answers")["full_name"].alias("full_name"), F.col("answers")["age"].alias("age"),
        F.size("extractions").cast("long").alias("n_docs"), F.get("extractions", 0)["fields"]["dob"].alias("dob"),
        F.try_variant_get("verify_result", "$.grade", "string").alias("grade"), "notes", "form_reviewed", "ocr_reviewed",
        F.unix_micros("updated_at").alias("updated_us"),
    )


def text_pages(spark, sf_dir):
    lines = bridge.read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", F.concat(F.lit("page_"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit(".md")).alias("page_name"), "text")


@query
def assemble_ocr_pages(spark, sf_dir):
    return readers.assemble_ocr_pages(text_pages(spark, sf_dir))


@query
def ocr_json_to_text(spark, sf_dir):
    block = F.struct("text", F.col("turn").alias("n"))
    page = F.to_json(F.struct(F.array(block).alias("blocks"), F.struct(F.col("role").alias("value"), F.lit("text").alias("kind")).alias("meta")))
    rows = bridge.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", page.alias("page"))
    return rows.select("conv_id", "turn", readers.ocr_json_to_text(F.col("page")).alias("ocr_text"))


@query
def write_result_pack(spark, sf_dir):
    path = writers.scratch_path(spark, "packs")
    writers.write_result_packs(verification(spark, sf_dir, keep=True).packs, path)
    back = spark.read.schema("case_id long, kind string, doc_ord int, pack string, service_id string").json(path)
    ddl = (
        "service string, portal struct<name:string,url:string>, accuracy struct<score:double,grade:string>, answers map<string,string>, "
        "flags array<struct<field:string,severity:string,message:string>>, doc_type string, source_file string, fields map<string,string>"
    )
    p = F.col("p")
    said = lambda m: F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    flags = F.transform(p["flags"], lambda f: F.concat_ws("/", f["field"], f["severity"], f["message"]))
    return back.withColumn("p", F.from_json("pack", ddl)).select(
        "case_id", "service_id", "kind", F.col("doc_ord").cast("long").alias("doc_ord"), p["portal"]["name"].alias("portal"), p["portal"]["url"].alias("portal_url"),
        r6(p["accuracy"]["score"]).alias("score"), p["accuracy"]["grade"].alias("grade"), F.nullif(said(p["answers"]), F.lit("")).alias("answers"),
        F.nullif(F.array_join(F.sort_array(flags), "; "), F.lit("")).alias("flags"), p["doc_type"].alias("doc_type"), p["source_file"].alias("source_file"),
        F.nullif(said(p["fields"]), F.lit("")).alias("fields"),
    )


@query
def audit_rows(spark, sf_dir):
    return verification(spark, sf_dir, keep=True).audit.select("case_id", "section", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "line")


@query
def matrix_audit_rows(spark, sf_dir):
    return review.matrix_audit_rows(views.matrix_cells(id_docs(spark, sf_dir)))


@query
def filled_form_rows(spark, sf_dir):
    return forms.filled_form_rows(bridge.forms(spark, sf_dir))


def scans_with_blanks(spark, sf_dir):
    wide = bridge.documents_wide(spark, sf_dir)
    return wide.select("case_id", "doc_ord", "doc_type", "source_file", F.expr(f"CASE WHEN case_id % 20 = 0 AND doc_ord = 2 THEN ' ' ELSE {bridge.OCR_TEXT} END").alias("ocr_text"))


@query
def extraction_failures(spark, sf_dir):
    return readers.with_outcome(scans_with_blanks(spark, sf_dir)).select("case_id", F.col("source_file").alias("file"), "doc_type", "error")


# --- projections and filters --------------------------------------------------------------------------------------------------


@query
def unpivot_fields(spark, sf_dir):
    return documents.unpivot_fields(id_docs(spark, sf_dir))


@query
def readable_filter(spark, sf_dir):
    return documents.readable_only(documents.unpivot_fields(id_docs(spark, sf_dir)))


@query
def drop_form_docs(spark, sf_dir):
    return id_docs(spark, sf_dir).select("case_id", "doc_ord", "doc_type", "source_file")


@query
def service_answers_only(spark, sf_dir):
    return forms.service_answers_only(bridge.forms(spark, sf_dir))


@query
def guess_doc_type(spark, sf_dir):
    files = bridge.documents(spark, sf_dir).select("case_id", "doc_ord", F.col("source_file").alias("file_name"))
    preferred = F.when(F.col("case_id") % 2 == 0, F.array(F.lit("Voter ID"), F.lit("PAN Card"))).otherwise(F.array().cast("array<string>"))
    wide = documents.guess_doc_type(files, preferred).withColumnRenamed("doc_type", "guess")
    return documents.guess_doc_type(wide, preferred, with_forms=False).withColumnRenamed("doc_type", "guess_without_forms")


@query
def dedupe_uploads(spark, sf_dir):
    tries = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt")
    ups = bridge.documents(spark, sf_dir).select("case_id", "doc_ord", F.col("source_file").alias("file_name"), tries)
    ups = ups.withColumn("size", F.expr("1000 + case_id * 7 + CASE WHEN attempt = 2 AND case_id % 3 = 0 THEN 1 ELSE 0 END"))
    return documents.dedupe_uploads(ups).select("case_id", "file_name", "size")


# --- text rules ---------------------------------------------------------------------------------------------------------------------


@query
def standardize(spark, sf_dir):
    rows = documents.readable_only(documents.unpivot_fields(id_docs(spark, sf_dir)))
    values = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("uses"))
    return values.select("field", "value", "uses", text.clean(F.col("value")).alias("clean"), text.standard_form(F.col("field"), F.col("value")).alias("std"))


@query
def alias_canon(spark, sf_dir):
    names = documents.unpivot_fields(id_docs(spark, sf_dir), ["full_name", "father_name"])
    used = names.select(F.explode(text.words(F.col("value"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    canon = dims.spelling_words(spark).groupBy("group_id").agg(
        F.min(F.struct((-F.length("word")).alias("l"), "word"))["word"].alias("canonical"), F.collect_list("word").alias("words")
    )
    table = canon.select("canonical", F.explode("words").alias("word"))
    return table.join(used, "word").select("word", "canonical", "uses")


@query
def std_view(spark, sf_dir):
    d = id_docs(spark, sf_dir)
    name, dob, address = (F.col("fields")[f] for f in ("full_name", "dob", "address"))
    return d.select(
        "case_id", "doc_ord", text.view_name(name).alias("name"), text.view_dob_key(dob).alias("dob_key"), text.view_dob_year(dob).alias("dob_year"),
        F.array_join(F.array_sort(text.view_address_tokens(address, facts.VIEW_ADDRESS_STOPWORDS)), " ").alias("address"),
    )


@query
def std_gender(spark, sf_dir):
    g = F.try_element_at("fields", F.lit("gender"))
    return id_docs(spark, sf_dir).select("case_id", "doc_ord", g.alias("gender"), text.gender_class(g).alias("gender_class"))


SPOKEN_KEYS = ["full_name", "mobile", "email", "gender", "address", "dob", "aadhaar_number", "purpose"]


def spoken_values(spark, sf_dir):
    keys = F.explode(F.array(*[F.lit(k) for k in SPOKEN_KEYS])).alias("field_key")
    turns = bridge.desk_turns(spark, sf_dir).select("conv_id", "turn", "transcript", keys)
    return turns.withColumn("value", spoken.form_value(F.col("transcript"), F.col("field_key")))


@query
def std_spoken(spark, sf_dir):
    return spoken_values(spark, sf_dir).select("conv_id", "turn", "field_key", "value")


@query
def std_ocr_noise(spark, sf_dir):
    noisy = F.concat(
        F.lit("![scan](data:image/png;base64,AAAA+/=)"), F.lit("\n\n\n\nThe image provided is a portrait photograph of a person.\nIt has a Plain Background.\n"),
        F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n\n\nseal: data:image/jpeg;base64,QUJD\n"),
    )
    rows = bridge.read_table(spark, sf_dir, "documents").select("doc_id", noisy.alias("ocr_text"))
    return rows.select("doc_id", text.without_ocr_noise(F.col("ocr_text")).alias("ocr_text"))


# --- extraction ------------------------------------------------------------------------------------------------------------------------


@query
def extract_fields(spark, sf_dir):
    done = extraction.extract_fields(bridge.scanned_documents(spark, sf_dir))
    return done.select("case_id", "doc_ord", "doc_type", *[F.col("fields")[f].alias(f) for f in [*extraction.FIELDS, "confidence_notes"]])


@query
def process_scans(spark, sf_dir):
    """The whole scan job: noise removal, extraction, and the note on handwritten sources."""
    noisy = F.concat(F.lit("![scan](data:image/png;base64,AAAA+/=)\n"), F.col("ocr_text"), F.lit("\n\n\n\nseal: data:image/jpeg;base64,QUJD\n"))
    scans = bridge.scanned_documents(spark, sf_dir).withColumns({"ocr_text": noisy, "handwritten": F.expr("case_id % 3 = 0")})
    done = extraction.process_scans(scans)
    return done.select("case_id", "doc_ord", "doc_type", *[F.col("fields")[f].alias(f) for f in [*extraction.FIELDS, "confidence_notes"]])


def form_scans(spark, sf_dir):
    """Scanned application forms: some labels as printed, some in other words."""
    rows = forms.form_rows(bridge.forms(spark, sf_dir)).where("form_value <> ''")
    line = F.when((F.col("case_id") + F.col("field_ord")) % 3 == 0, F.concat(F.lit("DL No "), F.col("form_value"))).otherwise(
        F.concat(F.col("label"), F.when(F.col("case_id") % 2 == 0, ": ").otherwise(" \n- "), F.col("form_value"))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("field_ord", line.alias("line")))), lambda x: x["line"])
    body = F.concat(F.lit("APPLICATION FORM\nPhone: 9876543210\n"), F.array_join(lines, "\n"), F.lit("\nDOB: 01/02/1990\nReason: lost card"))
    return rows.groupBy(*CASE).agg(body.alias("ocr_text"))


@query
def ext_form_labels(spark, sf_dir):
    return extraction.extract_form_labels(form_scans(spark, sf_dir))


@query
def merge_form_answers(spark, sf_dir):
    labelled = extraction.extract_form_labels(form_scans(spark, sf_dir))
    model = forms.form_rows(bridge.forms(spark, sf_dir)).select(
        *CASE, "form_key", F.expr("CASE WHEN case_id % 3 = 0 THEN concat('  ', form_value) WHEN case_id % 3 = 1 THEN 'n/a' END").alias("model_value")
    )
    return extraction.merge_form_answers(labelled, model)


@query
def parse_model_replies(spark, sf_dir):
    plain = "concat('{\"full_name\": \"', full_name, '\", \"dob\": \"', dob, '\", \"id_number\": ', doc_ord, ', \"address\": \" \", \"confidence_notes\": \"seen\"}')"
    raw = f"""CASE case_id % 6 WHEN 0 THEN {plain} WHEN 1 THEN concat('```json', chr(10), {plain}, chr(10), '```')
        WHEN 2 THEN concat('Here you are: ', {plain}, ' hope it helps') WHEN 3 THEN concat('Sorry, I cannot read ', doc_type)
        WHEN 4 THEN '' ELSE concat('```', {plain}, '``` and {{') END"""
    replies = bridge.documents_wide(spark, sf_dir).select("case_id", "doc_ord", F.expr(raw).alias("raw"))
    return extraction.parse_model_replies(replies).drop("raw")


# --- rules -------------------------------------------------------------------------------------------------------------------------------


@query
def validate_answers(spark, sf_dir):
    return verification(spark, sf_dir).validated.select(*CASE, "form_key", "validator", "optional", "value", "outcome", "message")


@query
def val_required(spark, sf_dir):
    v = verification(spark, sf_dir).validated
    kinds = {"missing": "missing", "skipped": "skipped"}
    return v.groupBy("service_id", "form_key").agg(
        *[F.count_if(F.col("outcome") == o).alias(n) for n, o in kinds.items()], F.count_if(F.col("value") != "").alias("filled")
    )


@query
def val_spoken(spark, sf_dir):
    rows = spoken_values(spark, sf_dir)
    return rows.select("conv_id", "turn", "field_key", validators.spoken_problem(F.col("field_key"), F.col("value")).alias("problem"))


@query
def val_passport(spark, sf_dir):
    number = F.try_element_at("answers", F.lit("old_passport_number"))
    v = validators.passport(F.coalesce(number, F.lit("")))
    return bridge.forms(spark, sf_dir).select("case_id", v["ok"].alias("ok"), v["message"].alias("message"))


@query
def validator_scorecard(spark, sf_dir):
    return forms.validator_scorecard(verification(spark, sf_dir).validated).withColumn("pass_rate", r6("pass_rate"))


# --- verdicts ------------------------------------------------------------------------------------------------------------------------------


def form_doc_values(spark, sf_dir):
    """Answers next to the values of every document."""
    answers = forms.form_rows(bridge.forms(spark, sf_dir)).where("compare_to IS NOT NULL")
    shown = documents.unpivot_fields(id_docs(spark, sf_dir))
    pair = answers.join(shown, (answers.case_id == shown.case_id) & (answers.compare_to == shown.field)).select(
        answers.case_id, "form_key", "field", "doc_ord", F.col("form_value").alias("value_a"), F.col("value").alias("value_b")
    )
    return pair


@query
def classify_pairs(spark, sf_dir):
    distinct = form_doc_values(spark, sf_dir).groupBy("field", "value_a", "value_b").agg(F.count(F.lit(1)).alias("uses"))
    return pairs.classify_pairs(distinct)


@query
def classify_pairs_desk(spark, sf_dir):
    rows = form_doc_values(spark, sf_dir)
    return rows.withColumn("status", compare.desk_view_status(F.col("field"), F.col("value_a"), F.col("value_b")))


@query
def classify_pairs_matrix(spark, sf_dir):
    rows = form_doc_values(spark, sf_dir)
    return rows.withColumn("status", compare.matrix_status(F.col("field"), F.col("value_a"), F.col("value_b"), F.lit(False)))


# --- joins ------------------------------------------------------------------------------------------------------------------------------------


@query
def cross_doc_pairs(spark, sf_dir):
    return verification(spark, sf_dir).comparisons


@query
def cross_doc_pairs_desk(spark, sf_dir):
    p = views.cross_doc_pairs_desk(id_docs(spark, sf_dir))
    return p.select("case_id", "field", "doc_a", "doc_b", "value_a", "value_b", "status", "n_pairs")


@query
def matrix_vs_reference(spark, sf_dir):
    return views.matrix_cells(id_docs(spark, sf_dir))


@query
def majority_vote(spark, sf_dir):
    columns = ["case_id", "field", "doc_a", "doc_b", "value_a", "value_b", "n_pairs", "ord_a", "ord_b"]
    return pairs.majority_vote(verification(spark, sf_dir).pair_verdicts, columns).drop("ord_a", "ord_b")


@query
def form_vs_docs(spark, sf_dir):
    v = verification(spark, sf_dir)
    return forms.form_vs_docs(v.answers, v.docs).drop("first_ord", "high_stakes")


@query
def form_vs_docs_desk(spark, sf_dir):
    v = verification(spark, sf_dir)
    return views.form_checks_desk(v.answers, v.docs).select(*CASE, "form_key", "form_value", "doc_type", "doc_value", "status")


@query
def unmatched_form_fields(spark, sf_dir):
    return forms.unmatched_form_fields(verification(spark, sf_dir).checks).select(*CASE, "form_key", "form_value", "status", "detail")


@query
def carry_forward(spark, sf_dir):
    return forms.carry_forward(bridge.forms(spark, sf_dir)).drop("field_ord")


@query
def missing_required_docs(spark, sf_dir):
    v = verification(spark, sf_dir)
    return scoring.missing_required_docs(v.answers, v.docs)


@query
def answers_with_rules(spark, sf_dir):
    return forms.answers_with_rules(bridge.forms(spark, sf_dir)).drop("rule_ord")


@query
def remediation_route(spark, sf_dir):
    return verification(spark, sf_dir).remediation


@query
def service_lookup(spark, sf_dir):
    answers = bridge.forms(spark, sf_dir).select("case_id", F.expr("CASE WHEN case_id % 16 = 7 THEN 'no_such_service' ELSE service_id END").alias("service_id"))
    return forms.service_lookup(answers).select("case_id", "service_id", "title", "portal_name", "outcome")


@query
def scheme_match(spark, sf_dir):
    return scoring.scheme_match(bridge.forms(spark, sf_dir)).drop("eligibility")


@query
def other_doc_values(spark, sf_dir):
    return pairs.other_doc_values(id_docs(spark, sf_dir))


@query
def other_sources(spark, sf_dir):
    v = verification(spark, sf_dir)
    return forms.other_sources(v.answers, v.docs, v.checks).drop("first_ord")


# --- aggregations ------------------------------------------------------------------------------------------------------------------------------


@query
def verdict_summary(spark, sf_dir):
    return verification(spark, sf_dir).summary


@query
def matrix_summary(spark, sf_dir):
    return views.matrix_summary(views.matrix_cells(id_docs(spark, sf_dir)))


@query
def verdict_by_field(spark, sf_dir):
    return pairs.verdict_by_field(verification(spark, sf_dir).comparisons)


@query
def blocker_counts(spark, sf_dir):
    return verification(spark, sf_dir).blocker_counts.drop("first_charge")


@query
def blocker_counts_desk(spark, sf_dir):
    return views.blocker_counts_desk(views.cross_doc_pairs_desk(id_docs(spark, sf_dir)))


@query
def matrix_blockers(spark, sf_dir):
    return views.matrix_blockers(views.matrix_cells(id_docs(spark, sf_dir))).drop("first_field")


@query
def uncertain_count(spark, sf_dir):
    return documents.uncertain_count(id_docs(spark, sf_dir))


@query
def readable_of_five(spark, sf_dir):
    return documents.readable_of_five(id_docs(spark, sf_dir))


@query
def format_score(spark, sf_dir):
    return scoring.format_score(verification(spark, sf_dir).validated).withColumn("format_score", r6("format_score"))


@query
def completeness(spark, sf_dir):
    return scoring.completeness(verification(spark, sf_dir).validated).withColumn("completeness", r6("completeness"))


@query
def docs_score(spark, sf_dir):
    v = verification(spark, sf_dir)
    return scoring.docs_score(v.answers, v.docs).select(*CASE, r6("docs_score").alias("docs_score"))


@query
def match_score(spark, sf_dir):
    return scoring.match_score(verification(spark, sf_dir).checks).withColumn("match_score", r6("match_score"))


@query
def eligibility_hint(spark, sf_dir):
    return scoring.eligibility_hint(bridge.forms(spark, sf_dir)).withColumn("eligibility_score", r6("eligibility_score"))


@query
def case_score(spark, sf_dir):
    parts = ["format_score", "docs_score", "match_score", "completeness", "eligibility_score"]
    return verification(spark, sf_dir).scores.select(*CASE, "score", *[r6(p).alias(p) for p in parts])


@query
def case_score_desk(spark, sf_dir):
    v = verification(spark, sf_dir)
    return views.case_scores_desk(v.answers, v.docs, views.form_checks_desk(v.answers, v.docs)).drop("graded_ready")


@query
def case_grade(spark, sf_dir):
    return verification(spark, sf_dir).scores.select(*CASE, "grade")


@query
def ready_for_portal(spark, sf_dir):
    return verification(spark, sf_dir).scores.select(*CASE, "ready_for_portal")


@query
def field_issues(spark, sf_dir):
    return verification(spark, sf_dir).issues.drop("source", "ord")


@query
def rejection_risks(spark, sf_dir):
    return scoring.rejection_risks(verification(spark, sf_dir).scores)


@query
def approved_fields(spark, sf_dir):
    v = verification(spark, sf_dir)
    return forms.approved_fields(v.answers, v.checks).select(*CASE, F.explode("approved").alias("form_key", "value"))


@query
def doc_ocr_pct(spark, sf_dir):
    return scoring.doc_ocr_pct(id_docs(spark, sf_dir)).drop("ocr_unsure")


@query
def doc_verify_pct(spark, sf_dir):
    v = verification(spark, sf_dir)
    return scoring.doc_verify_pct(v.comparisons, v.checks)


@query
def doc_overall_pct(spark, sf_dir):
    return verification(spark, sf_dir).accuracy.select("case_id", "doc_ord", "doc_type", "ocr_pct", "verify_pct", "overall_pct")


@query
def case_overall_pct(spark, sf_dir):
    return scoring.case_accuracy(verification(spark, sf_dir).accuracy)


@query
def case_impact(spark, sf_dir):
    return verification(spark, sf_dir).impact


@query
def form_complete(spark, sf_dir):
    return forms.form_complete(bridge.forms(spark, sf_dir))


@query
def cases_by_mode(spark, sf_dir):
    return scoring.cases_by_mode(verification(spark, sf_dir).scores).withColumn("ready_rate", r6("ready_rate"))


@query
def side_by_side(spark, sf_dir):
    wide = documents.side_by_side(id_docs(spark, sf_dir), ["Aadhaar Card", "PAN Card", "Driving License"])
    return wide.toDF("case_id", "field", "aadhaar", "pan", "licence", "other")


@query
def side_by_side_rows(spark, sf_dir):
    return documents.side_by_side_rows(id_docs(spark, sf_dir))


# --- picks ---------------------------------------------------------------------------------------------------------------------------------------


@query
def primary_blocker(spark, sf_dir):
    return verification(spark, sf_dir).primary


@query
def primary_blocker_matrix(spark, sf_dir):
    return views.primary_blocker_matrix(views.matrix_cells(id_docs(spark, sf_dir)))


@query
def best_form_check(spark, sf_dir):
    return verification(spark, sf_dir).checks.select(*CASE, "form_key", "form_value", "doc_type", "doc_value", "status")


@query
def check_detail(spark, sf_dir):
    return verification(spark, sf_dir).checks.select("case_id", "form_key", "detail")


@query
def best_readable_value(spark, sf_dir):
    return forms.best_readable_values(id_docs(spark, sf_dir), {"address": "Bank Passbook"})


@query
def prefill_form(spark, sf_dir):
    v = verification(spark, sf_dir)
    return forms.prefill_form(v.answers, v.docs)


@query
def reference_doc(spark, sf_dir):
    return views.reference_doc(id_docs(spark, sf_dir)).select("case_id", "field", "ref_ord", "ref_doc", "ref_value")


@query
def next_empty_field(spark, sf_dir):
    return forms.next_empty_field(bridge.forms(spark, sf_dir))


def new_cases(spark, sf_dir):
    known = bridge.known_cases(bridge.read_table(spark, sf_dir, "events"))
    created = known["created_at"]
    bare = known.select("case_id", F.concat(F.lit("u"), F.expr("case_id % 10")).alias("user_id"))
    rows = cases.new_case_defaults(bare.join(known.select("case_id", created.alias("at")), "case_id"), F.col("at")).drop("at")
    return rows.withColumns({"service_id": F.lit(None).cast("string"), "citizen_label": F.lit(None).cast("string")})


def case_table(spark, sf_dir):
    return cases.apply_case_patches(new_cases(spark, sf_dir), bridge.patches(bridge.read_table(spark, sf_dir, "events")))


@query
def recent_cases(spark, sf_dir):
    return cases.recent_cases(case_table(spark, sf_dir), 5).select("user_id", "case_id", "place", F.unix_micros("updated_at").alias("updated_us"))


@query
def findings_order(spark, sf_dir):
    return review.findings_order(verification(spark, sf_dir).comparisons).select("case_id", "rank", "ord_a", "ord_b", "field", "status", "n_pairs")


# --- set operations ------------------------------------------------------------------------------------------------------------------------------


@query
def flag_board(spark, sf_dir):
    v = verification(spark, sf_dir, keep=True)
    return review.flag_board(v.issues, v.checks, v.comparisons)


@query
def all_blockers(spark, sf_dir):
    v = verification(spark, sf_dir)
    return review.all_blockers(v.comparisons, v.checks)


@query
def expected_docs(spark, sf_dir):
    wanted = dims.service_docs(spark)
    return bridge.forms(spark, sf_dir).select(*CASE).join(wanted, "service_id").select("case_id", "service_id", "doc_type", "kind", "ord")


@query
def review_split(spark, sf_dir):
    v = verification(spark, sf_dir)
    return review.review_split(v.checks, v.comparisons)


# --- case table -------------------------------------------------------------------------------------------------------------------------------------


@query
def apply_case_patches(spark, sf_dir):
    kept = ["case_id", "user_id", "service_id", "citizen_label", "step", "notes", "form_reviewed", "status"]
    return case_table(spark, sf_dir).select(*kept, F.unix_micros("updated_at").alias("updated_us"))


@query
def new_case_defaults(spark, sf_dir):
    payload = bridge.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 4 AS INT) END").alias("step"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'open' END").alias("status"),
    )
    return cases.new_case_defaults(payload, today()).select(
        "case_id", "step", "answers", "extractions", "notes", "form_reviewed", "ocr_reviewed", "status", F.col("created_at").cast("string").alias("created_at")
    )


# --- dialogue and streams -----------------------------------------------------------------------------------------------------------------------------


def turn_columns(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "service_id", "turn", "action", "update_key", "update_value", "next_field")


@query
def turn_outcomes(spark, sf_dir):
    return turn_columns(dialogue.turn_outcomes(bridge.desk_turns(spark, sf_dir)))


@query
def form_fill_turns(spark, sf_dir):
    return dialogue.form_state(dialogue.turn_outcomes(bridge.desk_turns(spark, sf_dir)))


@query
def turn_action_rates(spark, sf_dir):
    return dialogue.action_rates(dialogue.turn_outcomes(bridge.desk_turns(spark, sf_dir))).withColumn("rate", r6("rate"))


@query
def agent_turns(spark, sf_dir):
    """Turns that bring their own answers and open field: forms next to what was said."""
    said = F.expr(f"CASE case_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'wrong' WHEN 2 THEN 'please repeat' WHEN 3 THEN 'all done' WHEN 4 THEN 'which documents' ELSE 'Sanika Chavan' END")
    active = F.expr("CASE WHEN case_id % 3 = 0 THEN 'full_name' END")
    requests = bridge.forms(spark, sf_dir).select("case_id", "service_id", "answers", said.alias("transcript"), active.alias("active_field"))
    return dialogue.agent_turns(requests).select(*CASE, "action", "update_key", "update_value", "next_field")


@query
def yes_no_intent(spark, sf_dir):
    rows = bridge.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE turn % 4 WHEN 0 THEN concat('Haan, ', text) WHEN 1 THEN concat(text, ' theek. nahi') ELSE text END").alias("transcript"))
    return rows.select("conv_id", "turn", spoken.yes_or_no(F.col("transcript")).alias("intent"))


BATCHES = 3


def in_batches(spark, sf_dir, table: str, part) -> DataFrame:
    """A table as a stream of about ``BATCHES`` batches; ``part`` (0, 1, 2) says in which order its rows arrive."""
    folder, rows = writers.scratch_path(spark, "arrivals"), bridge.read_table(spark, sf_dir, table)
    for k in range(BATCHES):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/{table}.parquet")
    files = len(spark.read.parquet(f"{folder}/{table}.parquet").inputFiles())
    return jobs.read_stream(spark, folder, table, max(1, -(-files // BATCHES)))


def third(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BATCHES))


@query
def form_fill_stream(spark, sf_dir):
    """Conversations return in later batches: their first turns arrive first."""
    stream = in_batches(spark, sf_dir, "conversations", F.least(F.floor(F.col("turn") / 3), F.lit(BATCHES - 1)))
    turns = bridge.spoken_turns(stream).withColumn("ts", F.timestamp_seconds(F.col("turn") * 60))
    return turn_columns(jobs.form_fill_stream(turns, writers.scratch_path(spark, "form_fill")))


@query
def case_patch_stream(spark, sf_dir):
    patches = bridge.patches(in_batches(spark, sf_dir, "events", third("event_id")))
    rows = jobs.case_patch_stream(patches, writers.scratch_path(spark, "patches"), new_cases(spark, sf_dir))
    kept = ["case_id", "user_id", "service_id", "citizen_label", "step", "notes", "form_reviewed", "status"]
    return rows.select(*kept, F.unix_micros("updated_at").alias("updated_us"))


@query
def dedupe_upload_stream(spark, sf_dir):
    events = in_batches(spark, sf_dir, "events", third("event_id"))
    uploads = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("case_id"), F.concat(F.lit("scan_"), F.col("event_type"), F.lit(".jpg")).alias("file_name"), F.expr("event_id % 3").alias("size"))
    kept, late = jobs.split_uploads(uploads, writers.scratch_path(spark, "uploads"), hold="3650 days")
    return kept.unionByName(late).select("case_id", "file_name", "size")


@query
def verify_stream(spark, sf_dir):
    customers = in_batches(spark, sf_dir, "customer", third("c_custkey"))
    stream = bridge.case_requests(bridge.spread(customers, -(-bridge.read_table(spark, sf_dir, "customer").count() // BATCHES)))
    rows = jobs.verify_stream(stream, writers.scratch_path(spark, "verify"), today())
    return verdict_columns(rows)


@query
def quarantine_stream(spark, sf_dir):
    customers = in_batches(spark, sf_dir, "customer", third("c_custkey"))
    customers = bridge.spread(customers, -(-bridge.read_table(spark, sf_dir, "customer").count() // BATCHES))
    scans = bridge.documents_of(customers).select(
        "case_id", "doc_ord", "doc_type", "source_file", F.expr(f"CASE WHEN case_id % 20 = 0 AND doc_ord = 2 THEN ' ' ELSE {bridge.OCR_TEXT} END").alias("ocr_text")
    )
    good, failed = jobs.quarantine_stream(scans, writers.scratch_path(spark, "quarantine"))
    kept = good.select("case_id", F.col("source_file").alias("file"), "doc_type", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(failed.select("case_id", "file", "doc_type", "error"))


def verdict_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        *CASE, "matches", "variants", "blockers", "uncertain", "score", "grade", "ready_for_portal", "primary_doc", "blocker_count", "portal_name"
    )


@query
def verify(spark, sf_dir):
    """The flagship: one verdict row per case."""
    return verdict_columns(verification(spark, sf_dir, keep=True).verdicts)
