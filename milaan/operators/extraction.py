"""Fields from scanned text: fill gaps and override doubtful readings where the text has a clear pattern.

Everything is one projection per table (no shuffle).  Label patterns are literal, so each is compiled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.catalogue import dims
from milaan.functions import text

FIELDS = ["full_name", "father_name", "dob", "address", "id_number"]

# --- fixed values: patterns of the numbers and labels on Indian identity documents ------------------------------------
DATE = r"\d{2}[/-]\d{2}[/-]\d{4}"
AADHAAR_SPACED = r"(?U)\b([2-9]\d{3})[ \-](\d{4})[ \-](\d{4})\b"
AADHAAR_SOLID = r"(?U)\b([2-9]\d{11})\b"
PAN = r"(?U)\b([A-Z]{5}[0-9]{4}[A-Z])\b"
ACCOUNT_LABELLED = r"(?i)(?:A/?C|Account)\s*(?:No|Number|#)?\s*[:\-]?\s*(\d{9,18})"
ACCOUNT_BARE = r"(?U)\b(\d{11,16})\b"
LICENCE = r"(?U)\b([A-Z]{2}[\s\-]?\d{2}[\s\-]?\d{4}[\s\-]?\d{7})\b"
DOB_LABELLED = rf"(?i)(?:Date\s*of\s*Birth|D\.?\s*O\.?\s*B\.?|जन्म\s*तिथि|जन्मतिथि)\s*[:\-–]?\s*({DATE})"
DATE_BARE = rf"(?U)\b({DATE})\b"
NAME_LABELLED = (
    r"(?i)(?:Name|नाम|Account Holder|Customer Name|Holder Name)\s*[:\-]?\s*([A-Za-z][A-Za-z.\s]{2,60})"
)
NAME_TITLED = r"(?i)(?:Shri|Smt|Mr|Mrs)\s+([A-Za-z][A-Za-z.\s]{2,50})"
FATHER_LABELLED = r"(?i)(?:Father|Father'?s Name|S/O|D/O|C/O|W/O|पिता|पति)\s*[:\-/]?\s*([A-Za-z][A-Za-z.\s]{2,50})"
ADDRESS_LABELLED = r"(?is)(?:Address|पता|Residential Address)\s*[:\-]?\s*(.+?)(?:\n\n|\n[A-Z][a-z]+:|VID|$)"
ISSUER_WORDS = "government|india|authority|unique|identification"
NAME_TITLES = ["mr", "mrs", "ms", "shri", "smt", "kumari"]
BARE_DATE_DOCS = ["Aadhaar Card", "PAN Card", "Driving License", "Voter ID", "School Certificate", "Passport"]
CLEARED_DOB = "cleared dob — passbook opening/statement date ≠ birth date"

# Form keys with patterns of their own, tried when the printed label gave nothing.
FORM_PATTERNS = {
    "mobile": r"(?i)(?:Mobile(?:\s*Number)?|Phone)\s*[:\-–]?\s*([6-9]\d{9})",
    "dl_number": r"(?i)(?:Driving\s*Licence(?:\s*Number)?|DL\s*(?:No|Number)?)\s*[:\-–]?\s*([A-Z]{2}\s?\d{2}\s?\d{4}\s?\d{7})",
    "full_name": r"(?i)(?:Full\s*Name|Applicant(?:\s*Full)?\s*Name)\s*[:\-–]?\s*([A-Za-z][A-Za-z.\s]{2,60})",
    "father_name": r"(?i)(?:Father'?s?(?:\s*/\s*Guardian'?s?)?\s*Name)\s*[:\-–]?\s*([A-Za-z][A-Za-z.\s]{2,60})",
    "dob": rf"(?i)(?:Date\s*of\s*Birth|DOB)\s*[:\-–]?\s*({DATE})",
    "change_type": r"(?i)(?:What\s*to\s*Change|Change\s*Type)\s*[:\-–]?\s*([A-Za-z /]{3,40})",
    "old_address": r"(?i)(?:Address\s*currently\s*on\s*DL|Old\s*Address|Address\s*on\s*Current\s*DL)\s*[:\-–]?\s*(.+?)(?:\n|$)",
    "new_address": r"(?i)(?:New\s*Address|Current\s*Address(?:\s*\(as\s*on\s*Aadhaar\))?)\s*[:\-–]?\s*(.+?)(?:\n|$)",
    "aadhaar_number": r"(?i)(?:Aadhaar(?:\s*Number)?)\s*[:\-–]?\s*([X\d]{4}\s*[X\d]{4}\s*\d{4}|\d{4}\s*\d{4}\s*\d{4})",
    "pan_number": r"(?i)(?:PAN(?:\s*(?:No|Number|Card))?)\s*[:\-–]?\s*([A-Z]{5}[0-9]{4}[A-Z])",
    "reason": r"(?i)(?:Reason(?:\s*for\s*Update)?)\s*[:\-–]?\s*(.+?)(?:\n|$)",
}


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The matched group, NULL when the pattern is not there."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _trim(c: Column, characters: str) -> Column:
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def _tidy_name(c: Column) -> Column:
    return _trim(text.squeeze(c), r" .\-")


def _id_in_text(ocr: Column) -> Column:
    upper = F.upper(ocr)
    solid = _found(F.regexp_replace(ocr, text.SPACE, ""), AADHAAR_SOLID)
    aadhaar = F.coalesce(
        F.when(ocr.rlike(AADHAAR_SPACED), F.concat_ws(" ", *[_found(ocr, AADHAAR_SPACED, g) for g in (1, 2, 3)])),
        _four_by_four(solid),
    )
    return (
        F.when(F.col("doc_type") == "Aadhaar Card", aadhaar)
        .when(F.col("doc_type") == "PAN Card", _found(upper, PAN))
        .when(F.col("doc_type") == "Bank Passbook", F.coalesce(_found(ocr, ACCOUNT_LABELLED), _found(ocr, ACCOUNT_BARE)))
        .when(F.col("doc_type") == "Driving License", F.regexp_replace(_found(upper, LICENCE), r"[\s\-]+", " "))
    )


def _four_by_four(digits: Column) -> Column:
    return F.when(
        digits.isNotNull(), F.concat_ws(" ", digits.substr(1, 4), digits.substr(5, 4), digits.substr(9, 4))
    )


def _bare_date(ocr: Column) -> Column:
    """The first date of the text unless "issue" stands close before or after it."""
    at = F.regexp_instr(ocr, F.lit(DATE_BARE))
    first = F.greatest(F.lit(1), at - 24)
    around = F.lower(ocr.substr(first, at + 18 - first))
    issued = around.rlike("issue|जारी")
    return F.when((at > 0) & ~issued, F.replace(_found(ocr, DATE_BARE), F.lit("-"), F.lit("/")))


def _name_in_text(ocr: Column) -> Column:
    def fit(pattern: str) -> Column:
        name = _tidy_name(_found(ocr, pattern))
        return F.when((F.size(F.split(name, " ")) >= 2) & ~F.lower(name).rlike(ISSUER_WORDS), name)

    return F.coalesce(fit(NAME_LABELLED), fit(NAME_TITLED))


def _middle_names(full_name: Column) -> Column:
    """Given + father + surname: what stands between the first and the last word, titles aside."""
    parts = F.split(text.squeeze(full_name), " ")
    titled = F.regexp_replace(F.lower(F.get(parts, 0)), r"\.+$", "").isin(*NAME_TITLES)
    parts = F.when(titled, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    middle = _trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), " "), r" .\-")
    return F.when(text.readable(full_name) & (F.size(parts) >= 3) & (F.length(middle) >= 2), middle)


def extract_fields(scans: DataFrame) -> DataFrame:
    """Scans with ``fields`` completed from ``ocr_text`` (map in, map out), and the notes told what changed.

    Needs doc_type, ocr_text, fields; other columns pass through.
    """
    ocr = F.coalesce("ocr_text", F.lit(""))
    given = {f: F.try_element_at("fields", F.lit(f)) for f in [*FIELDS, "confidence_notes"]}
    out = scans.withColumns({f"_g_{f}": c for f, c in given.items()})
    passbook = F.col("doc_type") == "Bank Passbook"
    old_id, id_unread = F.col("_g_id_number"), ~text.readable(F.col("_g_id_number"))
    bare_id = F.regexp_replace(F.coalesce(old_id, F.lit("")), text.SPACE, "")
    digits = F.regexp_replace(F.coalesce(old_id, F.lit("")), r"[^0-9]", "")
    labelled = F.replace(_found(ocr, DOB_LABELLED), F.lit("-"), F.lit("/"))
    dob_read = text.readable(F.col("_g_dob"))
    out = out.withColumns({"_ocr_id": _id_in_text(ocr), "_labelled": labelled})
    quoted = [F.lit("Overrode LLM id_number '"), bare_id, F.lit("' with OCR '"), F.col("_ocr_id"), F.lit("'")]
    overrode = ~id_unread & (bare_id != F.regexp_replace("_ocr_id", text.SPACE, ""))
    respaced = (F.col("doc_type") == "Aadhaar Card") & ~id_unread & digits.rlike("^[2-9][0-9]{11}$")
    old_notes = F.col("_g_confidence_notes")
    stripped = text.strip(F.coalesce(old_notes, F.lit("")))
    cleared = passbook & F.col("_labelled").isNull() & dob_read
    out = out.withColumns(
        {
            "id_number": F.coalesce("_ocr_id", F.when(respaced, _four_by_four(digits)), old_id),
            "_id_note": F.when(overrode, F.concat(*quoted)),
            "dob": F.coalesce(
                "_labelled",
                F.when(passbook, F.lit(text.UNCERTAIN)),
                F.when(~dob_read & F.col("doc_type").isin(*BARE_DATE_DOCS), _bare_date(ocr)),
                F.col("_g_dob"),
            ),
            "_notes": F.when(
                cleared,
                F.when(stripped == "", F.lit(CLEARED_DOB)).otherwise(
                    _trim(F.concat(stripped, F.lit("; "), F.lit(CLEARED_DOB)), "; ")
                ),
            ).otherwise(old_notes),
            "full_name": F.coalesce(
                F.when(~text.readable(F.col("_g_full_name")), _name_in_text(ocr)), F.col("_g_full_name")
            ),
        }
    )
    no_father = ~text.readable(F.col("_g_father_name"))
    named = _tidy_name(_found(ocr, FATHER_LABELLED))
    inferred = F.when(
        no_father & named.isNull() & F.col("doc_type").isin("Aadhaar Card", "PAN Card"), _middle_names(F.col("full_name"))
    )
    address = text.squeeze(_found(ocr, ADDRESS_LABELLED))
    out = out.withColumn("_inferred", inferred).withColumns(
        {
            "father_name": F.coalesce(F.when(no_father, named), F.col("_inferred"), F.col("_g_father_name")),
            "_father_note": F.concat(
                F.lit("father_name inferred from middle of full_name ('"), F.col("_inferred"), F.lit("')")
            ),
            "address": F.coalesce(
                F.when(~text.readable(F.col("_g_address")) & (F.length(address) > 10), address), F.col("_g_address")
            ),
        }
    )
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_g_{f}")) for f in FIELDS])
    changed = F.col("_id_note").isNotNull() | ~same | ~F.col("_notes").eqNullSafe(old_notes)
    told = text.strip(
        F.concat(
            F.coalesce("_notes", F.lit("")), F.lit(" Regex/OCR ID check. "), F.concat_ws(" ", "_id_note", "_father_note")
        )
    )
    values = {**{f: F.col(f) for f in FIELDS}, "confidence_notes": F.when(changed, told).otherwise(F.col("_notes"))}
    filled = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    filled = F.map_concat(
        F.map_filter("fields", lambda k, _: ~k.isin(*values)), F.map_filter(filled, lambda _, v: v.isNotNull())
    )
    return out.withColumn("fields", filled).select(*scans.columns)


def process_scans(scans: DataFrame) -> DataFrame:
    """Noise removal, extraction and the handwriting note (needs ``handwritten``)."""
    done = extract_fields(scans.withColumn("ocr_text", text.without_ocr_noise(F.col("ocr_text"))))
    notes = F.coalesce(F.try_element_at("fields", F.lit("confidence_notes")), F.lit(""))
    said = F.contains(F.lower(notes), F.lit("handwrit"))
    noted = F.map_concat(
        F.map_filter("fields", lambda k, _: k != "confidence_notes"),
        F.create_map(F.lit("confidence_notes"), text.strip(F.concat(notes, F.lit(" Handwritten/form source.")))),
    )
    return done.withColumn("fields", F.when(F.col("handwritten") & ~said, noted).otherwise(F.col("fields")))


def extract_form_labels(scans: DataFrame) -> DataFrame:
    """Answers of a scanned form: one row per form field of the service with the value next to its printed label.

    The label is located as plain text and only what follows is matched, so no pattern is built per row.
    """
    rows = scans.join(dims.form_fields(scans.sparkSession).select("service_id", "form_key", "label"), "service_id")
    ocr = F.coalesce("ocr_text", F.lit(""))
    at = F.position(F.lower("label"), F.lower(ocr))
    rest = ocr.substr(at + F.length("label"), F.length(ocr))
    beside = _trim(text.squeeze(_found(rest, r"^\s*[:\-–]?\s*(.+?)(?:\n|$)")), r" .\-_|")
    beside = F.when((at > 0) & (beside != "") & ~F.contains(F.upper(beside), F.lit("FORM-ONLY")), beside)
    own = F.lit(None).cast("string")
    for key, pattern in FORM_PATTERNS.items():
        own = F.when(F.col("form_key") == key, _found(ocr, pattern)).otherwise(own)
    value = F.coalesce(beside, text.squeeze(own))
    return rows.select("case_id", "service_id", "form_key", value.alias("value"))


def merge_form_answers(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """Per form field: the model's value when it has one, else the value by label, else blank."""
    said = F.when(text.readable(F.col("model_value")), text.strip(F.col("model_value")))
    keys = ["case_id", "service_id", "form_key"]
    return labelled.join(model.select(*keys, "model_value"), keys, "left").select(
        *keys, F.coalesce(said, "value", F.lit("")).alias("value")
    )


def parse_model_replies(replies: DataFrame) -> DataFrame:
    """Raw model replies (``raw``) to the five fields: fences stripped, outermost braces taken, JSON parsed.

    A field that is no text reads UNCERTAIN; a reply without JSON gives a blank row with a note.
    """
    raw = text.strip(F.coalesce("raw", F.lit("")))
    body = F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    fenced = _found(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
    braces = _found(body, r"(?s)(\{.*\})")
    first = F.try_parse_json(F.coalesce(fenced, braces, body))
    second = F.try_parse_json(_found(raw, r"(?s)(\{.*\})"))
    parsed = replies.withColumns({"_raw": raw, "_first": first, "_second": second}).withColumn(
        "_data", F.coalesce("_first", "_second")
    )

    def field(name: str) -> Column:
        value = F.try_variant_get("_data", f"$.{name}", "variant")
        said = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("_data", f"$.{name}", "string"))
        return F.when(text.strip(said) != "", said).otherwise(F.lit(text.UNCERTAIN))

    note = F.try_variant_get("_data", "$.confidence_notes", "string")
    failed = F.concat(F.lit("JSON parse failed; raw: '"), F.col("_raw"), F.lit("'"))
    notes = (
        F.when(F.col("_raw") == "", F.lit("Model returned empty content"))
        .when(F.col("_data").isNull(), failed)
        .when(F.col("_first").isNull(), F.coalesce(note, F.lit("Scraped JSON from noisy model output")))
        .otherwise(note)
    )
    return parsed.select(
        *replies.columns, *[field(f).alias(f) for f in FIELDS], notes.alias("confidence_notes")
    )
