"""Identity tables derived from the general test tables.

The test data has no identity documents, so these views derive them row by row: documents and forms from ``customer``,
desk dialogue from ``conversations``, case updates from ``events``.  Each value is an SQL expression kept as text, so
the same text can be run by another SQL engine for checking.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milaan.catalogue import dims
from milaan.session import grow_shuffles

SERVICE_IDS = [row[0] for row in dims.service_rows()]


def sql_case(subject: str, choices: list[str], modulus: int | None = None) -> str:
    """``CASE subject % n WHEN 0 THEN ...`` over quoted texts."""
    n = modulus or len(choices)
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices))
    return f"(CASE {subject} % {n} {arms} END)"


K = "c_custkey"
FAMILY = sql_case(K, ["Irfan Shaikh", "Ahmad Sheikh", "Karim Shaik", "Rahim Ansari"])
GIVEN = sql_case(K, ["Rahim", "Karim", "Ganesh", "Vijay"])
YEAR = f"CAST(1960 + {K} % 40 AS STRING)"

DOC_ORDS = [0, 1, 2, 3, 4, 5]
# Document 4 is a scanned form (some cases), document 5 a second scan of the Aadhaar card (some cases).  A few cases have
# no documents, or a passbook only.
DOC_EXISTS = (
    f"({K} % 29 <> 7 AND ({K} % 23 <> 5 OR ord = 2) AND "
    f"(ord < 4 OR (ord = 4 AND {K} % 4 = 0) OR (ord = 5 AND {K} % 9 = 0)))"
)

DOC_COLUMNS = {
    "doc_type": "CASE ord WHEN 0 THEN 'Aadhaar Card' WHEN 1 THEN 'PAN Card' WHEN 2 THEN 'Bank Passbook' "
    "WHEN 3 THEN 'Driving License' WHEN 4 THEN 'Scanned Application Form' ELSE 'Aadhaar Card' END",
    "source_file": "concat(CASE ord WHEN 0 THEN 'aadhaar_' WHEN 1 THEN 'pan card ' WHEN 2 THEN 'Passbook-' "
    f"WHEN 3 THEN 'scan DL ' WHEN 4 THEN 'filled_form_' ELSE 'photo' END, CAST({K} % 50 AS STRING), "
    f"CASE WHEN {K} % 2 = 0 THEN '.jpg' ELSE '.pdf' END)",
    "full_name": f"""CASE
        WHEN ord = 1 AND {K} % 3 = 0 THEN concat('Mohd ', {FAMILY})
        WHEN ord = 2 AND {K} % 7 = 0 THEN concat({FAMILY}, ' Mohammed')
        WHEN ord = 3 AND {K} % 11 = 0 THEN 'Ramesh Kumar Gupta'
        ELSE concat('Mohammed ', {FAMILY}) END""",
    "father_name": f"""CASE
        WHEN ord = 1 AND {K} % 3 = 0 THEN concat('A ', substring({GIVEN}, 1, 1), ' Shaikh')
        WHEN ord = 1 THEN concat('Shri Abdul ', {GIVEN}, ' Sheikh')
        WHEN ord = 2 AND {K} % 2 = 0 THEN 'UNCERTAIN'
        WHEN ord = 2 THEN concat('Shaikh Abdul ', {GIVEN})
        WHEN ord = 3 AND {K} % 6 = 0 THEN concat('Abdool ', {GIVEN}, ' Shaikh')
        WHEN ord = 3 AND {K} % 6 = 1 THEN concat('Abdul ', {GIVEN})
        WHEN ord = 3 AND {K} % 6 = 2 THEN concat('Abdhul ', {GIVEN}, ' Shaikh')
        WHEN ord = 3 AND {K} % 6 = 3 THEN concat('Abdhul ', {GIVEN})
        WHEN ord = 5 AND {K} % 5 = 0 THEN 'Shri'
        ELSE concat('Abdul ', {GIVEN}, ' Shaikh') END""",
    "dob": f"""CASE
        WHEN ord = 2 THEN 'UNCERTAIN'
        WHEN ord = 3 AND {K} % 13 = 0 THEN concat('15/06/', CAST(1961 + {K} % 40 AS STRING))
        WHEN ord = 1 THEN concat('14-06-', {YEAR})
        WHEN ord = 5 AND {K} % 4 = 0 THEN concat('14 June ', {YEAR})
        WHEN ord = 5 AND {K} % 4 = 1 THEN concat({YEAR}, '-06-14')
        WHEN ord = 5 AND {K} % 4 = 2 THEN concat('born ', {YEAR})
        ELSE concat('14/06/', {YEAR}) END""",
    "address": f"""CASE
        WHEN ord = 1 THEN 'UNCERTAIN'
        WHEN ord = 3 AND {K} % 5 = 0 THEN concat('Flat 12, CIDCO N-4, Aurangabad ', CAST(431000 + c_nationkey AS STRING))
        WHEN ord = 2 THEN concat('42 Gandhi Nagar, Kurla (W), Mumbai ', CAST(400000 + c_nationkey AS STRING))
        WHEN ord = 5 AND {K} % 2 = 0 THEN concat('Shop 7, Station Road, Kurla West, Thane ', CAST(400000 + c_nationkey AS STRING))
        ELSE concat('H No 42, Gandhi Nagar, Kurla West, Mumbai, Maharashtra ', CAST(400000 + c_nationkey AS STRING)) END""",
    "id_number": f"""CASE
        WHEN ord = 1 THEN concat('BXQPS', CAST(1000 + {K} % 9000 AS STRING), 'K')
        WHEN ord = 2 THEN CAST(12345600000 + {K} AS STRING)
        WHEN ord = 3 THEN concat('MH02 2011', CAST(1000000 + {K} AS STRING))
        WHEN ord = 5 AND {K} % 2 = 0 THEN concat('48216634', CAST(1000 + {K} % 9000 AS STRING))
        WHEN ord = 5 THEN concat('4821 6634 ', CAST(1001 + {K} % 9000 AS STRING))
        ELSE concat('4821 6634 ', CAST(1000 + {K} % 9000 AS STRING)) END""",
    "gender": f"""CASE
        WHEN ord = 1 AND {K} % 3 = 0 THEN 'F'
        WHEN ord = 1 THEN 'M.'
        WHEN ord = 2 THEN NULL
        WHEN ord = 3 AND {K} % 2 = 0 THEN 'पुरुष'
        WHEN ord = 5 THEN 'UNCERTAIN'
        ELSE 'Male' END""",
}
DOC_FIELDS = ["full_name", "father_name", "dob", "address", "id_number", "gender"]

# --- answers: one form per customer ------------------------------------------------------------------------------------
SERVICE_OF_CASE = sql_case(K, SERVICE_IDS)
ANSWER_KEYS = sorted({row[1] for row in dims.form_field_rows()}) + ["email_alt", "blood_group"]
ANSWER_VALUES = {
    "full_name": f"""CASE WHEN {K} % 17 = 0 THEN '' WHEN {K} % 10 = 3 THEN 'Ramesh Gupta'
        ELSE concat('Mohammed ', {FAMILY}) END""",
    "name_on_card": f"concat('Md. ', {FAMILY})",
    "child_name": f"concat(substring({GIVEN}, 1, 1), ' M ', {FAMILY})",
    "father_name": f"CASE WHEN {K} % 14 = 0 THEN NULL ELSE concat('Abdul ', {GIVEN}, ' Shaikh') END",
    "dob": f"""CASE WHEN {K} % 12 = 0 THEN concat('15/06/', {YEAR}) WHEN {K} % 12 = 1 THEN 'not known'
        WHEN {K} % 12 = 2 THEN '14/06/2031' ELSE concat(' 14/06/', {YEAR}) END""",
    "aadhaar_number": f"""CASE WHEN {K} % 8 = 0 THEN '1821 6634 9012' WHEN {K} % 8 = 1 THEN '4821 6634'
        ELSE concat('4821 6634 ', CAST(1000 + {K} % 9000 AS STRING)) END""",
    "pan_number": f"CASE WHEN {K} % 9 = 0 THEN 'BXQPS12' ELSE concat('bxqps', CAST(1000 + {K} % 9000 AS STRING), 'k') END",
    "dl_number": f"""CASE WHEN {K} % 6 = 0 THEN '' WHEN {K} % 6 = 1 THEN '02 MH 2011-1234567'
        WHEN {K} % 6 = 2 THEN 'MH02' ELSE concat('MH02 2011', CAST(1000000 + {K} AS STRING)) END""",
    "epic_number": sql_case(K, ["ABC1234567", "AB-123456", "12345678", "abc 1234567"]),
    "old_passport_number": sql_case(K, ["", "A1234567", "AB123456", "bad"]),
    "mobile": f"""CASE WHEN {K} % 7 = 0 THEN '12345' WHEN {K} % 7 = 1 THEN '+91 98765 43210'
        WHEN {K} % 7 = 2 THEN '5876543210' ELSE '98765 43210' END""",
    "email": sql_case(K, ["a.b@example.com", "bad mail@example.com", "nobody", " x@y.in "]),
    "address": f"""CASE WHEN {K} % 5 = 1 THEN 'Mumbai' ELSE
        concat('House 42, Gandhi Nagar, Kurla West, Mumbai ', CAST(400000 + c_nationkey AS STRING)) END""",
    "new_address": f"concat('House 42, Gandhi Nagar, Kurla West, Mumbai ', CAST(400000 + c_nationkey AS STRING))",
    "old_address": f"""CASE WHEN {K} % 4 = 0 THEN 'Pune' ELSE
        concat('Flat 12, CIDCO N-4, Aurangabad ', CAST(431000 + c_nationkey AS STRING)) END""",
    "account_number": f"CASE WHEN {K} % 4 = 0 THEN '12345' ELSE CAST(12345600000 + {K} AS STRING) END",
    "ifsc": sql_case(K, ["SBIN0001234", "sbin 0001234", "SBIN1001234"]),
    "scheme_name": sql_case(f"({K} // 15)", ["e-Shram registration", "pm-kisan", "", "My own scheme", "the Ayushman Bharat (PM-JAY) card"]),
    "category": sql_case(f"({K} // 15)", ["OBC", "General", "SC", ""], 4),
    "annual_income": sql_case(f"({K} // 15)", ["180000", "about two lakh", "2.5 lakh"]),
    "gender": sql_case(K, ["Male", "F", ""]),
    "update_fields": sql_case(f"({K} // 15)", ["mobile", ""]),
}
OTHER_ANSWER = f"CASE WHEN {K} % 19 = 0 THEN 'x' ELSE concat('Given ', k) END"
ANSWER_VALUE = "\n    ".join(["CASE k", *[f"WHEN '{k}' THEN {sql}" for k, sql in ANSWER_VALUES.items()], f"ELSE {OTHER_ANSWER} END"])


# ``//`` is integer division in one SQL dialect and ``div`` in the other.
def for_spark(sql: str) -> str:
    return sql.replace(" // ", " div ")


OCR_TEXT = """CASE
    WHEN doc_type = 'Bank Passbook' THEN concat('STATE BANK OF INDIA', chr(10), 'Account Holder: ', full_name, chr(10),
        'A/C No: ', id_number, chr(10), 'Account Opening Date: 12/03/2019', chr(10), 'Address: ', address)
    WHEN doc_type = 'PAN Card' THEN concat('INCOME TAX DEPARTMENT', chr(10), 'Name', chr(10), full_name, chr(10), chr(10),
        'Father''s Name: ', father_name, chr(10), chr(10), dob, chr(10), lower(id_number))
    WHEN doc_type = 'Driving License' THEN concat('Driving Licence No: ', id_number, chr(10), 'Date of Issue 01/02/2011',
        chr(10), 'Mr ', full_name, chr(10), 'S/O ', father_name, chr(10), 'पता ', address, chr(10), 'Valid: yes')
    ELSE concat('Government of India', chr(10), 'नाम: ', full_name, chr(10), 'DOB: ', dob, chr(10), id_number, chr(10),
        'Address: ', address, chr(10), 'VID 9111 2222 3333 4444') END"""
# What the reader model had already found; the rest is for the patterns to fill.
GIVEN_FIELDS = {
    "full_name": f"CASE WHEN {K} % 2 = 0 THEN 'UNCERTAIN' ELSE full_name END",
    "father_name": "'UNCERTAIN'",
    "dob": f"CASE WHEN {K} % 3 = 0 THEN '12/03/2019' ELSE 'UNCERTAIN' END",
    "address": f"CASE WHEN {K} % 4 = 0 THEN address ELSE 'N/A' END",
    "id_number": f"CASE WHEN {K} % 5 = 0 THEN '999988887777' WHEN {K} % 5 = 1 THEN id_number ELSE 'UNCERTAIN' END",
    "confidence_notes": f"CASE WHEN {K} % 2 = 0 THEN 'Clear.' ELSE '' END",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Cases one task works on.  A customer row has few bytes and stands for a form and up to six documents, so file sizes say nothing of
# the work: a whole table may lie in one row group, which is one task.
CASES_PER_TASK = 4096
# Bytes a case stands for behind the shuffles, where its form fields and document values meet (some 700 of them are written to disk).
CASE_BYTES = 8192


def spread(rows: DataFrame, total: int | None = None) -> DataFrame:
    """The rows dealt evenly over as many tasks as ``total`` (by default their number) needs, whatever their keys and files.

    Later shuffles get partitions for as many cases, so that their tasks do not grow with the table either.
    """
    total = rows.count() if total is None else total
    grow_shuffles(rows.sparkSession, total * CASE_BYTES)
    tasks = -(-total // CASES_PER_TASK)
    return rows.repartition(tasks) if tasks > 1 else rows


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))


def documents_wide(spark: SparkSession, sf_dir: str, keep_nation: bool = False) -> DataFrame:
    """One row per document with a column per field."""
    return documents_of(customers(spark, sf_dir), keep_nation)


def documents_of(customer_rows: DataFrame, keep_nation: bool = False) -> DataFrame:
    base = (
        customer_rows.select("c_custkey", "c_nationkey", F.explode(F.array(*[F.lit(o) for o in DOC_ORDS])).alias("ord"))
        .where(F.expr(DOC_EXISTS))
    )
    columns = [F.expr(sql).alias(name) for name, sql in DOC_COLUMNS.items()]
    kept = ["c_custkey", "c_nationkey"] if keep_nation else []
    return base.select(F.col("c_custkey").alias("case_id"), F.col("ord").alias("doc_ord"), *kept, *columns)


def _field_map(names: list[str]):
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records: case_id, doc_ord, doc_type, source_file, fields."""
    return documents_wide(spark, sf_dir).select(
        "case_id", "doc_ord", "doc_type", "source_file", _field_map(DOC_FIELDS).alias("fields")
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form per case: case_id, service_id, answers (may hold keys the service does not ask for)."""
    return customers(spark, sf_dir).select(*_form_columns())


def _form_columns():
    # One expression a key: a lambda over the keys would try all arms of ``ANSWER_VALUE`` for each of them, outside generated code.
    values = [F.expr(for_spark(ANSWER_VALUES.get(k, re.sub(r"\bk\b", f"'{k}'", OTHER_ANSWER)))) for k in ANSWER_KEYS]
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in ANSWER_KEYS]), F.array(*values))
    answers = F.map_filter(entries, lambda _, v: v.isNotNull())
    return F.col("c_custkey").alias("case_id"), F.expr(SERVICE_OF_CASE).alias("service_id"), answers.alias("answers")


def case_requests(customer_rows: DataFrame) -> DataFrame:
    """Complete cases as single rows (form and document array), the way they arrive on a stream.  No shuffle."""

    def document(ord_: int):
        def at(sql: str) -> str:
            return re.sub(r"\bord\b", str(ord_), sql)

        values = {f: F.expr(at(DOC_COLUMNS[f])) for f in DOC_FIELDS}
        pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in values]), F.array(*values.values()))
        doc = F.struct(
            F.expr(at(DOC_COLUMNS["doc_type"])).alias("doc_type"), F.expr(at(DOC_COLUMNS["source_file"])).alias("source_file"),
            F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("fields"),
        )
        return F.when(F.expr(at(DOC_EXISTS)), doc)

    documents_ = F.array_compact(F.array(*[document(o) for o in DOC_ORDS]))
    return customer_rows.select(*_form_columns(), documents_.alias("documents"))


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans before field extraction: case_id, doc_ord, doc_type, ocr_text, fields."""
    wide = documents_wide(spark, sf_dir, keep_nation=True)
    given = [F.expr(sql).alias(f"g_{name}") for name, sql in GIVEN_FIELDS.items()]
    names = F.array(*[F.lit(n) for n in GIVEN_FIELDS])
    values = F.array(*[F.col(f"g_{n}") for n in GIVEN_FIELDS])
    return wide.select("case_id", "doc_ord", "doc_type", F.expr(OCR_TEXT).alias("ocr_text"), *given).select(
        "case_id", "doc_ord", "doc_type", "ocr_text", F.map_from_arrays(names, values).alias("fields")
    )


# --- desk dialogue from conversations -----------------------------------------------------------------------------------
SPOKEN = """CASE s
    WHEN 0 THEN text
    WHEN 1 THEN 'Mera naam Sanika Santosh Chavan hai'
    WHEN 2 THEN CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN 'S A N I K A' ELSE 'my name is Santosh Chavan' END
    WHEN 3 THEN CASE WHEN conv_id % 3 = 0 THEN 'sorry, that is wrong' WHEN conv_id % 3 = 1 THEN 'please repeat' ELSE 'Sa' END
    WHEN 4 THEN '15 August 2001'
    WHEN 5 THEN '+91 98765 43210 please'
    WHEN 6 THEN '4821 6634 9012'
    WHEN 7 THEN CASE WHEN conv_id % 2 = 0 THEN 'I am done' ELSE 'what do I need to bring' END
    WHEN 8 THEN 's.chavan @ example.com'
    WHEN 9 THEN 'female'
    WHEN 10 THEN 'Flat 12, CIDCO N-4, Aurangabad 431003'
    ELSE 'general' END"""
SPOKEN_PER_TURN = 12
SERVICE_OF_CONV = sql_case("conv_id", SERVICE_IDS)


def desk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken turns: conv_id, service_id, turn, transcript (several per user turn of the conversation)."""
    return spoken_turns(read_table(spark, sf_dir, "conversations"))


def spoken_turns(conversations: DataFrame) -> DataFrame:
    spoken = F.explode(F.sequence(F.lit(0), F.lit(SPOKEN_PER_TURN - 1))).alias("s")
    return (
        conversations.where("role = 'user'")
        .select("conv_id", "turn", "text", spoken)
        .select(
            "conv_id",
            F.expr(SERVICE_OF_CONV).alias("service_id"),
            (F.col("turn") * SPOKEN_PER_TURN + F.col("s")).alias("turn"),
            F.expr(SPOKEN).alias("transcript"),
        )
    )


# --- case updates from events ---------------------------------------------------------------------------------------------
PATCH_COLUMNS = {
    "service_id": f"CASE WHEN event_type = 'signup' THEN {sql_case('event_id', SERVICE_IDS)} END",
    "citizen_label": "CASE WHEN event_type = 'signup' THEN concat('Citizen ', CAST(event_id AS STRING)) END",
    "step": "CASE WHEN event_type = 'click' THEN CAST(event_id % 5 AS INT) END",
    "notes": "CASE WHEN event_type = 'view' THEN concat('note ', props) END",
    "form_reviewed": "CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'submitted' END",
}
# Every ninth patch comes from somebody who does not own the case, and must not change it.
PATCH_USER = "CASE WHEN event_id % 9 = 4 THEN 'stranger' ELSE concat('u', user_id % 10) END"
# Every seventh user has no case, so their patches go nowhere.
CASE_EXISTS = "user_id % 7 <> 6"


def patches(events: DataFrame) -> DataFrame:
    """Case updates: case_id (one case per user), user_id, ts, patch_id and the columns set (NULL = left alone)."""
    columns = [F.expr(sql).alias(name) for name, sql in PATCH_COLUMNS.items()]
    return events.select(
        F.col("user_id").alias("case_id"), F.expr(PATCH_USER).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("patch_id"), *columns
    )


def known_cases(events: DataFrame) -> DataFrame:
    return events.where(CASE_EXISTS).groupBy(F.col("user_id").alias("case_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
