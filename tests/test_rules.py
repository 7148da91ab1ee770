"""Single rules on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from milaan.functions import similarity, spoken, text, validators
from milaan.operators import cases, dialogue, documents, extraction, pairs
from milaan.sources import readers

VERDICTS = [
    ("full_name", "Mohd Irfan Shaikh", "Mohammed Irfan Shaikh", "VARIANT"),
    ("full_name", "Mohammed Irfan Shaik", "Mohammed Irfan Shaikh", "VARIANT"),
    ("father_name", "Abdul Rahim Sheikh", "Abdul Rahim Shaikh", "VARIANT"),
    ("father_name", "A R Shaikh", "Abdul Rahim Shaikh", "VARIANT"),
    ("full_name", "Mohamad Irfan Ahemad Shaikh", "Mohammed Irfan Shaikh", "VARIANT"),
    ("full_name", "Mohammed Irfan Shaikh", "Ramesh Kumar Gupta", "CRITICAL"),
    ("full_name", "Mohammed Irfan Shaikh", "Mohammed  Irfan Shaikh", "MATCH"),
    ("full_name", "Kumar Rajesh", "Rajesh Kumar", "VARIANT"),
    ("full_name", "Shri", "Rajesh Kumar", "UNCERTAIN"),
    ("full_name", "N/A", "Rajesh Kumar", "UNCERTAIN"),
    ("dob", "14/06/1992", "14-06-1992", "VARIANT"),
    ("dob", "14/06/1992", "14/06/1993", "CRITICAL"),
    ("dob", "June 1992", "14/06/1992", "UNCERTAIN"),
    ("address", "H No 42, Gandhi Nagar, Kurla West, Mumbai, Maharashtra 400070", "42 Gandhi Nagar, Kurla (W), Mumbai 400070", "VARIANT"),
    ("address", "H No 42, Gandhi Nagar, Mumbai", "Flat 12, CIDCO N-4, Aurangabad 431003", "CRITICAL"),
    ("id_number", "4821 6634 9012", "482166349012", "MATCH"),
    ("id_number", "4821", "4822", "CRITICAL"),
    ("gender", "Male", "male.", "MATCH"),
]


def test_verdicts_both_ways(spark):
    rows = [(n, f, a, b) for n, (f, a, b, _) in enumerate(VERDICTS)]
    rows += [(n, f, b, a) for n, f, a, b in rows]
    got = pairs.classify_pairs(spark.createDataFrame(rows, "n int, field string, value_a string, value_b string")).collect()
    wrong = [(r["field"], r["value_a"], r["value_b"], r["status"]) for r in got if r["status"] != VERDICTS[r["n"]][3]]
    assert wrong == []


def test_dates(spark):
    wanted = {
        "14/06/1992": (1992, 6, 14), "05/13/1990": (1990, 5, 13), "2001-08-05": (2001, 8, 5), "DOB: 3.4.1975": (1975, 4, 3),
        "14 June 1992": (1992, 6, 14), "14th of June, 1992": (1992, 6, 14), "June 14th, 1992": (1992, 6, 14), "14-Jun-1992": (1992, 6, 14),
        "31/02/1990": None, "1992": None, "14/06/92": None, "": None, "not known": None,
    }
    frame = spark.createDataFrame([(k,) for k in wanted], "v string").select("v", text.day_first_date(F.col("v")).alias("d"))
    assert {r["v"]: r["d"] for r in frame.collect()} == {k: v and datetime.date(*v) for k, v in wanted.items()}


def test_clean_drops_combining_marks(spark):
    row = spark.createDataFrame([("नाम: राम_1 É! ",)], "v string").select(text.clean(F.col("v"))).first()[0]
    import re

    assert row.split() == re.sub(r"[^\w\s]", " ", "नाम: राम_1 É! ".lower()).split()


def plain_similarity(a: str, b: str) -> float:
    """Textbook Jaro-Winkler, for checking."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = list(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == ch:
                free[j] = None
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, [c for c, f in zip(b, free) if f is None])) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_similarity_against_the_textbook(spark):
    import itertools
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abkrs") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["shaikh", "sheikh", "राम", "रमा"]
    frame = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = frame.select("a", "b", similarity.jaro_winkler(a, b).alias("s"), similarity.similarity_if_alike(a, b).alias("t")).collect()
    for r in got:
        want = plain_similarity(r["a"], r["b"])
        assert r["s"] == pytest.approx(want, abs=1e-9)
        assert (r["t"] >= 0.88) == (want >= 0.88)


def test_canonical_spelling_is_stable():
    table = text.canonical_spelling()
    assert table["mohd"] == "mohammad" and table["sk"] == "shaikh"
    assert all(table[best] == best for best in table.values())


def test_validators(spark):
    rows = [
        ("aadhaar", "4821 6634 9012", True), ("aadhaar", "123", False), ("aadhaar", "1821 6634 9012", False),
        ("mobile", "9876543210", True), ("mobile", "+91 98765 43210", True), ("mobile", "12345", False),
        ("pan", "bxqps 4821k", True), ("pan", "BAD", False), ("dob", "14/06/1992", True), ("dob", "14/06/2031", False),
        ("dob", "01/01/1899", False), ("dl_number", "MH20 20190045678", True), ("epic", "ABC1234567", True), ("epic", "12345678", False),
        ("passport", "", True), ("passport", "A1234567", True), ("ifsc", "SBIN0001234", True), ("ifsc", "SBIN1001234", False),
        ("account_number", "12345", False), ("email", "a@b.in", True), ("email", "a b@c.in", False),
        ("nonempty", " x ", False), ("address_pincode", "Mumbai 400070", True), ("address_pincode", "Mumbai 4000701", False),
    ]
    frame = spark.createDataFrame(rows, "validator string, value string, want boolean").withColumns(
        {"form_key": F.lit("k"), "date": text.day_first_date(F.col("value")), "today": F.lit("2026-01-01").cast("date")}
    )
    bad = frame.select("*", validators.rule_check().alias("c")).where("c.ok <> want").collect()
    assert bad == []


def test_age_is_whole_years_of_365_days(spark):
    frame = spark.createDataFrame([("dob", "02/01/2000", "dob")], "validator string, value string, form_key string").withColumns(
        {"date": text.day_first_date(F.col("value")), "today": F.lit("2026-01-01").cast("date")}
    )
    assert frame.select(validators.rule_check()["message"]).first()[0] == "Parsed as 02/01/2000 (approx age 26)"


UNREAD = {"full_name": "UNCERTAIN", "father_name": "UNCERTAIN", "dob": "UNCERTAIN", "address": "UNCERTAIN", "id_number": "UNCERTAIN", "confidence_notes": ""}
PASSBOOK = "STATE BANK OF INDIA\nAccount Holder: SANIKA CHAVAN\nA/C No: 12345678901\nAccount Opening Date: 12/03/2019\nAddress: Aurangabad Maharashtra"


def test_extraction(spark):
    read = {**UNREAD, "full_name": "SANIKA CHAVAN", "dob": "12/03/2019", "address": "Aurangabad Maharashtra", "id_number": "12345678901"}
    rows = [
        (0, "Driving License", "Driving Licence No: MH20 20190045678\nName: Sanika Chavan", UNREAD),
        (1, "Bank Passbook", PASSBOOK, read),
        (2, "Bank Passbook", PASSBOOK + "\nDate of Birth: 15/08/2001\n", read),
        (3, "Aadhaar Card", "Date of Issue 01/02/2011 then 15-08-2001", {**UNREAD, "full_name": "Mr. Shubham Vishnu Pitekar", "id_number": "482166349012"}),
        (4, "Aadhaar Card", "plain", {**UNREAD, "full_name": "Shubham Vishnu Pitekar", "id_number": "482166349012"}),
        (5, "Other", "nothing here", UNREAD),
    ]
    frame = spark.createDataFrame(rows, "case_id long, doc_type string, ocr_text string, fields map<string,string>")
    got = {r["case_id"]: r["fields"] for r in extraction.extract_fields(frame).collect()}
    assert got[0]["id_number"] == "MH20 20190045678" and got[0]["full_name"] == "Sanika Chavan"
    assert got[1]["dob"] == "UNCERTAIN" and got[1]["id_number"] == "12345678901" and "cleared dob" in got[1]["confidence_notes"]
    assert got[2]["dob"] == "15/08/2001"
    assert got[3]["dob"] == "UNCERTAIN" and got[3]["id_number"] == "4821 6634 9012" and got[3]["father_name"] == "Vishnu"
    assert got[4]["father_name"] == "Vishnu" and "inferred" in got[4]["confidence_notes"]
    assert got[5] == UNREAD


def test_handwriting_note(spark):
    rows = [(0, "Other", "text", True, UNREAD), (1, "Other", "text", True, {**UNREAD, "confidence_notes": "Handwritten."}), (2, "Other", "text", False, UNREAD)]
    frame = spark.createDataFrame(rows, "case_id long, doc_type string, ocr_text string, handwritten boolean, fields map<string,string>")
    got = {r["case_id"]: r["fields"]["confidence_notes"] for r in extraction.process_scans(frame).collect()}
    assert got == {0: "Handwritten/form source.", 1: "Handwritten.", 2: ""}


def test_json_text_in_document_order(spark):
    page = '{"blocks":[{"text":"a \\"quoted\\" line"},{"x":{"content":"b"}}],"note":"no","value":7,"markdown":"c\\nd"}'
    row = spark.createDataFrame([(page,), ("{}",)], "j string").select(readers.ocr_json_to_text(F.col("j"))).collect()
    assert [r[0] for r in row] == ['a "quoted" line\nb\nc\nd', ""]


def test_type_guesses(spark):
    files = spark.createDataFrame([("pan_card.jpg",), ("my_aadhaar.png",), ("dl_scan.jpg",), ("x.png",)], "file_name string")
    got = documents.guess_doc_type(files, F.array(F.lit("Driving License"))).collect()
    assert [r["doc_type"] for r in got] == ["PAN Card", "Aadhaar Card", "Driving License", "Driving License"]


def test_single_dialogue_turns(spark):
    full = {"full_name": "VALUE HERE", "father_name": "VALUE HERE", "dob": "VALUE HERE"}
    rows = [
        (0, "", {}, None), (1, "Sanika Santosh Chavan", {}, "full_name"), (2, "wrong", {"full_name": "SANIKA"}, "father_name"),
        (3, "Sa", {}, "full_name"), (4, "FINAL VALUE HERE", full, "new_address"), (5, "what documents", {}, None), (6, "I am done", full, None),
    ]
    frame = spark.createDataFrame(rows, "n int, transcript string, answers map<string,string>, active_field string").withColumn("service_id", F.lit("rto_dl_update"))
    got = {r["n"]: (r["action"], r["update_key"], r["update_value"], r["next_field"]) for r in dialogue.agent_turns(frame).collect()}
    assert got == {
        0: ("ask", None, None, "full_name"), 1: ("ask", "full_name", "SANIKA SANTOSH CHAVAN", "father_name"),
        2: ("ask", "full_name", "", "full_name"), 3: ("clarify", None, None, "full_name"),
        4: ("redirect", "new_address", "FINAL VALUE HERE", None), 5: ("answer", None, None, "full_name"),
        6: ("ask", None, None, "new_address"),
    }


def test_spoken_values(spark):
    rows = [
        ("Mera naam Sanika hai", "full_name", "SANIKA"), ("S A N I K A", "full_name", "SANIKA"), ("s-a-n-i", "full_name", "SANI"),
        ("+91 98765 43210 please", "mobile", "+919876543210"), ("A.B @ Example.com", "email", "a.b@example.com"),
        ("I am a woman", "gender", "FEMALE"), ("boy", "gender", "MALE"), ("trans", "gender", "OTHER"),
    ]
    frame = spark.createDataFrame(rows, "t string, k string, want string").withColumn("got", spoken.form_value(F.col("t"), F.col("k")))
    assert frame.where("got <> want OR got IS NULL").collect() == []


def test_yes_and_no(spark):
    rows = [("haan, theek hai", "yes"), ("no, yes", "no"), ("kya", None), ("OK.", "yes")]
    frame = spark.createDataFrame(rows, "t string, want string").withColumn("got", spoken.yes_or_no(F.col("t")))
    assert frame.where("NOT got <=> want").collect() == []


def test_patches_keep_the_last_non_null(spark):
    ts = datetime.datetime
    rows = [(1, ts(2024, 1, 2), 5, "b", None), (1, ts(2024, 1, 1), 4, "a", 3), (1, ts(2024, 1, 2), 6, None, None), (9, ts(2024, 1, 1), 1, "x", 1)]
    rows = [(r[0], "u1", *r[1:]) for r in rows] + [(1, "stranger", ts(2024, 6, 1), 9, "theirs", 7), (2, None, ts(2024, 6, 1), 10, "theirs", 7)]
    patches = spark.createDataFrame(rows, "case_id long, user_id string, ts timestamp, patch_id long, notes string, step int")
    base = spark.createDataFrame([(1, "u1", "", 0), (2, "u1", "old", 1)], "case_id long, user_id string, notes string, step int").withColumn(
        "updated_at", F.lit("2023-01-01").cast("timestamp")
    )
    got = {r["case_id"]: (r["notes"], r["step"], r["updated_at"].year) for r in cases.apply_case_patches(base, patches).collect()}
    assert got == {1: ("b", 3, 2024), 2: ("old", 1, 2023)}


def test_repeated_keys_and_whole_values(spark):
    from milaan.operators import extraction

    rows = spark.createDataFrame([('{"full_name":"A B","full_name":"C D","dob":"x"}',), ("no json " + "y" * 300,)], "raw string")
    got = extraction.parse_model_replies(rows).collect()
    assert (got[0]["full_name"], got[0]["dob"]) == ("C D", "x") and got[1]["confidence_notes"].endswith("y" * 300 + "'")


def test_catalogue_holds_every_reason(spark):
    from milaan.catalogue import dims

    counts = {r["service_id"]: r["count"] for r in dims.rejection_reasons(spark).groupBy("service_id").count().collect()}
    assert sum(counts.values()) == 67 and len(counts) == 15 and min(counts.values()) >= 3
    first = dims.rejection_reasons(spark).where("service_id = 'pan_new_49a' AND ord = 0").first()["reason"]
    assert first == "Name on Form 49A does not exactly match POI/POA/PODB"


def test_recent_cases_follow_the_callers_limit(spark):
    rows = [(i, "u", i) for i in range(120)]
    frame = spark.createDataFrame(rows, "case_id long, user_id string, updated_at long")
    assert cases.recent_cases(frame, 100).count() == 100


def test_side_by_side_keeps_every_type(spark):
    from milaan.operators import documents

    rows = [(1, 0, "PAN Card", {"full_name": "A"}), (1, 1, "Electricity Bill", {"full_name": "B"}), (1, 2, None, {"full_name": "C"})]
    docs = spark.createDataFrame(rows, "case_id long, doc_ord int, doc_type string, fields map<string,string>")
    got = documents.side_by_side(docs, ["PAN Card"]).where("field = 'full_name'").first()
    assert (got["PAN Card"], got["Other"]) == ("A", "C; Electricity Bill: B")
    assert documents.side_by_side_rows(docs).where("field = 'full_name'").count() == 3


def test_desk_check_visits_the_last_preferred_document(spark):
    """Of two Aadhaar cards only the later one is asked, first of all; alone it is asked even when unreadable."""
    from milaan.operators import views

    forms = spark.createDataFrame([(c, "passport_apply", {"full_name": "Sanika Chavan"}) for c in range(1, 6)], "case_id long, service_id string, answers map<string,string>")
    ddl = "case_id long, doc_ord long, doc_type string, source_file string, fields map<string,string>"
    rows = [
        (1, 0, "Aadhaar Card", "a", {"full_name": "Sanika Chavan"}), (1, 1, "Aadhaar Card", "b", {"full_name": "Ravi Kumar"}),
        (2, 0, "Aadhaar Card", "a", {"full_name": "Ravi Kumar"}), (2, 1, "PAN Card", "p", {"full_name": "Sanika Chavan"}), (2, 2, "Aadhaar Card", "b", {"full_name": "Sanika Chavan"}),
        (3, 0, "Aadhaar Card", "a", {"full_name": "Sanika Chavan"}), (3, 1, "Aadhaar Card", "b", {"full_name": "UNCERTAIN"}),
        (4, 0, "Aadhaar Card", "a", {"full_name": "Sanika Chavan"}), (4, 1, "Aadhaar Card", "b", {}), (4, 2, "PAN Card", "p", {"full_name": "Ravi Kumar"}),
        (5, 0, "PAN Card", "p", {"full_name": "Ravi Kumar"}), (5, 1, "PAN Card", "q", {"full_name": "Sanika Chavan"}),
    ]
    checks = views.form_checks_desk(forms, spark.createDataFrame(rows, ddl)).where("form_key = 'full_name'")
    got = {r["case_id"]: (r["doc_type"], r["doc_value"], r["status"]) for r in checks.collect()}
    assert got == {
        1: ("Aadhaar Card", "Ravi Kumar", "CRITICAL"), 2: ("Aadhaar Card", "Sanika Chavan", "MATCH"), 3: ("Aadhaar Card", "UNCERTAIN", "UNCERTAIN"),
        4: ("PAN Card", "Ravi Kumar", "CRITICAL"), 5: ("PAN Card", "Sanika Chavan", "MATCH"),
    }


def test_compatibility_forms_of_names(spark):
    """Every single sign, and words with marks, fold as the Unicode data say; ASCII and nulls stay."""
    import unicodedata

    signs = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x30000)] if unicodedata.category(chr(c)) != "Cn"]
    words = ["ﬁlomena", "①②", "ｶﾞﾊﾟ", "José Nũez", "Ｒａｖｉ　Ｋｕｍａｒ", "ậ", "क़मर", "ऩ", "½", "", "Dr. Ravi", "㎏ℌ𝔸"]
    rows = spark.createDataFrame([(x,) for x in signs + words], "x string").select("x", text.compatible(F.col("x")).alias("y"))
    assert [(r["x"], r["y"]) for r in rows.collect() if r["y"] != unicodedata.normalize("NFKC", r["x"])] == []
    assert spark.createDataFrame([(None,)], "x string").select(text.compatible(F.col("x"))).first()[0] is None
    names = spark.createDataFrame([("Ｄｒ．ﬁlomena", "FILOMENA"), ("José", "josé")], "a string, b string")
    assert all(a == b for a, b in names.select(text.view_name(F.col("a")), text.view_name(F.col("b"))).collect())
