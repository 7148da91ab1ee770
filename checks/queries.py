"""Check SQL for the registered queries, by query name."""

from __future__ import annotations

from checks import ctes as c
from milaan.catalogue import facts
from milaan.plans.registry import SPOKEN_KEYS
from milaan.sources import bridge

_PLAIN = "concat('{\"full_name\": \"', full_name, '\", \"dob\": \"', dob, '\", \"id_number\": ', doc_ord, ', \"address\": \" \", \"confidence_notes\": \"seen\"}')"
_OCR = bridge.OCR_TEXT
_SPOKEN_KEYS = ", ".join(f"({c.q(k)})" for k in SPOKEN_KEYS)
_SPOKEN = f"""(SELECT conv_id, turn, field_key, trim({c.spoken_block('trim(said)', 'field_key')}) AS value
    FROM heard, (VALUES {_SPOKEN_KEYS}) ks(field_key))"""
_GUESS = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(name, {c.q(k)})" for k in facts.items(keys)) + f" THEN {c.q(doc)}"
    for keys, doc in facts.rows(facts.FILE_NAME_RULES)
)
_GUESS_BARE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(name, {c.q(k)})" for k in facts.items(keys)) + f" THEN {c.q(doc)}"
    for keys, doc in facts.rows(facts.FILE_NAME_RULES)[:-1]
)
_FALLBACK = "WHEN case_id % 2 = 0 THEN 'Voter ID' ELSE 'Other' END"
_CARD = """(SELECT r.case_id, r.form_key, l.doc_ord, r.compare_to AS field, r.form_value AS value_a, l.value AS value_b FROM form_rows r
    JOIN long_all l ON l.case_id = r.case_id AND l.field = r.compare_to WHERE r.compare_to IS NOT NULL)"""

_DOC_TEXT = "concat_ws('; ', " + ", ".join(f"'{f}=' || d.{f}" for f in sorted(bridge.DOC_FIELDS)) + ")"


def _parts(alias: str) -> str:
    out = []
    for s in "ab":
        v = f"{alias}.value_{s}"
        out.append(f"{c.tokens(v)} AS t{s}, {c.day_first(v)} AS d{s}, {c.address_set(v)} AS s{s}")
    return ", ".join(out)


_STATUS, _DETAIL = c.verdict_case("field", "value_a", "value_b", "ta", "tb", "da", "db", "sa", "sb")
_PRIORITY = "CASE {0} " + " ".join(f"WHEN {c.q(d)} THEN {p}" for d, p in facts.DOC_PRIORITY.items()) + " ELSE 50 END"
_LATIN = "regexp_replace({0}, '[^\\x00-\\xFF]', '?', 'g')"
_ROUTE = f"""(SELECT f.case_id, f.service_id, p.primary_doc, coalesce(p.blocker_count, 0) AS blocker_count,
    CASE WHEN p.primary_doc IS NULL THEN s.portal_name ELSE coalesce(r.portal, o.portal) END AS portal_name,
    CASE WHEN p.primary_doc IS NULL THEN s.portal_url ELSE coalesce(r.url, o.url) END AS portal_url,
    CASE WHEN p.primary_doc IS NULL THEN {c.q(facts.NO_BLOCKER_HOW)} ELSE coalesce(r.how, o.how) END AS how
    FROM forms f JOIN services s USING (service_id) LEFT JOIN primary_docs p ON p.case_id = f.case_id
    LEFT JOIN portals r ON r.doc_type = p.primary_doc LEFT JOIN portals o ON o.doc_type = 'Other')"""
_VERDICTS = f"""SELECT s.case_id, s.service_id, coalesce(m.matches, 0) AS matches, coalesce(m.variants, 0) AS variants,
    coalesce(m.blockers, 0) AS blockers, coalesce(m.uncertain, 0) AS uncertain, s.score, s.grade, s.ready_for_portal,
    r.primary_doc, r.blocker_count, r.portal_name FROM scores s JOIN {_ROUTE} r USING (case_id) LEFT JOIN summary m ON m.case_id = s.case_id"""
_PATCH_LAST = ", ".join(
    f"arg_max({n}, ts) FILTER ({n} IS NOT NULL) AS {n}" for n in bridge.PATCH_COLUMNS
)
_FILES = f"""SELECT case_id, source_file AS file, doc_type, CASE WHEN case_id % 20 = 0 AND doc_ord = 2
    THEN 'Could not digitize ' || source_file || ' as ' || doc_type END AS error FROM docs"""


def _ocr_fields() -> str:
    """Field extraction over the derived scans, written for the layouts they have."""
    given = {k: v for k, v in bridge.GIVEN_FIELDS.items()}
    unread = {f: f"NOT {c.readable('g_' + f)}" for f in ("full_name", "dob", "address", "id_number")}
    name = "regexp_extract(ocr, '(?i)(?:Name|नाम|Account Holder|Customer Name|Holder Name)\\s*[:\\-]?\\s*([A-Za-z][A-Za-z.\\s]{2,60})', 1)"
    titled = "regexp_extract(ocr, '(?i)(?:Shri|Smt|Mr|Mrs)\\s+([A-Za-z][A-Za-z.\\s]{2,50})', 1)"
    father = "regexp_extract(ocr, '(?i)(?:Father|Father''?s Name|S/O|D/O|C/O|W/O|पिता|पति)\\s*[:\\-/]?\\s*([A-Za-z][A-Za-z.\\s]{2,50})', 1)"
    address = "regexp_extract(ocr, '(?is)(?:Address|पता|Residential Address)\\s*[:\\-]?\\s*(.+?)(?:\\n\\n|\\n[A-Z][a-z]+:|VID|$)', 1)"
    label = "regexp_extract(ocr, '(?i)(?:Date\\s*of\\s*Birth|D\\.?\\s*O\\.?\\s*B\\.?)\\s*[:\\-]?\\s*(\\d{2}[/-]\\d{2}[/-]\\d{4})', 1)"
    bare = "regexp_extract(ocr, '\\b\\d{2}[/-]\\d{2}[/-]\\d{4}\\b')"

    def tidy(x):
        return f"trim({c.squeeze(x)}, ' .-')"

    def fit(x):
        t = tidy(x)
        return (f"CASE WHEN len(string_split({t}, ' ')) >= 2 AND NOT regexp_matches(lower({t}), "
                f"'government|india|authority|unique|identification') THEN {t} END")

    at = f"instr(ocr, {bare})"
    around = f"lower(substring(ocr, greatest(1, {at} - 24), {at} + 18 - greatest(1, {at} - 24)))"
    spaced = " || ' ' || ".join(f"regexp_extract(ocr, '\\b([2-9]\\d{{3}})[ -](\\d{{4}})[ -](\\d{{4}})\\b', {n})" for n in (1, 2, 3))
    scans = ", ".join(f"{sql} AS g_{k}" for k, sql in given.items())
    words = f"string_split({c.squeeze('full_name')}, ' ')"
    return f"""
    WITH scans AS (SELECT case_id, doc_ord, doc_type, {_OCR} AS ocr, {scans} FROM docs_base),
    one AS (SELECT *, CASE doc_type
            WHEN 'Aadhaar Card' THEN CASE WHEN regexp_matches(ocr, '\\b[2-9]\\d{{3}}[ -]\\d{{4}}[ -]\\d{{4}}\\b')
                    THEN {spaced}
                WHEN regexp_matches(regexp_replace(ocr, '\\s+', '', 'g'), '\\b[2-9]\\d{{11}}\\b')
                    THEN regexp_replace(regexp_extract(regexp_replace(ocr, '\\s+', '', 'g'), '\\b([2-9]\\d{{11}})\\b', 1), '(....)(....)(....)', '\\1 \\2 \\3') END
            WHEN 'PAN Card' THEN nullif(regexp_extract(upper(ocr), '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b'), '')
            WHEN 'Bank Passbook' THEN nullif(regexp_extract(ocr, 'A/C No: (\\d{{9,18}})', 1), '')
            WHEN 'Driving License' THEN nullif(regexp_replace(regexp_extract(upper(ocr), '\\b[A-Z]{{2}}[\\s-]?\\d{{2}}[\\s-]?\\d{{4}}[\\s-]?\\d{{7}}\\b'), '[\\s-]+', ' ', 'g'), '')
            END AS ocr_id, nullif(replace({label}, '-', '/'), '') AS labelled FROM scans),
    two AS (SELECT *, regexp_replace(g_id_number, '\\s', '', 'g') AS bare_id,
        CASE WHEN ocr_id IS NOT NULL THEN ocr_id
            WHEN doc_type = 'Aadhaar Card' AND NOT ({unread['id_number']}) AND regexp_full_match({c.digits('g_id_number')}, '[2-9][0-9]{{11}}')
            THEN regexp_replace({c.digits('g_id_number')}, '(....)(....)(....)', '\\1 \\2 \\3') ELSE g_id_number END AS id_number,
        CASE WHEN labelled IS NOT NULL THEN labelled WHEN doc_type = 'Bank Passbook' THEN 'UNCERTAIN'
            WHEN {unread['dob']} AND doc_type IN ('Aadhaar Card', 'PAN Card', 'Driving License') AND {bare} <> ''
                AND NOT contains({around}, 'issue') THEN replace({bare}, '-', '/') ELSE g_dob END AS dob,
        CASE WHEN {unread['full_name']} THEN coalesce({fit(name)}, {fit(titled)}, g_full_name) ELSE g_full_name END AS full_name,
        CASE WHEN doc_type = 'Bank Passbook' AND labelled IS NULL AND NOT ({unread['dob']})
            THEN CASE WHEN g_confidence_notes = '' THEN 'cleared dob — passbook opening/statement date ≠ birth date'
                ELSE g_confidence_notes || '; cleared dob — passbook opening/statement date ≠ birth date' END
            ELSE g_confidence_notes END AS notes,
        CASE WHEN {unread['address']} AND len({c.squeeze(address)}) > 10 THEN {c.squeeze(address)} ELSE g_address END AS address FROM one),
    three AS (SELECT *, CASE WHEN {father} <> '' THEN {tidy(father)}
            WHEN doc_type IN ('Aadhaar Card', 'PAN Card') AND {c.readable('full_name')} AND len({words}) >= 3
            THEN array_to_string({words}[2:-2], ' ') ELSE 'UNCERTAIN' END AS father_name,
        ({father} = '' AND doc_type IN ('Aadhaar Card', 'PAN Card') AND {c.readable('full_name')} AND len({words}) >= 3) AS inferred FROM two)
    SELECT case_id, doc_ord, doc_type, full_name, father_name, dob, address, id_number,
        CASE WHEN full_name <> g_full_name OR father_name <> 'UNCERTAIN' OR dob <> g_dob OR address <> g_address OR id_number <> g_id_number
                OR notes <> g_confidence_notes
            THEN trim(notes || ' Regex/OCR ID check. ' || concat_ws(' ', CASE WHEN ocr_id IS NOT NULL AND NOT ({unread['id_number']})
                AND bare_id <> regexp_replace(ocr_id, '\\s', '', 'g') THEN 'Overrode LLM id_number ''' || bare_id || ''' with OCR ''' || ocr_id || '''' END,
                CASE WHEN inferred THEN 'father_name inferred from middle of full_name (''' || father_name || ''')' END))
            ELSE notes END AS confidence_notes FROM three"""


_FORM_TEXT = """(SELECT case_id, service_id, 'APPLICATION FORM' || chr(10) || 'Phone: 9876543210' || chr(10) || string_agg(
        CASE WHEN (case_id + field_ord) % 3 = 0 THEN 'DL No ' || form_value
            ELSE label || CASE WHEN case_id % 2 = 0 THEN ': ' ELSE ' ' || chr(10) || '- ' END || form_value END, chr(10) ORDER BY field_ord)
        || chr(10) || 'DOB: 01/02/1990' || chr(10) || 'Reason: lost card' AS ocr FROM form_rows WHERE form_value <> '' GROUP BY ALL)"""


def _form_labels() -> str:
    from milaan.operators.extraction import FORM_PATTERNS

    own = "CASE form_key " + " ".join(f"WHEN '{k}' THEN regexp_extract(ocr, {c.q(p)}, 1)" for k, p in FORM_PATTERNS.items()) + " ELSE '' END"
    escaped = "regexp_replace(label, '([().+*?])', '\\\\\\1', 'g')"
    beside = f"trim({c.squeeze(f'''regexp_extract(ocr, '(?i)' || {escaped} || '\\s*[:\\-–]?\\s*(.+?)(?:\\n|$)', 1)''')}, ' .-_|')"
    return f"""(SELECT case_id, service_id, form_key, coalesce(nullif(beside, ''), nullif(own, '')) AS value FROM (
        SELECT t.case_id, t.service_id, f.form_key, CASE WHEN contains(upper({beside}), 'FORM-ONLY') THEN '' ELSE {beside} END AS beside,
            {c.squeeze(own)} AS own FROM {_FORM_TEXT} t JOIN form_fields f USING (service_id)))"""


def _replies() -> str:
    raw = f"""CASE case_id % 6 WHEN 0 THEN {_PLAIN} WHEN 1 THEN concat('```json', chr(10), {_PLAIN}, chr(10), '```')
        WHEN 2 THEN concat('Here you are: ', {_PLAIN}, ' hope it helps') WHEN 3 THEN concat('Sorry, I cannot read ', doc_type)
        WHEN 4 THEN '' ELSE concat('```', {_PLAIN}, '``` and {{') END"""
    js = "regexp_extract(raw, '(?s)\\{[^}]*\\}')"

    def field(name):
        return (f"CASE WHEN json_valid({js}) AND json_type({js}, '$.{name}') = 'VARCHAR' AND trim(json_extract_string({js}, '$.{name}')) <> '' "
                f"THEN json_extract_string({js}, '$.{name}') ELSE 'UNCERTAIN' END AS {name}")

    return f"""SELECT case_id, doc_ord, {', '.join(field(f) for f in ('full_name', 'father_name', 'dob', 'address', 'id_number'))},
        CASE WHEN raw = '' THEN 'Model returned empty content' WHEN {js} = '' THEN 'JSON parse failed; raw: ''' || raw || ''''
            ELSE json_extract_string({js}, '$.confidence_notes') END AS confidence_notes
        FROM (SELECT case_id, doc_ord, {raw} AS raw FROM docs)"""


# Offers in order of preference, then the given answer; the least of them is what stands in the form.
_PREFILL = f"""SELECT case_id, service_id, form_key, arg_min(value, place) AS value FROM (
    SELECT r.case_id, r.service_id, r.form_key, l.value, CASE WHEN l.doc_type = r.compare_doc THEN 0 ELSE 1000000 END
        + {_PRIORITY.format('l.doc_type')} * 10000 + l.doc_ord AS place
    FROM form_rows r JOIN long_all l ON l.case_id = r.case_id AND l.field = r.compare_to WHERE upper(trim(l.value)) NOT IN ('', 'UNCERTAIN')
    UNION ALL SELECT a.case_id, a.service_id, a.form_key, a.value, 100000000 FROM answers a JOIN form_fields f USING (service_id, form_key))
    GROUP BY ALL"""

_LINES = f"""
    SELECT f.case_id, 1 AS section, '0' AS place, 'Critical blockers: ' || coalesce(s.blockers, 0) || ' | Uncertain (manual review): '
        || coalesce(s.uncertain, 0) || ' | Harmless variants: ' || coalesce(s.variants, 0) AS line FROM forms f LEFT JOIN summary s USING (case_id)
    UNION ALL SELECT case_id, 2, '0', 'FIX FIRST: ' || primary_doc || ' (implicated in ' || blocker_count || ' critical mismatch(es)) Where: '
        || portal_name || '  ' || portal_url || ' How: ' || how FROM {_ROUTE} WHERE primary_doc IS NOT NULL
    UNION ALL SELECT case_id, 3, field_ord::VARCHAR, '[' || status || '] ' || label || ' Form: ''' || form_value || ''' | ' || coalesce(doc_type, '—')
        || ': ''' || coalesce(doc_value, '—') || ''' - ' || detail FROM checks
    UNION ALL SELECT f.case_id, 0, '0', (SELECT count(*) FROM id_docs d WHERE d.case_id = f.case_id) || ' documents reconciled | Service: ' || s.title
        FROM forms f JOIN services s USING (service_id)
    UNION ALL SELECT case_id, 4, doc_ord || '.0', doc_type || '  (' || coalesce(source_file, 'sample') || ')' FROM id_docs
    UNION ALL SELECT case_id, 4, doc_ord || '.' || (field_ord + 1), doc_type || ' ' || {c.LABEL.format('field')} || ': ' || value FROM long_all
    UNION ALL SELECT case_id, 5, CASE status WHEN 'CRITICAL' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END || '.' || ord_a || '.' || ord_b,
        '[' || status || '] ' || {c.LABEL.format('field')} || ': ' || doc_a || ' vs ' || doc_b || ' ''' || value_a || ''' vs ''' || value_b
        || ''' - ' || detail FROM comparisons WHERE status <> 'MATCH'
    UNION ALL SELECT case_id, 5, '0', 'All compared fields match across all documents.' FROM forms f
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.case_id = f.case_id AND p.status <> 'MATCH')"""

_GRADED = "count(*) AS cases, count(*) FILTER (grade = 'READY') AS ready, count(*) FILTER (grade = 'FIX_REQUIRED') AS fix_required, count(*) FILTER (grade = 'BLOCKED') AS blocked"
_DESK_SCORES = """SELECT case_id, service_id, score, CASE WHEN conflict OR lacking > 0 THEN CASE WHEN score < 60 THEN 'BLOCKED' ELSE 'FIX_REQUIRED' END
    WHEN unsure THEN CASE WHEN score < 85 THEN 'FIX_REQUIRED' ELSE 'READY' END WHEN score >= 80 THEN 'READY' ELSE 'FIX_REQUIRED' END AS grade FROM (
    SELECT k.case_id, k.service_id, k.conflict, k.unsure, d.lacking,
        floor(round(100 * (0.7 * k.m + 0.2 * d.docs_score + 0.1 * f.complete), 7) + 0.5)::INT AS score
    FROM (SELECT case_id, service_id, avg(CASE status WHEN 'MATCH' THEN 1 WHEN 'VARIANT' THEN 0.85 WHEN 'UNCERTAIN' THEN 0.4 ELSE 0 END) AS m,
            bool_or(status = 'CRITICAL') AS conflict, bool_or(status = 'UNCERTAIN') AS unsure FROM desk_checks GROUP BY ALL) k
    JOIN docs_scores d USING (case_id, service_id)
    JOIN (SELECT case_id, count(*) FILTER (form_value <> '') / count(*) AS complete FROM form_rows GROUP BY ALL) f USING (case_id))"""

_SELECTS: dict[str, str] = {
    "load_extractions": """SELECT case_id, doc_ord, doc_type, source_file, 'en-IN' AS language, full_name, id_number, gender FROM (
        SELECT * REPLACE (row_number() OVER (PARTITION BY case_id ORDER BY doc_ord) - 1 AS doc_ord) FROM docs)
        WHERE doc_type <> 'Scanned Application Form'""",
    "load_answers": "SELECT case_id, service_id, form_key, value FROM answers",
    "load_catalogue": """SELECT s.service_id, s.title, s.fill_mode, s.portal_name, k.cases, f.fields, f.high_stakes, f.compared, f.last_field,
        r.ruled_fields, r.validators, r.optional, d.required_docs, d.docs, x.reasons, x.last_reason, w.weight_sum FROM services s
        JOIN (SELECT service_id, count(*) AS cases FROM forms GROUP BY ALL) k USING (service_id)
        JOIN (SELECT service_id, count(*) AS fields, count(*) FILTER (high_stakes) AS high_stakes, count(compare_to) AS compared,
            arg_max(form_key, field_ord) AS last_field FROM form_fields GROUP BY ALL) f USING (service_id)
        JOIN (SELECT service_id, count(DISTINCT form_key) AS ruled_fields, count(validator) AS validators, count(DISTINCT form_key) FILTER (optional) AS optional
            FROM field_rules GROUP BY ALL) r USING (service_id)
        JOIN (SELECT service_id, count(*) FILTER (kind = 'required') AS required_docs, count(*) AS docs FROM service_docs GROUP BY ALL) d USING (service_id)
        JOIN (SELECT service_id, count(*) AS reasons, arg_max(reason, ord) AS last_reason FROM reasons GROUP BY ALL) x USING (service_id)
        JOIN (SELECT service_id, round(w_format + w_docs + w_match + w_complete + w_eligible, 6)::DOUBLE AS weight_sum FROM weights) w USING (service_id)""",
    "load_cases": """SELECT c_custkey::VARCHAR AS case_id, 'u' || (c_custkey % 20) AS user_id, (c_custkey % 5)::INT AS step,
        CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS age,
        CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n_docs, CASE WHEN c_custkey % 4 <> 0 THEN '14/06/1992' END AS dob,
        CASE WHEN c_custkey % 5 = 0 THEN 'READY' END AS grade, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS notes,
        c_custkey % 2 = 1 AS form_reviewed, FALSE AS ocr_reviewed, (1700000000500000 + c_custkey * 1000000)::BIGINT AS updated_us FROM customer""",
    "assemble_ocr_pages": """SELECT doc_id, ocr_text, CASE WHEN ocr_text IS NULL THEN 'Digitization returned no readable text' END AS error FROM (
        SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) FILTER (regexp_matches(line, '[^\\s]')) AS ocr_text FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY doc_id)""",
    "ocr_json_to_text": "SELECT conv_id, turn, text || chr(10) || role AS ocr_text FROM conversations",
    "write_result_pack": f"""SELECT s.case_id, s.service_id, 'head' AS kind, NULL::BIGINT AS doc_ord, v.portal_name AS portal, v.portal_url, round(s.score, 6) AS score,
        s.grade, a.answers, i.flags, NULL::VARCHAR AS doc_type, NULL::VARCHAR AS source_file, NULL::VARCHAR AS fields FROM scores s JOIN services v USING (service_id)
        LEFT JOIN (SELECT case_id, string_agg(form_key || '=' || value, '; ' ORDER BY form_key || '=' || value) AS answers FROM answers GROUP BY ALL) a ON a.case_id = s.case_id
        LEFT JOIN (SELECT case_id, string_agg(form_key || '/' || severity || '/' || message, '; ' ORDER BY form_key || '/' || severity || '/' || message) AS flags
            FROM issues WHERE severity <> 'OK' GROUP BY ALL) i ON i.case_id = s.case_id
        UNION ALL SELECT d.case_id, f.service_id, 'document', d.doc_ord, NULL, NULL, NULL, NULL, NULL, NULL, d.doc_type, d.source_file, {_DOC_TEXT}
        FROM id_docs d JOIN forms f USING (case_id)""",
    "audit_rows": f"SELECT case_id, section, place, {_LATIN.format('line')} AS line FROM ({_LINES})",
    "matrix_audit_rows": "SELECT case_id, field, doc_ord, status, CASE field "
    + " ".join(f"WHEN '{r[0]}' THEN {c.q(r[1])}" for r in facts.rows(facts.MATRIX_FIELDS))
    + " END || ' — ' || doc_type || ': ' || value AS line FROM cells WHERE status IN ('blocker', 'variant', 'uncertain') AND field <> 'id_number'",
    "filled_form_rows": f"""SELECT f.case_id, f.service_id, ff.field_ord, ff.form_key, {_LATIN.format('ff.label')} AS label,
        {_LATIN.format("upper(CASE WHEN coalesce(a.value, '') = '' THEN repeat('_', 16) ELSE a.value END)")} AS value
        FROM forms f JOIN form_fields ff USING (service_id) LEFT JOIN answers a ON a.case_id = f.case_id AND a.form_key = ff.form_key""",
    "extraction_failures": _FILES,
    "quarantine_stream": _FILES,
    "unpivot_fields": "SELECT case_id, doc_ord, doc_type, field, value FROM long_all",
    "readable_filter": f"SELECT case_id, doc_ord, doc_type, field, value FROM long_all WHERE {c.readable('value')}",
    "drop_form_docs": "SELECT case_id, doc_ord, doc_type, source_file FROM docs WHERE doc_type <> 'Scanned Application Form'",
    "service_answers_only": "SELECT a.case_id, a.service_id, a.form_key, a.value FROM answers a JOIN form_fields f USING (service_id, form_key)",
    "guess_doc_type": f"""SELECT case_id, doc_ord, file_name, {_GUESS} {_FALLBACK} AS guess, {_GUESS_BARE} {_FALLBACK} AS guess_without_forms
        FROM (SELECT case_id, doc_ord, source_file AS file_name, lower(replace(source_file, ' ', '')) AS name FROM docs)""",
    "dedupe_uploads": """SELECT DISTINCT case_id, source_file AS file_name, (1000 + case_id * 7 + CASE WHEN a = 2 AND case_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS size
        FROM docs, (VALUES (0), (1), (2)) t(a)""",
    "standardize": f"""SELECT field, value, count(*) AS uses, {c.clean('value')} AS clean, {c.standard_text('field', 'value')} AS std
        FROM long_docs GROUP BY ALL""",
    "alias_canon": f"""SELECT w.word, first(w.word2) AS canonical, count(DISTINCT (u.case_id, u.doc_ord, u.field, u.n)) AS uses FROM (
            SELECT a.word, b.word AS word2, row_number() OVER (PARTITION BY a.word ORDER BY len(b.word) DESC, b.word) AS r FROM
            ({c.values_table([(n, x) for n, line in enumerate(facts.SPELLING_GROUPS.strip().splitlines()) for x in line.split()], 'g', 'word')}) a
            JOIN ({c.values_table([(n, x) for n, line in enumerate(facts.SPELLING_GROUPS.strip().splitlines()) for x in line.split()], 'g', 'word')}) b USING (g)) w
        JOIN (SELECT case_id, doc_ord, field, unnest(string_split_regex({c.clean('value')}, '\\s+')) AS word,
            generate_subscripts(string_split_regex({c.clean('value')}, '\\s+'), 1) AS n FROM long_all WHERE field IN ('full_name', 'father_name')) u
            ON u.word = w.word WHERE w.r = 1 GROUP BY w.word""",
    "std_view": f"""SELECT case_id, doc_ord, {c.view_name('full_name')} AS name, {c.view_key('dob')} AS dob_key, {c.view_year('dob')} AS dob_year,
        array_to_string(list_sort({c.view_words('address', facts.VIEW_ADDRESS_STOPWORDS)}), ' ') AS address FROM id_docs""",
    "std_gender": f"""SELECT case_id, doc_ord, gender, CASE WHEN g IN {c.in_list(facts.MALE_WORDS)} THEN 'M' WHEN g IN {c.in_list(facts.FEMALE_WORDS)}
        THEN 'F' ELSE g END AS gender_class FROM (SELECT *, lower(replace(trim(gender), '.', '')) AS g FROM id_docs)""",
    "std_spoken": f"SELECT conv_id, turn, field_key, value FROM {_SPOKEN}",
    "std_ocr_noise": """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\n{3,}', chr(10) || chr(10), 'g')
        || chr(10) || chr(10) || 'seal:' AS ocr_text FROM documents""",
    "extract_fields": "SELECT * FROM (" + _ocr_fields().replace("docs_base", "docs") + ")",
    "process_scans": "SELECT * REPLACE (CASE WHEN case_id % 3 = 0 AND NOT contains(lower(coalesce(confidence_notes, '')), 'handwrit') "
    "THEN trim(coalesce(confidence_notes, '') || ' Handwritten/form source.') ELSE confidence_notes END AS confidence_notes) FROM ("
    + _ocr_fields().replace("docs_base", "docs") + ")",
    "ext_form_labels": f"SELECT * FROM {_form_labels()}",
    "merge_form_answers": f"""SELECT l.case_id, l.service_id, l.form_key, CASE WHEN l.case_id % 3 = 0 AND {c.readable('r.form_value')}
        THEN trim(r.form_value) ELSE coalesce(l.value, '') END AS value FROM {_form_labels()} l
        JOIN form_rows r ON r.case_id = l.case_id AND r.form_key = l.form_key""",
    "parse_model_replies": _replies(),
    "validate_answers": "SELECT case_id, service_id, form_key, validator, optional, value, outcome, message FROM validated",
    "val_required": """SELECT service_id, form_key, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'skipped') AS skipped,
        count(*) FILTER (value <> '') AS filled FROM validated GROUP BY ALL""",
    "val_spoken": f"SELECT conv_id, turn, field_key, {c.spoken_problem('field_key', 'value')} AS problem FROM {_SPOKEN}",
    "val_passport": f"""SELECT case_id, {c.validator_case("'passport'", 'v', "'x'")[0]} AS ok, {c.validator_case("'passport'", 'v', "'x'")[1]} AS message
        FROM (SELECT f.case_id, coalesce(a.value, '') AS v FROM forms f LEFT JOIN answers a ON a.case_id = f.case_id AND a.form_key = 'old_passport_number')""",
    "validator_scorecard": """SELECT service_id, form_key, validator, count(*) FILTER (outcome = 'ok') AS passed, count(*) FILTER (outcome = 'fail') AS failed,
        round(count(*) FILTER (outcome = 'ok') / count(*), 6) AS pass_rate FROM validated WHERE outcome IN ('ok', 'fail') GROUP BY ALL""",
    "classify_pairs": f"""SELECT field, value_a, value_b, uses, {_STATUS} AS status, {_DETAIL} AS detail FROM (
        SELECT x.*, {_parts('x')} FROM (SELECT field, value_a, value_b, count(*) AS uses FROM {_CARD} GROUP BY ALL) x)""",
    "classify_pairs_desk": f"SELECT case_id, form_key, doc_ord, field, value_a, value_b, {c.desk_status('field', 'value_a', 'value_b')} AS status FROM {_CARD}",
    "classify_pairs_matrix": f"SELECT case_id, form_key, doc_ord, field, value_a, value_b, {c.matrix_status('field', 'value_a', 'value_b', 'FALSE')} AS status FROM {_CARD}",
    "cross_doc_pairs": "SELECT case_id, field, doc_a, doc_b, value_a, value_b, status, detail, n_pairs, ord_a, ord_b FROM comparisons",
    "cross_doc_pairs_desk": "SELECT case_id, field, doc_a, doc_b, value_a, value_b, status, count(*) AS n_pairs FROM desk_pairs GROUP BY ALL",
    "matrix_vs_reference": "SELECT case_id, field, doc_ord, doc_type, value, status FROM cells",
    "majority_vote": "SELECT case_id, field, doc_a, doc_b, value_a, value_b, count(*) AS n_pairs, votes_a, votes_b FROM voted GROUP BY ALL",
    "form_vs_docs": """SELECT case_id, service_id, form_key, label, CASE WHEN form_value = '' THEN '—' ELSE form_value END AS form_value, doc_type,
        value_b AS doc_value, status, detail, count(*) AS n_docs FROM form_pairs GROUP BY ALL""",
    "form_vs_docs_desk": "SELECT case_id, service_id, form_key, form_value, doc_type, doc_value, status FROM desk_checks",
    "unmatched_form_fields": "SELECT case_id, service_id, form_key, form_value, status, detail FROM checks WHERE doc_type IS NULL",
    "carry_forward": "SELECT case_id, service_id, form_key, form_value AS value FROM form_rows WHERE compare_to IS NULL AND form_value <> ''",
    "missing_required_docs": "SELECT case_id, service_id, doc_type, ord FROM missing_docs",
    "answers_with_rules": "SELECT case_id, service_id, form_key, validator, optional, value FROM rule_rows",
    "remediation_route": f"SELECT * FROM {_ROUTE}",
    "service_lookup": """SELECT f.case_id, CASE WHEN f.case_id % 16 = 7 THEN 'no_such_service' ELSE f.service_id END AS service_id, s.title, s.portal_name,
        CASE WHEN s.title IS NULL THEN 'rejected' ELSE 'known' END AS outcome FROM forms f
        LEFT JOIN services s ON s.service_id = f.service_id AND f.case_id % 16 <> 7""",
    "scheme_match": "SELECT case_id, service_id, scheme_name, matched FROM scheme",
    "other_doc_values": """SELECT a.case_id, a.field, a.doc_type, a.value, b.doc_type AS other_doc, b.value AS other_value,
        count(DISTINCT b.doc_ord) - CASE WHEN a.doc_type = b.doc_type AND a.value = b.value THEN 1 ELSE 0 END AS n_docs
        FROM long_docs a JOIN long_docs b ON a.case_id = b.case_id AND a.field = b.field
        GROUP BY a.case_id, a.field, a.doc_type, a.value, b.doc_type, b.value
        HAVING NOT (a.doc_type = b.doc_type AND a.value = b.value AND count(DISTINCT b.doc_ord) = 1)""",
    "other_sources": """SELECT p.case_id, p.service_id, p.form_key, p.doc_type || ': ' || p.value_b AS source, count(*) AS n_docs
        FROM form_pairs p JOIN best_pairs b ON b.case_id = p.case_id AND b.form_key = p.form_key WHERE p.doc_type <> b.doc_type GROUP BY ALL""",
    "verdict_summary": "SELECT * FROM summary",
    "matrix_summary": """SELECT case_id, count(*) FILTER (status = 'match') AS matches, count(*) FILTER (status = 'variant') AS variants,
        count(*) FILTER (status = 'blocker') AS blockers, count(*) FILTER (status = 'uncertain') AS uncertain FROM cells GROUP BY ALL""",
    "verdict_by_field": "SELECT case_id, field, status, count(*) AS pairs FROM pairs GROUP BY ALL",
    "blocker_counts": "SELECT case_id, doc_type, blockers FROM blockers",
    "blocker_counts_desk": """SELECT case_id, CASE WHEN contains(doc_a, 'Aadhaar') THEN doc_b WHEN contains(doc_b, 'Aadhaar') THEN doc_a ELSE doc_b END AS doc_type,
        count(*) AS blockers FROM desk_pairs WHERE status = 'CRITICAL' GROUP BY ALL""",
    "matrix_blockers": "SELECT case_id, doc_ord, doc_type, count(*) AS blockers FROM cells WHERE status = 'blocker' GROUP BY ALL",
    "uncertain_count": "SELECT case_id, count(*) FILTER (upper(trim(value)) IN ('', 'UNCERTAIN')) AS uncertain FROM long_all GROUP BY ALL",
    "readable_of_five": "SELECT case_id, doc_ord, doc_type, count(*) FILTER (upper(value) NOT IN ('', 'UNCERTAIN'))::INT AS readable FROM long_all GROUP BY ALL",
    "format_score": "SELECT case_id, service_id, round(format_score, 6) AS format_score FROM rule_scores",
    "completeness": "SELECT case_id, service_id, round(completeness, 6) AS completeness FROM rule_scores",
    "docs_score": "SELECT case_id, service_id, round(docs_score, 6) AS docs_score FROM docs_scores",
    "match_score": "SELECT case_id, service_id, round(match_score, 6) AS match_score, form_blockers, form_uncertain FROM match_scores",
    "eligibility_hint": "SELECT case_id, service_id, round(eligibility_score, 6) AS eligibility_score, risk FROM eligible",
    "case_score": """SELECT case_id, service_id, score, round(format_score, 6) AS format_score, round(docs_score, 6) AS docs_score,
        round(match_score, 6) AS match_score, round(completeness, 6) AS completeness, round(eligibility_score, 6)::DOUBLE AS eligibility_score FROM scores""",
    "case_score_desk": _DESK_SCORES,
    "case_grade": "SELECT case_id, service_id, grade FROM scores",
    "ready_for_portal": "SELECT case_id, service_id, ready_for_portal FROM scores",
    "field_issues": "SELECT case_id, service_id, form_key, severity, message FROM issues",
    "rejection_risks": "SELECT case_id, service_id, (row_number() OVER (PARTITION BY case_id ORDER BY ord) - 1)::INT AS ord, risk FROM risks",
    "approved_fields": "SELECT case_id, service_id, form_key, value FROM approved",
    "doc_ocr_pct": "SELECT case_id, doc_ord, doc_type, ocr_readable::INT AS ocr_readable, ocr_expected::INT AS ocr_expected, ocr_pct FROM ocr_pct",
    "doc_verify_pct": "SELECT * FROM verify_pct",
    "doc_overall_pct": "SELECT case_id, doc_ord, doc_type, ocr_pct, verify_pct, overall_pct FROM accuracy",
    "case_overall_pct": "SELECT case_id, floor(avg(overall_pct) + 0.5)::INT AS accuracy_pct FROM accuracy GROUP BY ALL",
    "case_impact": """SELECT s.case_id, s.service_id, coalesce(m.blockers, 0) + s.form_blockers AS caught, coalesce(m.variants, 0) AS variants,
        greatest(8, 4 + 3 * (coalesce(m.blockers, 0) + s.form_blockers) + coalesce(m.variants, 0)) AS minutes_saved,
        s.ready_for_portal AND coalesce(m.blockers, 0) + s.form_blockers = 0 AS ready FROM scores s LEFT JOIN summary m USING (case_id)""",
    "form_complete": """SELECT case_id, service_id, coalesce(bool_and(form_value <> '') FILTER (high_stakes), bool_and(form_value <> '')) AS complete
        FROM form_rows GROUP BY ALL""",
    "cases_by_mode": f"""SELECT fill_mode, service_id, {_GRADED}, round(count(*) FILTER (grade = 'READY') / count(*), 6) AS ready_rate
        FROM scores JOIN services USING (service_id) GROUP BY ROLLUP (fill_mode, service_id)""",
    "side_by_side": """SELECT case_id, field, arg_min(value, doc_ord) FILTER (doc_type = 'Aadhaar Card') AS aadhaar,
        arg_min(value, doc_ord) FILTER (doc_type = 'PAN Card') AS pan, arg_min(value, doc_ord) FILTER (doc_type = 'Driving License') AS licence,
        'Bank Passbook: ' || arg_min(value, doc_ord) FILTER (doc_type = 'Bank Passbook') AS other FROM long_all GROUP BY ALL""",
    "side_by_side_rows": "SELECT case_id, field, doc_type, arg_min(value, doc_ord) AS value FROM long_all GROUP BY ALL",
    "primary_blocker": "SELECT case_id, primary_doc, blocker_count FROM primary_docs",
    "primary_blocker_matrix": f"""SELECT case_id, doc_ord, doc_type, n AS blockers FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY
            CASE WHEN n > 0 AND doc_type = 'PAN Card' THEN 0 ELSE 1 END, CASE WHEN n > 0 THEN 0 ELSE 1 END, n DESC, first_field, doc_ord) AS r FROM (
            SELECT case_id, doc_ord, doc_type, count(*) FILTER (status = 'blocker') AS n,
                min({c.MATRIX_ORD.format('field')}) FILTER (status = 'blocker') AS first_field FROM cells GROUP BY ALL)) WHERE r = 1""",
    "best_form_check": "SELECT case_id, service_id, form_key, form_value, doc_type, doc_value, status FROM checks",
    "check_detail": "SELECT case_id, form_key, detail FROM checks",
    "best_readable_value": f"""SELECT case_id, field, doc_type, trim(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY
        CASE WHEN field = 'address' AND doc_type = 'Bank Passbook' THEN -1 ELSE {_PRIORITY.format('doc_type')} END, doc_ord) AS r FROM long_docs) WHERE r = 1""",
    "prefill_form": _PREFILL,
    "reference_doc": "SELECT case_id, field, ref_ord, ref_doc, ref_value FROM refs",
    "next_empty_field": """SELECT case_id, service_id, arg_min(form_key, field_ord) FILTER (high_stakes AND form_value = '') AS next_field
        FROM form_rows GROUP BY ALL""",
    "recent_cases": """SELECT user_id, case_id, place, updated_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_us DESC, case_id)::INT AS place FROM (
        SELECT 'u' || (k.case_id % 10) AS user_id, k.case_id, epoch_us(coalesce(p.at, k.created_at)) AS updated_us FROM known k
        LEFT JOIN (SELECT case_id, max(ts) AS at FROM patches WHERE NOT foreign_ GROUP BY case_id) p USING (case_id))) WHERE place <= 5""",
    "findings_order": """SELECT case_id, CASE status WHEN 'CRITICAL' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END AS rank, ord_a, ord_b, field, status, n_pairs
        FROM comparisons WHERE status <> 'MATCH'""",
    "flag_board": f"""SELECT case_id, 0 AS source, severity, form_key AS title, message AS detail, 1::BIGINT AS times FROM issues WHERE severity IN ('FAIL', 'WARN')
        UNION ALL SELECT case_id, 1, status, label, detail, 1 FROM checks WHERE status IN ('CRITICAL', 'UNCERTAIN')
        UNION ALL SELECT case_id, 2, status, {c.LABEL.format('field')}, doc_a || ' vs ' || doc_b || ': ' || detail, n_pairs FROM comparisons WHERE status = 'CRITICAL'""",
    "all_blockers": """SELECT case_id, field, doc_a, doc_b, value_a, value_b, detail, n_pairs FROM comparisons WHERE status = 'CRITICAL'
        UNION ALL SELECT case_id, label, 'Form', doc_type, form_value, doc_value, detail, 1 FROM checks WHERE status = 'CRITICAL'""",
    "expected_docs": "SELECT f.case_id, f.service_id, d.doc_type, d.kind, d.ord FROM forms f JOIN service_docs d USING (service_id)",
    "review_split": """SELECT case_id, CASE WHEN status IN ('MATCH', 'VARIANT') THEN 'form_ok' ELSE 'form_risk' END AS bucket, form_key AS item, status, 1::BIGINT AS times FROM checks
        UNION ALL SELECT case_id, 'pair_variant', field || '/' || doc_a || '/' || doc_b, status, n_pairs FROM comparisons WHERE status IN ('VARIANT', 'UNCERTAIN')""",
    "apply_case_patches": f"""SELECT k.case_id, 'u' || (k.case_id % 10) AS user_id, p.service_id, p.citizen_label, coalesce(p.step, 0) AS step,
        coalesce(p.notes, '') AS notes, coalesce(p.form_reviewed, FALSE) AS form_reviewed, coalesce(p.status, 'draft') AS status,
        epoch_us(coalesce(p.at, k.created_at)) AS updated_us FROM known k
        LEFT JOIN (SELECT case_id, {_PATCH_LAST}, max(ts) AS at FROM patches WHERE NOT foreign_ GROUP BY case_id) p USING (case_id)""",
    "new_case_defaults": """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 ELSE 0 END::INT AS step, '{}' AS answers, '[]' AS extractions,
        '' AS notes, FALSE AS form_reviewed, FALSE AS ocr_reviewed, CASE WHEN c_custkey % 3 = 1 THEN 'open' ELSE 'draft' END AS status,
        '2026-01-01' AS created_at FROM customer""",
    "turn_outcomes": "SELECT * FROM outcomes",
    "form_fill_turns": """SELECT conv_id, service_id, update_key AS form_key, arg_max(update_value, turn) AS value FROM outcomes WHERE update_key IS NOT NULL
        GROUP BY ALL HAVING arg_max(update_value, turn) <> ''""",
    "turn_action_rates": """SELECT service_id, action, turns, round(turns / sum(turns) OVER (PARTITION BY service_id), 6) AS rate
        FROM (SELECT service_id, action, count(*) AS turns FROM outcomes GROUP BY ALL)""",
    "form_fill_stream": "SELECT * FROM outcomes",
    "yes_no_intent": f"""SELECT conv_id, turn, CASE WHEN len(list_intersect(w, {c.q(facts.NO_WORDS)})) > 0 THEN 'no'
        WHEN len(list_intersect(w, {c.q(facts.YES_WORDS)})) > 0 THEN 'yes' END AS intent FROM (
        SELECT conv_id, turn, string_split_regex(lower(regexp_replace(CASE turn % 4 WHEN 0 THEN concat('Haan, ', text)
            WHEN 1 THEN concat(text, ' theek. nahi') ELSE text END, '[,.]', ' ', 'g')), '\\s+') AS w FROM conversations)""",
    "dedupe_upload_stream": "SELECT DISTINCT user_id AS case_id, 'scan_' || event_type || '.jpg' AS file_name, event_id % 3 AS size FROM events",
    "agent_turns": """SELECT f.case_id, f.service_id, a.action, a.update_key, a.update_value, a.next_field FROM forms f JOIN agent a USING (case_id)""",
    "verify_stream": _VERDICTS,
    "verify": _VERDICTS,
}


def _agent() -> str:
    """Open fields by counting: the request's active field when empty, else the first empty required one."""
    said = "CASE case_id % 7 WHEN 0 THEN 'blank' WHEN 1 THEN 'clear' WHEN 2 THEN 'redo' WHEN 3 THEN 'done' WHEN 4 THEN 'documents' ELSE 'answer' END"
    value = c.spoken_block("'Sanika Chavan'", "target")
    return f"""SELECT case_id, CASE WHEN told IN ('blank', 'clear', 'redo') THEN 'ask' WHEN told = 'documents' THEN 'answer'
            WHEN told = 'done' THEN CASE WHEN open1 IS NULL THEN 'redirect' ELSE 'ask' END WHEN target IS NULL THEN 'redirect'
            WHEN problem IS NOT NULL THEN 'clarify' WHEN other IS NOT NULL THEN 'ask' ELSE 'redirect' END AS action,
        CASE WHEN told = 'answer' AND target IS NOT NULL AND problem IS NULL THEN target WHEN told = 'clear' THEN last_filled END AS update_key,
        CASE WHEN told = 'answer' AND target IS NOT NULL AND problem IS NULL THEN {value} WHEN told = 'clear' AND last_filled IS NOT NULL THEN '' END AS update_value,
        CASE WHEN told = 'clear' AND last_filled IS NOT NULL THEN last_filled WHEN told = 'done' THEN open1
            WHEN told = 'answer' AND target IS NOT NULL AND problem IS NULL THEN other ELSE target END AS next_field
        FROM (SELECT *, {c.spoken_problem('target', value)} AS problem,
            CASE WHEN target = open1 THEN open2 ELSE open1 END AS other FROM (
            SELECT case_id, told, opens[1] AS open1, opens[2] AS open2, last_filled,
                CASE WHEN name_open AND case_id % 3 = 0 THEN 'full_name' ELSE opens[1] END AS target FROM (
                SELECT case_id, {said} AS told, list(form_key ORDER BY field_ord) FILTER (high_stakes AND form_value = '') AS opens,
                    arg_max(form_key, field_ord) FILTER (form_value <> '') AS last_filled,
                    coalesce(bool_or(form_value = '') FILTER (form_key = 'full_name'), TRUE) AS name_open FROM form_rows GROUP BY case_id)))"""


c.CTES["agent"] = _agent()

ORACLE_SQL: dict[str, str] = {name: c.with_ctes(sql) for name, sql in _SELECTS.items()}
ORACLE_SQL["case_patch_stream"] = ORACLE_SQL["apply_case_patches"]
