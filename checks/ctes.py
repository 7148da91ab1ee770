"""Named SQL building blocks for the check queries, written for DuckDB.

They restate the results document by document and pair by pair (no value groups, no spreading), so they check the
reductions of the Spark jobs by brute force.
"""

from __future__ import annotations

import re
from itertools import groupby

from milaan.catalogue import dims, facts
from milaan.functions.text import canonical_spelling
from milaan.sources import bridge

TODAY = "DATE '2026-01-01'"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(q(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def values_table(rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


# --- text rules ----------------------------------------------------------------------------------------------------------

SENTINELS = "('UNCERTAIN', 'N/A', 'NA', '')"


def readable(x: str) -> str:
    return f"({x} IS NOT NULL AND upper(trim({x})) NOT IN {SENTINELS})"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))"


def _canon(w: str) -> str:
    groups: dict[str, list[str]] = {}
    for word, best in canonical_spelling().items():
        groups.setdefault(best, []).append(word)
    arms = " ".join(f"WHEN {w} IN {in_list(words)} THEN {q(best)}" for best, words in groups.items())
    return f"CASE {arms} ELSE {w} END"


def tokens(x: str) -> str:
    kept = f"list_filter(string_split_regex({clean(x)}, '\\s+'), lambda w: w <> '' AND w NOT IN {in_list(facts.HONORIFICS)})"
    return f"list_transform({kept}, lambda w: {_canon('w')})"


def address_set(x: str) -> str:
    kept = f"list_filter({tokens(x)}, lambda t: t NOT IN {in_list(facts.ADDRESS_STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+'))"
    return f"list_distinct({kept})"


def day_first(x: str) -> str:
    return f"""CASE
        WHEN regexp_matches({x}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
            THEN try_strptime(regexp_extract({x}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}'), '%Y-%m-%d')
        WHEN regexp_matches({x}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}')
            THEN try_strptime(replace(regexp_extract({x}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}'), '-', '/'), '%d/%m/%Y')
        WHEN regexp_matches({x}, '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}}')
            THEN try_strptime(regexp_extract({x}, '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}}'), '%d %B %Y')
        END::DATE"""


def jw(a: str, b: str) -> str:
    return f"(jaro_winkler_similarity({a}, {b}) >= 0.88)"


def standard_text(field: str, value: str) -> str:
    return f"""CASE
        WHEN {field} IN ('full_name', 'father_name') THEN array_to_string({tokens(value)}, ' ')
        WHEN {field} = 'dob' THEN strftime({day_first(value)}, '%Y-%m-%d')
        WHEN {field} = 'address' THEN array_to_string(list_sort({address_set(value)}), ' ')
        WHEN {field} = 'id_number' THEN upper(regexp_replace({value}, '\\s', '', 'g'))
        ELSE {clean(value)} END"""


def verdict_case(f: str, a: str, b: str, ta: str, tb: str, da: str, db: str, sa: str, sb: str) -> tuple[str, str]:
    """(status, detail) as CASE texts over token lists t, dates d and address sets s."""
    small, big = f"(CASE WHEN len({ta}) < len({tb}) THEN {ta} ELSE {tb} END)", f"(CASE WHEN len({ta}) < len({tb}) THEN {tb} ELSE {ta} END)"
    sims = "list_transform(acc, lambda r: jaro_winkler_similarity(x[1], r))"
    at = f"list_position({sims}, list_max({sims}))"
    within = f"""(list_reduce(list_transform({small}, lambda t: [t]), lambda acc, x: CASE
        WHEN acc IS NULL OR list_max({sims}) < 0.88 THEN NULL
        ELSE list_concat(acc[1:{at} - 1], acc[{at} + 1:]) END, {big}) IS NOT NULL)"""
    zipped = f"list_zip({ta}, {tb})"
    initials = f"""(len({ta}) = len({tb}) AND len(list_filter({zipped}, lambda z: NOT (z[1] = z[2]
        OR (len(z[1]) = 1 AND starts_with(z[2], z[1])) OR (len(z[2]) = 1 AND starts_with(z[1], z[2]))))) = 0)"""
    weak = f"list_filter({zipped}, lambda z: NOT {jw('z[1]', 'z[2]')})"
    told = f"list_transform({weak}, lambda z: '''' || z[1] || ''' vs ''' || z[2] || '''')"
    overlap = f"(len(list_intersect({sa}, {sb})) / least(len({sa}), len({sb})))"
    same_words = f"({squeeze(clean(a))} = {squeeze(clean(b))})"
    rules = [
        (f"NOT ({readable(a)} AND {readable(b)})", "UNCERTAIN", "'Field unreadable or absent on one document — flagged for manual review'"),
    ]
    name = f"{f} IN ('full_name', 'father_name')"
    rules += [
        (f"{name} AND (len({ta}) = 0 OR len({tb}) = 0)", "UNCERTAIN", "'One name is empty after normalization'"),
        (f"{name} AND {ta} = {tb} AND {same_words}", "MATCH", "'Identical'"),
        (f"{name} AND {ta} = {tb}", "VARIANT", "'Same identity after honorific/transliteration normalization'"),
        (f"{name} AND {initials}", "VARIANT", "'Initials expand to the same name'"),
        (f"{name} AND list_sort({ta}) = list_sort({tb})", "VARIANT", "'Same tokens in different order'"),
        (f"{name} AND len({ta}) = len({tb}) AND len({weak}) = 0", "VARIANT", "'Phonetically equivalent spelling variants'"),
        (f"{name} AND len({ta}) = len({tb})", "CRITICAL", f"'Name tokens differ: ' || array_to_string({told}, ', ')"),
        (f"{name} AND {within}", "VARIANT", "'One document omits a middle/last name component'"),
        (name, "CRITICAL", f"'Names do not resolve to the same identity: ''' || {a} || ''' vs ''' || {b} || ''''"),
        (f"{f} = 'dob' AND ({da} IS NULL OR {db} IS NULL)", "UNCERTAIN", "'Could not parse one of the dates'"),
        (f"{f} = 'dob' AND {da} = {db} AND trim({a}) = trim({b})", "MATCH", "'Identical'"),
        (f"{f} = 'dob' AND {da} = {db}", "VARIANT", "'Same date, different format'"),
        (f"{f} = 'dob'", "CRITICAL", f"'Dates of birth differ: ' || strftime({da}, '%d/%m/%Y') || ' vs ' || strftime({db}, '%d/%m/%Y')"),
        (f"{f} = 'address' AND (len({sa}) = 0 OR len({sb}) = 0)", "UNCERTAIN", "'One address is empty after normalization'"),
        (f"{f} = 'address' AND {overlap} >= 0.8 AND {clean(a)} = {clean(b)}", "MATCH", "'Identical'"),
        (f"{f} = 'address' AND {overlap} >= 0.8", "VARIANT", "'Same locality, formatting differs'"),
        (f"{f} = 'address' AND {overlap} >= 0.4", "VARIANT", "'Partial overlap — likely same place described differently; verify manually'"),
        (f"{f} = 'address'", "CRITICAL", "'Addresses appear to be different places'"),
        (f"upper(regexp_replace({a}, '\\s', '', 'g')) = upper(regexp_replace({b}, '\\s', '', 'g'))", "MATCH", "'Identical'"),
    ]
    status = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in rules) + " ELSE 'CRITICAL' END"
    detail = "CASE " + " ".join(f"WHEN {c} THEN {d}" for c, _, d in rules) + " ELSE 'ID numbers differ' END"
    return status, detail


_STATUS, _DETAIL = verdict_case("field", "value_a", "value_b", "ta", "tb", "da", "db", "sa", "sb")

# --- view rules ------------------------------------------------------------------------------------------------------------


def view_name(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '(?i)\\b(" + "|".join(facts.VIEW_HONORIFICS) + ")\\b\\.?', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', ' ', 'g')"
    aliases = " ".join(f"WHEN w = {q(a)} THEN {q(b)}" for a, b in facts.rows(facts.VIEW_ALIASES))
    return f"array_to_string(list_transform(string_split(lower({squeeze(bare)}), ' '), lambda w: CASE {aliases} ELSE w END), ' ')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def view_key(x: str) -> str:
    return f"CASE WHEN {digits(x)} <> '' THEN {digits(x)} ELSE lower(trim({x})) END"


def view_year(x: str) -> str:
    d = digits(x)
    return f"""CASE WHEN len({d}) = 8 THEN
        CASE WHEN {d}[1:4]::INT > 1900 AND {d}[1:4]::INT < 2100 THEN {d}[1:4] ELSE {d}[5:8] END
        ELSE nullif(regexp_extract({x}, '(19|20)[0-9][0-9]'), '') END"""


def view_words(x: str, stop=()) -> str:
    no = f" AND w NOT IN {in_list(stop)}" if stop else ""
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2{no}))"


def share(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, least(len({a}), len({b}))))"


def names_alike(a: str, b: str) -> str:
    la, lb = (f"list_distinct(string_split({view_name(x)}, ' '))" for x in (a, b))
    return f"({share(la, lb)} >= 0.66)"


def desk_missing(x: str) -> str:
    return f"(coalesce({x}, '') = '' OR upper(trim({x})) IN ('UNCERTAIN', 'N/A', 'NA', '—', '-'))"


def desk_status(f: str, a: str, b: str) -> str:
    name = f"{f} IN ('full_name', 'father_name')"
    ya, yb = f"({view_year(a)})", f"({view_year(b)})"
    same_day = f"(({view_key(a)}) = ({view_key(b)}) OR {ya} IS NOT DISTINCT FROM {yb})"
    return f"""CASE WHEN {desk_missing(a)} OR {desk_missing(b)} THEN 'UNCERTAIN'
        WHEN {name} AND {view_name(a)} = {view_name(b)} THEN CASE WHEN trim({a}) = trim({b}) THEN 'MATCH' ELSE 'VARIANT' END
        WHEN {name} AND {names_alike(a, b)} THEN 'VARIANT'
        WHEN {name} THEN 'CRITICAL'
        WHEN {f} = 'dob' AND {ya} <> {yb} THEN 'CRITICAL'
        WHEN {f} = 'dob' AND {same_day} THEN CASE WHEN {digits(a)} = {digits(b)} THEN 'MATCH' ELSE 'VARIANT' END
        WHEN {f} = 'dob' THEN 'CRITICAL'
        WHEN {f} = 'address' THEN CASE WHEN {share(view_words(a), view_words(b))} >= 0.5 THEN 'VARIANT' ELSE 'CRITICAL' END
        WHEN {f} = 'id_number' THEN CASE WHEN regexp_replace({a}, '\\s', '', 'g') = regexp_replace({b}, '\\s', '', 'g') THEN 'MATCH' ELSE 'CRITICAL' END
        WHEN lower(trim({a})) = lower(trim({b})) THEN 'MATCH' ELSE 'CRITICAL' END"""


def matrix_status(f: str, a: str, b: str, unsure: str) -> str:
    name = f"{f} IN ('full_name', 'father_name')"
    ya, yb = f"({view_year(a)})", f"({view_year(b)})"
    stop = facts.VIEW_ADDRESS_STOPWORDS
    ga, gb = (f"lower(replace(trim({x}), '.', ''))" for x in (a, b))
    male, female = in_list(facts.MALE_WORDS), in_list(facts.FEMALE_WORDS)
    return f"""CASE WHEN {unsure} THEN 'uncertain' WHEN {a} = '' OR {b} = '' THEN 'missing'
        WHEN {name} AND {view_name(a)} = {view_name(b)} THEN CASE WHEN trim({a}) = trim({b}) THEN 'match' ELSE 'variant' END
        WHEN {name} THEN CASE WHEN {names_alike(a, b)} THEN 'variant' ELSE 'blocker' END
        WHEN {f} = 'dob' AND {ya} <> {yb} THEN 'blocker'
        WHEN {f} = 'dob' AND (({view_key(a)}) = ({view_key(b)}) OR replace({a}, ' ', '') = replace({b}, ' ', '')) THEN 'match'
        WHEN {f} = 'dob' THEN CASE WHEN {ya} = {yb} THEN 'variant' ELSE 'blocker' END
        WHEN {f} = 'gender' AND {ga} = {gb} THEN 'match'
        WHEN {f} = 'gender' THEN CASE WHEN ({ga} IN {male} AND {gb} IN {male}) OR ({ga} IN {female} AND {gb} IN {female})
            THEN 'variant' ELSE 'blocker' END
        WHEN {f} = 'address' THEN CASE WHEN {share(view_words(a, stop), view_words(b, stop))} >= 0.5 THEN 'variant' ELSE 'blocker' END
        WHEN {f} = 'id_number' THEN 'match'
        WHEN lower(trim({a})) = lower(trim({b})) THEN 'match' ELSE 'blocker' END"""


# --- validators ------------------------------------------------------------------------------------------------------------


def validator_case(name: str, v: str, key: str) -> tuple[str, str]:
    d = f"regexp_replace({v}, '\\D', '', 'g')"
    m = f"(CASE WHEN len({d}) = 12 AND starts_with({d}, '91') THEN {d}[3:] ELSE {d} END)"
    u = f"upper(regexp_replace({v}, '\\s', '', 'g'))"
    n = f"upper(regexp_replace({v}, '[\\s-]', '', 'g'))"
    dt = f"({day_first(v)})"
    rules = [
        ("aadhaar", f"len({d}) <> 12", False, f"'Aadhaar must be exactly 12 digits (got ' || len({d}) || ')'"),
        ("aadhaar", f"{d}[1] IN ('0', '1')", False, "'Aadhaar cannot start with 0 or 1'"),
        ("aadhaar", "TRUE", True, "'Valid 12-digit Aadhaar format'"),
        ("pan", f"regexp_full_match({u}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')", True, "'Valid PAN format'"),
        ("pan", "TRUE", False, "'PAN must match format AAAAA9999A (5 letters + 4 digits + 1 letter)'"),
        ("mobile", f"len({m}) <> 10", False, f"'Mobile must be 10 digits (got ' || len({m}) || ')'"),
        ("mobile", f"{m}[1] NOT IN ('6', '7', '8', '9')", False, "'Indian mobile numbers start with 6, 7, 8, or 9'"),
        ("mobile", "TRUE", True, "'Valid mobile format'"),
        ("dob", f"{dt} IS NULL", False, "'Could not parse date of birth'"),
        ("dob", f"year({dt}) < 1900 OR {dt} > {TODAY}", False, "'Date of birth is out of realistic range'"),
        ("dob", "TRUE", True, f"'Parsed as ' || strftime({dt}, '%d/%m/%Y') || ' (approx age ' || (({TODAY} - {dt}) // 365) || ')'"),
        ("dl_number", f"len({n}) < 10 OR len({n}) > 20", False, "'DL number length looks wrong (expected ~10–16 characters)'"),
        ("dl_number", f"NOT regexp_matches({n}, '^[A-Z]{{2}}')", False, "'DL number should start with state code (e.g. MH, KA, DL)'"),
        ("dl_number", "TRUE", True, "'DL number format looks plausible'"),
        ("epic", f"regexp_full_match({n}, '[A-Z]{{3}}[0-9]{{7}}')", True, "'Valid EPIC format (3 letters + 7 digits)'"),
        ("epic", f"len({n}) BETWEEN 8 AND 12 AND regexp_matches({n}, '[A-Z]') AND regexp_matches({n}, '[0-9]')", True,
         "'EPIC format looks plausible (non-standard length — verify on card)'"),
        ("epic", "TRUE", False, "'EPIC should look like ABC1234567 (3 letters + 7 digits)'"),
        ("passport", f"{n} = ''", True, "'Optional — blank OK for fresh passport'"),
        ("passport", f"regexp_full_match({n}, '[A-Z][0-9]{{7}}')", True, "'Valid Indian passport number format'"),
        ("passport", f"regexp_full_match({n}, '[A-Z]{{1,2}}[0-9]{{6,8}}')", True, "'Passport number format looks plausible'"),
        ("passport", "TRUE", False, "'Passport number usually looks like A1234567'"),
        ("ifsc", f"regexp_full_match({u}, '[A-Z]{{4}}0[A-Z0-9]{{6}}')", True, "'Valid IFSC format'"),
        ("ifsc", "TRUE", False, "'IFSC must be 11 chars: 4 letters + 0 + 6 alphanumeric'"),
        ("account_number", f"len({d}) < 9 OR len({d}) > 18", False, f"'Account number length looks wrong (got ' || len({d}) || ' digits)'"),
        ("account_number", "TRUE", True, "'Account number length looks plausible'"),
        ("email", f"regexp_full_match(trim({v}), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')", True, "'Valid email format'"),
        ("email", "TRUE", False, "'Email does not look valid'"),
        ("nonempty", f"trim({v}) = ''", False, f"{key} || ' is empty — form is incomplete'"),
        ("nonempty", f"len(trim({v})) < 2", False, f"{key} || ' is too short to be valid'"),
        ("nonempty", "TRUE", True, "'Present'"),
        ("address_pincode", f"regexp_matches({v}, '\\b[0-9]{{6}}\\b')", True, "'Address includes a pincode'"),
        ("address_pincode", "TRUE", False, "'Address should include a 6-digit pincode (portals often reject without it)'"),
    ]
    ok = "CASE " + " ".join(f"WHEN {name} = '{r}' AND ({c}) THEN {good}" for r, c, good, _ in rules) + " END"
    message = "CASE " + " ".join(f"WHEN {name} = '{r}' AND ({c}) THEN {text}" for r, c, _, text in rules) + " END"
    return ok, message


_OK, _MESSAGE = validator_case("validator", "value", "form_key")


def spoken_problem(k: str, v: str) -> str:
    d, letters = f"len(regexp_replace({v}, '\\D', '', 'g'))", f"len(regexp_replace({v}, '[^A-Za-z]', '', 'g'))"
    gender = " OR ".join(f"contains(lower({v}), '{g}')" for g in ("male", "female", "other", "man", "woman", "boy", "girl", "trans"))
    return f"""CASE WHEN len({v}) < 2 THEN 'I did not catch that. Please say it again.'
        WHEN contains({k}, 'mobile') OR contains({k}, 'phone') THEN CASE WHEN {d} < 10 THEN 'Mobile looks incomplete. Say all 10 digits.'
            WHEN {d} > 12 THEN 'That number is too long. Say your 10-digit mobile.' END
        WHEN contains({k}, 'email') THEN CASE WHEN NOT contains({v}, '@') OR NOT contains(string_split({v}, '@')[-1], '.')
            THEN 'That does not look like an email. Try again.' END
        WHEN contains({k}, 'dob') OR ends_with({k}, '_date') THEN CASE WHEN {d} = 0 THEN 'Include the date with numbers, like 15 March 2002.' END
        WHEN contains({k}, 'aadhaar') THEN CASE WHEN {d} < 8 THEN 'Aadhaar should be 12 digits. Say it again slowly.' END
        WHEN contains({k}, 'gender') THEN CASE WHEN NOT ({gender}) THEN 'Please say Male, Female, or Other.' END
        WHEN contains({k}, 'name') THEN CASE WHEN {letters} < 3 THEN 'Name is too short. Say your full name.'
            WHEN NOT regexp_matches({v}, '\\s') AND {letters} < 4 THEN 'Please say your full name, including surname.' END
        WHEN contains({k}, 'address') THEN CASE WHEN len({v}) < 6 THEN 'Please say a fuller address — area, city, or pin.' END END"""


def spoken_stripped(t: str) -> str:
    s = f"regexp_replace(trim({t}), '(?i)^(mera naam|meri naam|my name|full name|naam|name)\\s*(hai|hain|is|:)?\\s*', '')"
    s = f"regexp_replace({strip(s)}, '(?i)^(mera|meri|my|please|ji)\\s+', '')"
    return strip(f"regexp_replace({strip(s)}, '(?i)\\s+(hai|hain|is|please|ji)\\.?$', '')")


def spoken_spelled(s: str) -> str:
    # Letters with accents count as word characters here, which plain \b of this engine does not know.
    letters = f"regexp_extract_all(regexp_replace({s}, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-Za-z])\\b', 1)"
    words = f"len(regexp_extract_all({s}, '[A-Za-z]{{2,}}'))"
    dashed = f"regexp_extract(regexp_replace({s}, '[^\\x00-\\x7F]', '_', 'g'), '(?i)\\b([a-z](?:-[a-z]){{2,}})\\b', 1)"
    return f"""CASE WHEN len({letters}) >= 3 AND {words} <= 1 THEN upper(array_to_string({letters}, ''))
        WHEN {dashed} <> '' THEN upper(replace({dashed}, '-', '')) ELSE {s} END"""


def upper_de(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def spoken_block(v: str, k: str) -> str:
    def has(*parts):
        return "(" + " OR ".join(f"contains({k}, '{p}')" for p in parts) + ")"

    def heard(*parts):
        return "(" + " OR ".join(f"contains(lower({v}), '{p}')" for p in parts) + ")"

    number = f"regexp_replace({v}, '[^0-9+]', '', 'g')"
    return f"""CASE WHEN {v} = '' THEN ''
        WHEN {has('mobile', 'phone', 'otp', 'pincode', 'pin_code')} THEN CASE WHEN {number} <> '' THEN {number} ELSE {v} END
        WHEN {has('email')} THEN lower(regexp_replace({v}, '\\s+', '', 'g'))
        WHEN {has('name', 'father', 'mother', 'address', 'reason', 'village', 'district')} THEN {upper_de(f"regexp_replace({v}, '\\s+', ' ', 'g')")}
        WHEN {has('gender')} THEN CASE WHEN {heard('female', 'woman', 'girl', 'f')} THEN 'FEMALE' WHEN {heard('male', 'man', 'boy', 'm')} THEN 'MALE'
            WHEN {heard('other', 'trans')} THEN 'OTHER' ELSE {upper_de(v)} END
        ELSE {v} END"""


def intent_case(t: str) -> str:
    def hears(phrases):
        return "(" + " OR ".join(f"contains(lower({t}), {q(p)})" for p in phrases) + ")"

    return f"""CASE WHEN trim({t}) = '' THEN 'blank' WHEN {hears(facts.DOCUMENT_PHRASES)} THEN 'documents'
        WHEN {hears(facts.CLEAR_PHRASES)} THEN 'clear' WHEN {hears(facts.REDO_PHRASES)} THEN 'redo'
        WHEN {hears(facts.DONE_PHRASES)} THEN 'done' ELSE 'answer' END"""


# --- building blocks ---------------------------------------------------------------------------------------------------------

_ORDS = ", ".join(f"({o})" for o in bridge.DOC_ORDS)
_KEYS = ", ".join(f"({q(k)})" for k in bridge.ANSWER_KEYS)
_PRIORITY = "CASE {0} " + " ".join(f"WHEN {q(d)} THEN {p}" for d, p in facts.DOC_PRIORITY.items()) + " ELSE 50 END"
FIELD_ORD = "CASE {0} " + " ".join(f"WHEN '{r[0]}' THEN {n}" for n, r in enumerate(facts.rows(facts.IDENTITY_FIELDS))) + " END"
LABEL = "CASE {0} " + " ".join(f"WHEN '{r[0]}' THEN {q(r[1])}" for r in facts.rows(facts.IDENTITY_FIELDS)) + " ELSE {0} END"
_MATRIX = [r[0] for r in facts.rows(facts.MATRIX_FIELDS)]
MATRIX_ORD = "CASE {0} " + " ".join(f"WHEN '{f}' THEN {n + 1}" for n, f in enumerate(_MATRIX)) + " END"
_IDENTITY = [r[0] for r in facts.rows(facts.IDENTITY_FIELDS)]

CTES: dict[str, str] = {
    "docs": "SELECT c_custkey AS case_id, c_custkey, c_nationkey, ord AS doc_ord, "
    + ", ".join(f"{sql} AS {name}" for name, sql in bridge.DOC_COLUMNS.items())
    + f" FROM customer, (VALUES {_ORDS}) o(ord) WHERE {bridge.DOC_EXISTS}",
    "id_docs": f"SELECT * FROM docs WHERE doc_type NOT IN {in_list(facts.FORM_DOC_TYPES)}",
    "long_all": " UNION ALL ".join(
        f"SELECT case_id, doc_ord, doc_type, '{f}' AS field, {n} AS field_ord, coalesce({f}, 'UNCERTAIN') AS value FROM id_docs"
        for n, f in enumerate(_IDENTITY)
    ),
    "long_docs": f"""SELECT *, min(doc_ord) OVER (PARTITION BY case_id, field, doc_type, value) AS first_ord,
        {tokens('value')} AS t, {day_first('value')} AS d, {address_set('value')} AS s
        FROM long_all WHERE {readable('value')}""",
    "all_pairs": f"""SELECT *, {_STATUS} AS status, {_DETAIL} AS detail FROM (
        SELECT a.case_id, a.field, a.field_ord, a.doc_type AS doc_a, b.doc_type AS doc_b, a.value AS value_a, b.value AS value_b,
            a.doc_ord AS real_a, b.doc_ord AS real_b, a.first_ord AS ord_a, b.first_ord AS ord_b,
            a.t AS ta, b.t AS tb, a.d AS da, b.d AS db, a.s AS sa, b.s AS sb
        FROM long_docs a JOIN long_docs b ON a.case_id = b.case_id AND a.field = b.field
            AND (a.first_ord < b.first_ord OR (a.first_ord = b.first_ord AND a.doc_ord < b.doc_ord)))""",
    "pairs": "SELECT * FROM all_pairs WHERE field <> 'id_number' OR doc_a = doc_b",
    "comparisons": """SELECT case_id, field, doc_a, doc_b, value_a, value_b, status, detail, count(*) AS n_pairs, ord_a, ord_b
        FROM pairs GROUP BY ALL""",
    "agree": """SELECT case_id, field, real_a AS x, real_b AS y FROM all_pairs WHERE status IN ('MATCH', 'VARIANT')
        UNION ALL SELECT case_id, field, real_b, real_a FROM all_pairs WHERE status IN ('MATCH', 'VARIANT')
        UNION ALL SELECT case_id, field, doc_ord, doc_ord FROM long_docs
            WHERE CASE WHEN field IN ('full_name', 'father_name') THEN len(t) > 0 WHEN field = 'dob' THEN d IS NOT NULL
                WHEN field = 'address' THEN len(s) > 0 ELSE TRUE END""",
    "tally": "SELECT case_id, field, y AS doc_ord, count(*) AS votes FROM agree GROUP BY ALL",
    "voted": """SELECT p.*, coalesce(ua.votes, 0) AS votes_a, coalesce(ub.votes, 0) AS votes_b FROM pairs p
        LEFT JOIN tally ua ON ua.case_id = p.case_id AND ua.field = p.field AND ua.doc_ord = p.real_a
        LEFT JOIN tally ub ON ub.case_id = p.case_id AND ub.field = p.field AND ub.doc_ord = p.real_b
        WHERE p.status = 'CRITICAL'""",
    "charges": """SELECT case_id, doc_a AS doc_type, [ord_a, ord_b, field_ord, 0] AS place FROM voted WHERE votes_a <= votes_b
        UNION ALL SELECT case_id, doc_b, [ord_a, ord_b, field_ord, 1] FROM voted WHERE votes_b <= votes_a""",
    "blockers": "SELECT case_id, doc_type, count(*) AS blockers, min(place) AS place FROM charges GROUP BY ALL",
    "primary_docs": """SELECT case_id, doc_type AS primary_doc, blockers AS blocker_count FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY blockers DESC, place) AS r FROM blockers) WHERE r = 1""",
    "summary": """SELECT case_id, count(*) FILTER (status = 'MATCH') AS matches, count(*) FILTER (status = 'VARIANT') AS variants,
        count(*) FILTER (status = 'CRITICAL') AS blockers, count(*) FILTER (status = 'UNCERTAIN') AS uncertain
        FROM pairs GROUP BY ALL""",
    # --- forms
    "services": values_table(
        dims.service_rows(), "service_id", "title", "category", "fill_mode", "portal_name", "portal_url", "rule_category", "service_ord"
    ),
    "service_docs": values_table(dims.service_doc_rows(), "service_id", "kind", "doc_type", "ord"),
    "form_fields": values_table(
        dims.form_field_rows(), "service_id", "form_key", "field_ord", "label", "compare_to", "compare_doc", "high_stakes"
    ),
    "field_rules": values_table(dims.field_rule_rows(), "service_id", "form_key", "rule_ord", "validator", "optional"),
    "weights": values_table(dims.weight_rows(), "service_id", "w_format", "w_docs", "w_match", "w_complete", "w_eligible"),
    "reasons": values_table(dims.reason_rows(), "service_id", "ord", "reason"),
    "portals": values_table([(r[0], r[1], r[2] or "", r[3]) for r in facts.rows(facts.REMEDIATION)], "doc_type", "portal", "url", "how"),
    "forms": f"SELECT c_custkey AS case_id, c_custkey, c_nationkey, {bridge.SERVICE_OF_CASE} AS service_id FROM customer",
    "answers": f"""SELECT case_id, service_id, k AS form_key, {bridge.ANSWER_VALUE} AS value FROM forms, (VALUES {_KEYS}) ks(k)
        WHERE ({bridge.ANSWER_VALUE}) IS NOT NULL""",
    "form_rows": """SELECT f.case_id, ff.*, trim(coalesce(a.value, '')) AS form_value FROM forms f
        JOIN form_fields ff USING (service_id) LEFT JOIN answers a ON a.case_id = f.case_id AND a.form_key = ff.form_key""",
    "rule_rows": """SELECT f.case_id, r.*, trim(coalesce(a.value, '')) AS value FROM forms f
        JOIN field_rules r USING (service_id) LEFT JOIN answers a ON a.case_id = f.case_id AND a.form_key = r.form_key""",
    "validated": f"""SELECT *, CASE WHEN value = '' AND optional THEN 'skipped' WHEN value = '' THEN 'missing'
            WHEN validator IS NULL THEN 'unchecked' WHEN {_OK} THEN 'ok' ELSE 'fail' END AS outcome,
        CASE WHEN value = '' AND NOT optional THEN 'Required field is empty' WHEN value <> '' THEN {_MESSAGE} END AS message
        FROM rule_rows""",
    "form_pairs": f"""SELECT *, CASE WHEN NOT {readable('form_value')} THEN 'UNCERTAIN' ELSE {_STATUS} END AS status,
        CASE WHEN NOT {readable('form_value')} THEN 'Form field is empty — citizen must answer' ELSE {_DETAIL} END AS detail FROM (
        SELECT r.*, r.compare_to AS field, r.form_value AS value_a, l.value AS value_b, l.doc_type, l.doc_ord, l.first_ord,
            {tokens('r.form_value')} AS ta, l.t AS tb, {day_first('r.form_value')} AS da, l.d AS db,
            {address_set('r.form_value')} AS sa, l.s AS sb,
            CASE WHEN l.doc_type = r.compare_doc THEN 0 ELSE 1 END AS late, {_PRIORITY.format('l.doc_type')} AS priority
        FROM form_rows r JOIN long_docs l ON l.case_id = r.case_id AND l.field = r.compare_to)""",
    "best_pairs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, form_key ORDER BY
            CASE WHEN status IN ('MATCH', 'VARIANT') AND late = 0 THEN 0 WHEN status IN ('MATCH', 'VARIANT') THEN 1
                WHEN status = 'CRITICAL' THEN 2 ELSE 3 END,
            CASE WHEN status = 'UNCERTAIN' THEN late ELSE 0 END, priority, late, doc_ord) AS r FROM form_pairs) WHERE r = 1""",
    "ignored": f"""SELECT r.case_id, r.form_key, string_agg(l.doc_type, ', ' ORDER BY
            CASE WHEN l.doc_type = r.compare_doc THEN 0 ELSE 1 END, {_PRIORITY.format('l.doc_type')}, l.doc_ord) AS names
        FROM form_rows r JOIN long_all l ON l.case_id = r.case_id AND l.field = r.compare_to
        WHERE NOT {readable('l.value')} GROUP BY ALL""",
    "usual": values_table([(f, ", ".join(facts.items(d))) for f, d in facts.rows(facts.USUALLY_ON)], "field", "docs"),
    "checks": """SELECT r.case_id, r.service_id, r.form_key, r.field_ord, r.label, r.compare_to, r.high_stakes,
        CASE WHEN r.form_value = '' THEN '—' ELSE r.form_value END AS form_value, b.doc_type, b.value_b AS doc_value,
        coalesce(b.status, 'UNCERTAIN') AS status,
        CASE WHEN b.doc_type IS NULL THEN 'None of the uploaded documents have a readable ''' || r.compare_to || '''. Skipped (field absent): '
                || coalesce(i.names, '—') || '. ' || coalesce('Usually found on: ' || u.docs || '.', '')
            WHEN b.status IN ('MATCH', 'VARIANT') THEN 'Checked against ' || b.doc_type || ' as source of truth. ' || b.detail
                || coalesce(' Ignored ' || i.names || ' (no readable ' || r.compare_to || ' on those docs).', '')
            WHEN b.status = 'CRITICAL' THEN 'Mismatch vs ' || b.doc_type || ' (preferred readable source). ' || b.detail
                || coalesce(' Ignored ' || i.names || ' (no readable ' || r.compare_to || ' on those docs).', '')
            ELSE b.detail END AS detail
        FROM form_rows r LEFT JOIN best_pairs b ON b.case_id = r.case_id AND b.form_key = r.form_key
        LEFT JOIN ignored i ON i.case_id = r.case_id AND i.form_key = r.form_key LEFT JOIN usual u ON u.field = r.compare_to
        WHERE r.compare_to IS NOT NULL""",
    "approved": """SELECT case_id, service_id, form_key, field_ord, form_value AS value FROM form_rows WHERE compare_to IS NULL AND form_value <> ''
        UNION ALL SELECT case_id, service_id, form_key, field_ord, form_value FROM checks
            WHERE status IN ('MATCH', 'VARIANT') AND form_value <> '—'""",
    "missing_docs": """SELECT f.case_id, f.service_id, d.doc_type, d.ord FROM forms f JOIN service_docs d USING (service_id)
        WHERE d.kind = 'required' AND NOT EXISTS (SELECT 1 FROM id_docs x WHERE x.case_id = f.case_id AND x.doc_type = d.doc_type)""",
    "scheme": f"""SELECT case_id, service_id, scheme_name, CASE WHEN scheme_name = '' THEN NULL ELSE (SELECT min_by(name, ord) FROM (
            {values_table([(n, r[0]) for n, r in enumerate(facts.rows(facts.SCHEMES))], 'ord', 'name')})
            WHERE contains(lower(scheme_name), lower(name)) OR contains(lower(name), lower(scheme_name))) END AS matched FROM (
        SELECT f.case_id, f.service_id, trim(coalesce(a.value, '')) AS scheme_name FROM forms f
        LEFT JOIN answers a ON a.case_id = f.case_id AND a.form_key = 'scheme_name' WHERE f.service_id = 'scheme_apply')""",
    "scheme_text": values_table([(r[0], r[1]) for r in facts.rows(facts.SCHEMES)], "name", "eligibility"),
    "eligible": """SELECT s.case_id, s.service_id, CASE WHEN scheme_name = '' THEN 0.0 WHEN matched IS NULL THEN 0.55
            WHEN trim(coalesce(c.value, '')) = '' THEN 0.6 WHEN NOT regexp_matches(coalesce(i.value, ''), '[0-9]') THEN 0.65 ELSE 0.95 END::DOUBLE AS eligibility_score,
        CASE WHEN scheme_name = '' THEN 'No scheme selected'
            WHEN matched IS NULL THEN 'Scheme ''' || n.value || ''' not in local catalogue — operator must confirm the correct portal and eligibility manually'
            WHEN trim(coalesce(c.value, '')) = '' THEN 'Category (SC/ST/OBC/EWS/General) missing — many schemes reject without it'
            WHEN NOT regexp_matches(coalesce(i.value, ''), '[0-9]') THEN 'Annual income should include a number for eligibility screening'
            ELSE 'Matched catalogue scheme: ' || t.name || ' — ' || t.eligibility END AS risk
        FROM scheme s LEFT JOIN answers n ON n.case_id = s.case_id AND n.form_key = 'scheme_name'
        LEFT JOIN answers c ON c.case_id = s.case_id AND c.form_key = 'category'
        LEFT JOIN answers i ON i.case_id = s.case_id AND i.form_key = 'annual_income' LEFT JOIN scheme_text t ON t.name = s.matched""",
    "rule_scores": """SELECT case_id, service_id,
        coalesce(count(*) FILTER (outcome = 'ok') / nullif(count(*) FILTER (outcome IN ('ok', 'fail')), 0), 0) AS format_score,
        coalesce(count(*) FILTER (outcome NOT IN ('skipped', 'missing')) / nullif(count(*) FILTER (outcome <> 'skipped'), 0), 0) AS completeness,
        bool_or(outcome IN ('fail', 'missing')) AS rule_fails FROM validated GROUP BY ALL""",
    "match_scores": """SELECT case_id, service_id, avg(CASE status WHEN 'MATCH' THEN 1 WHEN 'VARIANT' THEN 0.85 WHEN 'UNCERTAIN' THEN 0.4
            WHEN 'CRITICAL' THEN 0 ELSE 0.5 END) AS match_score, count(*) FILTER (status = 'CRITICAL') AS form_blockers,
        count(*) FILTER (status = 'UNCERTAIN') AS form_uncertain FROM checks GROUP BY ALL""",
    "docs_scores": """SELECT f.case_id, f.service_id, greatest(0, 1 - count(m.doc_type) / count(d.doc_type)) AS docs_score,
        count(m.doc_type) AS lacking, string_agg(m.doc_type, ', ' ORDER BY d.ord) AS missing
        FROM forms f JOIN service_docs d ON d.service_id = f.service_id AND d.kind = 'required'
        LEFT JOIN missing_docs m ON m.case_id = f.case_id AND m.doc_type = d.doc_type GROUP BY ALL""",
    "exact_scores": """SELECT r.case_id, r.service_id, r.format_score, r.completeness, r.rule_fails, d.docs_score, d.lacking, d.missing,
        m.match_score, m.form_blockers, m.form_uncertain, coalesce(e.eligibility_score, 1) AS eligibility_score, e.risk,
        100 * (w.w_format * r.format_score + w.w_docs * d.docs_score + w.w_match * m.match_score + w.w_complete * r.completeness
            + w.w_eligible * coalesce(e.eligibility_score, 1)) AS exact_score
        FROM rule_scores r JOIN docs_scores d USING (case_id, service_id) JOIN match_scores m USING (case_id, service_id)
        JOIN weights w USING (service_id) LEFT JOIN eligible e ON e.case_id = r.case_id""",
    "scores": """SELECT *, (form_blockers = 0 AND form_uncertain = 0 AND grade = 'READY') AS ready_for_portal FROM (
        SELECT *, CASE WHEN rule_fails OR form_blockers > 0 OR lacking > 0 THEN CASE WHEN exact_score < 60 THEN 'BLOCKED' ELSE 'FIX_REQUIRED' END
            WHEN form_uncertain > 0 THEN CASE WHEN exact_score < 85 THEN 'FIX_REQUIRED' ELSE 'READY' END
            WHEN exact_score >= 80 THEN 'READY' ELSE 'FIX_REQUIRED' END AS grade,
        round_even(exact_score, 1) AS score FROM exact_scores)""",
    "issues": """SELECT case_id, service_id, form_key, CASE WHEN outcome = 'ok' THEN 'OK' ELSE 'FAIL' END AS severity, message
        FROM validated WHERE outcome IN ('ok', 'fail', 'missing')
        UNION ALL SELECT case_id, service_id, form_key, CASE WHEN status = 'CRITICAL' THEN 'FAIL' ELSE 'WARN' END,
            CASE WHEN status = 'CRITICAL' THEN 'Form value conflicts with supporting document'
                ELSE 'Could not verify against documents — operator must check' END
        FROM checks WHERE status IN ('CRITICAL', 'UNCERTAIN')""",
    "risks": """SELECT case_id, service_id, ord, risk FROM (
        SELECT case_id, service_id, 0 AS ord, risk FROM scores WHERE risk IS NOT NULL
        UNION ALL SELECT case_id, service_id, 1, 'Missing required documents: ' || missing FROM scores WHERE lacking > 0
        UNION ALL SELECT s.case_id, s.service_id, 2 + r.ord, r.reason FROM scores s JOIN reasons r USING (service_id)
            WHERE r.ord < 2 AND (s.rule_fails OR s.form_blockers > 0))""",
    # --- accuracy
    "expected": values_table([(d, f) for d, fs in facts.rows(facts.EXPECTED_FIELDS) for f in facts.items(fs)], "doc_type", "field"),
    "ocr_pct": """SELECT d.case_id, d.doc_ord, d.doc_type, count(*) FILTER (upper(trim(l.value)) NOT IN ('', 'UNCERTAIN')) AS ocr_readable,
        count(*) AS ocr_expected, floor(100 * count(*) FILTER (upper(trim(l.value)) NOT IN ('', 'UNCERTAIN')) / count(*) + 0.5)::INT AS ocr_pct
        FROM id_docs d JOIN expected e USING (doc_type) JOIN long_all l ON l.case_id = d.case_id AND l.doc_ord = d.doc_ord AND l.field = e.field
        GROUP BY ALL""",
    "touched": """SELECT case_id, doc_a AS doc_type, status FROM pairs UNION ALL SELECT case_id, doc_b, status FROM pairs WHERE doc_b <> doc_a
        UNION ALL SELECT case_id, doc_type, status FROM checks WHERE doc_type IS NOT NULL""",
    "verify_pct": """SELECT case_id, doc_type, count(*) AS verify_total, count(*) FILTER (status = 'MATCH') AS match,
        count(*) FILTER (status = 'VARIANT') AS variant, count(*) FILTER (status = 'CRITICAL') AS blocker,
        count(*) FILTER (status = 'UNCERTAIN') AS unsure,
        floor(round((count(*) FILTER (status = 'MATCH') * 100 + count(*) FILTER (status = 'VARIANT') * 85
            + count(*) FILTER (status = 'UNCERTAIN') * 35) / count(*), 7) + 0.5)::INT AS verify_pct FROM touched GROUP BY ALL""",
    "accuracy": """SELECT o.*, v.verify_total, v.match, v.variant, v.blocker, v.unsure, v.verify_pct,
        coalesce(floor(round(o.ocr_pct * 0.4 + v.verify_pct * 0.6, 7) + 0.5)::INT, o.ocr_pct) AS overall_pct
        FROM ocr_pct o LEFT JOIN verify_pct v USING (case_id, doc_type)""",
    # --- views
    "desk_pairs": f"""SELECT *, {desk_status('field', 'value_a', 'value_b')} AS status FROM (
        SELECT a.case_id, a.field, a.doc_type AS doc_a, b.doc_type AS doc_b, a.value AS value_a, b.value AS value_b FROM
            (SELECT *, min(doc_ord) OVER (PARTITION BY case_id, field, doc_type, value) AS first_ord FROM long_all WHERE field <> 'id_number') a
            JOIN (SELECT *, min(doc_ord) OVER (PARTITION BY case_id, field, doc_type, value) AS first_ord FROM long_all WHERE field <> 'id_number') b
            ON a.case_id = b.case_id AND a.field = b.field
            AND (a.first_ord < b.first_ord OR (a.first_ord = b.first_ord AND a.doc_ord < b.doc_ord)))""",
    "desk_form": f"""SELECT r.case_id, r.service_id, r.form_key, r.field_ord, r.form_value, l.doc_type, l.value, l.doc_ord,
            CASE WHEN l.doc_type = r.compare_doc THEN 0 ELSE 1 END AS late, {desk_status('r.compare_to', 'r.form_value', 'l.value')} AS status
        FROM form_rows r JOIN long_all l ON l.case_id = r.case_id AND l.field = r.compare_to
        JOIN (SELECT r.case_id, r.form_key, count(*) FILTER (x.doc_type = r.compare_doc) AS same_type, count(*) AS n,
            max(x.doc_ord) FILTER (x.doc_type = r.compare_doc) AS last_one
            FROM form_rows r JOIN id_docs x ON x.case_id = r.case_id GROUP BY ALL) v ON v.case_id = r.case_id AND v.form_key = r.form_key
        WHERE (l.doc_type IS DISTINCT FROM r.compare_doc OR l.doc_ord = v.last_one)
            AND (NOT {desk_missing('l.value')} OR v.n - greatest(v.same_type - 1, 0) = 1)""",
    "desk_best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, form_key ORDER BY
            CASE WHEN status IN ('MATCH', 'VARIANT') THEN 0 WHEN status = 'UNCERTAIN' THEN 1 ELSE 2 END, late, doc_ord) AS r FROM desk_form) WHERE r = 1""",
    "desk_checks": """SELECT r.case_id, r.service_id, r.form_key, r.form_value, b.doc_type, b.value AS doc_value, coalesce(b.status, 'UNCERTAIN') AS status
        FROM form_rows r LEFT JOIN desk_best b ON b.case_id = r.case_id AND b.form_key = r.form_key WHERE r.compare_to IS NOT NULL""",
    "cells_in": " UNION ALL ".join(
        f"SELECT case_id, doc_ord, doc_type, '{f}' AS field, {f} AS value, upper(trim({f})) = 'UNCERTAIN' AS unsure FROM id_docs" for f in _MATRIX
    ),
    "refs": """SELECT case_id, field, doc_ord AS ref_ord, doc_type AS ref_doc, value AS ref_value, unsure AS ref_unsure FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY
            CASE WHEN doc_type = 'Aadhaar Card' AND NOT unsure THEN 0 WHEN NOT unsure THEN 1 ELSE 2 END, doc_ord) AS r
        FROM cells_in WHERE value IS NOT NULL) WHERE r = 1""",
    "cells": f"""SELECT c.case_id, c.field, c.doc_ord, c.doc_type, coalesce(c.value, '—') AS value,
        CASE WHEN c.value IS NULL THEN 'missing' WHEN c.doc_ord = r.ref_ord THEN CASE WHEN c.unsure THEN 'uncertain' ELSE 'match' END
            ELSE {matrix_status('c.field', 'r.ref_value', 'c.value', '(c.unsure OR r.ref_unsure)')} END AS status
        FROM cells_in c JOIN refs r USING (case_id, field)""",
    # --- dialogue
    "turns": f"""SELECT conv_id, {bridge.SERVICE_OF_CONV} AS service_id, turn * {bridge.SPOKEN_PER_TURN} + s AS turn, {bridge.SPOKEN} AS transcript
        FROM conversations, (SELECT unnest(range({bridge.SPOKEN_PER_TURN})) AS s) WHERE role = 'user'""",
    "stakes": values_table(
        [(sid, key, n) for sid, group in groupby(dims.form_field_rows(), lambda r: r[0])
         for n, key in enumerate([r[1] for r in group if r[6]])], "service_id", "form_key", "k"),
    "heard": f"""SELECT conv_id, service_id, turn, transcript, intent, {spoken_spelled('stripped')} AS said,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (
        SELECT *, {intent_case('transcript')} AS intent, {spoken_stripped('transcript')} AS stripped FROM turns)""",
    "moves": f"""SELECT h.conv_id, h.n, k.k, CASE WHEN {spoken_problem('k.form_key', 'b')} IS NULL THEN 1 ELSE 0 END AS step FROM heard h
        JOIN stakes k USING (service_id), LATERAL (SELECT trim({spoken_block('trim(h.said)', 'k.form_key')}) AS b) WHERE h.intent = 'answer'""",
    "walk": """SELECT conv_id, 1::BIGINT AS n, 0::BIGINT AS before FROM heard WHERE n = 1
        UNION ALL SELECT w.conv_id, w.n + 1, CASE WHEN h.intent = 'clear' THEN greatest(0, w.before - 1)
                WHEN h.intent = 'answer' THEN w.before + coalesce(m.step, 0) ELSE w.before END
        FROM walk w JOIN heard h ON h.conv_id = w.conv_id AND h.n = w.n
        LEFT JOIN moves m ON m.conv_id = w.conv_id AND m.n = w.n AND m.k = w.before
        WHERE EXISTS (SELECT 1 FROM heard x WHERE x.conv_id = w.conv_id AND x.n = w.n + 1)""",
    "outcomes": f"""SELECT h.conv_id, h.service_id, h.turn, CASE WHEN h.intent IN ('blank', 'clear', 'redo') THEN 'ask'
            WHEN h.intent = 'documents' THEN 'answer' WHEN h.intent = 'done' THEN CASE WHEN a.form_key IS NOT NULL THEN 'ask' ELSE 'redirect' END
            WHEN a.form_key IS NULL THEN 'redirect' WHEN m.step = 0 THEN 'clarify' WHEN nx.form_key IS NOT NULL THEN 'ask' ELSE 'redirect' END AS action,
        CASE WHEN m.step = 1 THEN a.form_key WHEN h.intent = 'clear' THEN p.form_key END AS update_key,
        CASE WHEN m.step = 1 THEN {spoken_block('trim(h.said)', 'a.form_key')} WHEN h.intent = 'clear' AND p.form_key IS NOT NULL THEN '' END AS update_value,
        CASE WHEN m.step = 1 THEN nx.form_key WHEN h.intent = 'clear' AND p.form_key IS NOT NULL THEN p.form_key ELSE a.form_key END AS next_field
        FROM heard h JOIN walk w ON w.conv_id = h.conv_id AND w.n = h.n
        LEFT JOIN stakes a ON a.service_id = h.service_id AND a.k = w.before
        LEFT JOIN stakes nx ON nx.service_id = h.service_id AND nx.k = w.before + 1
        LEFT JOIN stakes p ON p.service_id = h.service_id AND p.k = w.before - 1
        LEFT JOIN moves m ON m.conv_id = h.conv_id AND m.n = h.n AND m.k = w.before""",
    # --- case updates
    "patches": "SELECT user_id AS case_id, ts, event_id AS patch_id, event_id % 9 = 4 AS foreign_, "
    + ", ".join(f"{sql} AS {name}" for name, sql in bridge.PATCH_COLUMNS.items())
    + " FROM events",
    "known": f"SELECT user_id AS case_id, min(ts) AS created_at FROM events WHERE {bridge.CASE_EXISTS} GROUP BY ALL",
}


_NAME = re.compile(r"(?:FROM|JOIN|,)\s+\(*([a-z_]+)\b")


def with_ctes(select: str) -> str:
    """Put the needed building blocks, in order, before a SELECT."""
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in sorted(set(_NAME.findall(sql))):
            if name in CTES and name not in needed and name != own:
                visit(CTES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(select)
    recursive = "RECURSIVE " if "walk" in needed else ""
    body = ",\n".join(f"{n} AS ({CTES[n]})" if n == "walk" else f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    return f"WITH {recursive}{body}\n{select}" if needed else select
