"""Standard forms of identity values, as Catalyst column expressions.

A missing value is the text ``UNCERTAIN`` (or blank, N/A, NA) in the source tables; :func:`readable` is the one test
for it.  Every value gets one *standard form* string whose meaning depends on its field:

* names: canonical tokens joined with a space,
* dob: ISO date, NULL when the text is no full date,
* address: sorted distinct significant tokens joined with a space,
* id_number: upper case without white space,
* anything else: cleaned text.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from milaan.catalogue import facts

UNCERTAIN = "UNCERTAIN"
NAME_FIELDS = ("full_name", "father_name")

SPACE = r"(?U)\s+"
# Everything that counts as white space at the ends of a value.
BLANKS = "".join(chr(x) for x in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Trim and make every white-space run one blank."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def readable(c: Column) -> Column:
    return F.coalesce(~F.upper(strip(c)).isin(UNCERTAIN, "N/A", "NA", ""), F.lit(False))


def clean(c: Column) -> Column:
    """Lower case; everything but letters, digits, underscore and white space becomes a blank (marks included)."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(clean(c), SPACE), lambda w: w != "")


def canonical_spelling() -> dict[str, str]:
    """Word -> canonical word: the longest of its group, alphabetically first among equals."""
    out = {}
    for line in facts.SPELLING_GROUPS.strip().splitlines():
        group = line.split()
        best = min(group, key=lambda w: (-len(w), w))
        out.update({w: best for w in group})
    return out


def literal_map(mapping: dict[str, str | int]) -> Column:
    """A constant map; written as one SQL text because building it entry by entry is slow from Python."""
    def quoted(x) -> str:
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x)

    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items()) + ")")


def _lookup(mapping: dict[str, str], w: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), w), w)


def name_tokens(c: Column) -> Column:
    """Words without honorifics, each in its canonical spelling."""
    kept = F.filter(words(c), lambda w: ~w.isin(*facts.HONORIFICS))
    return F.transform(kept, lambda w: _lookup(canonical_spelling(), w))


def address_tokens(c: Column) -> Column:
    significant = F.filter(
        name_tokens(c), lambda w: ~w.isin(*facts.ADDRESS_STOPWORDS) & ~w.rlike(r"^\p{Nd}+$")
    )
    return F.array_sort(F.array_distinct(significant))


def compact_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, SPACE, ""))


# --- dates ----------------------------------------------------------------------------------------------------------

_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
# What may stand between the parts of a written date, "14th of June, 1992" included.
_FILL = r"(?:[\s/.,\-]|\bof\b)*"
_GAP = r"\s*[/.\-\s]\s*"
# Where a full date stands in a text, and how to write it year first.  The first pattern that is found is used.
_DATE_FORMS = [
    (rf"(?<!\d)(\d{{4}})\s*[/.\-]\s*(\d{{1,2}})\s*[/.\-]\s*(\d{{1,2}})(?!\d)", "$1-$2-$3", "yyyy-M-d"),
    (rf"(?<!\d)(0?[1-9]|1[0-2]){_GAP}(1[3-9]|[2-9]\d){_GAP}(\d{{4}})(?!\d)", "$3-$1-$2", "yyyy-M-d"),
    (rf"(?<!\d)(\d{{1,2}}){_GAP}(\d{{1,2}}){_GAP}(\d{{4}})(?!\d)", "$3-$2-$1", "yyyy-M-d"),
    (rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?{_FILL}{_MONTH}{_FILL}(\d{{4}})(?!\d)", "$3-$2-$1", "yyyy-MMM-d"),
    (rf"(?<![a-z]){_MONTH}{_FILL}(\d{{1,2}})(?:st|nd|rd|th)?(?:[\s/.,\-]|\bof\b)+(\d{{4}})(?!\d)", "$3-$1-$2", "yyyy-MMM-d"),
]


def day_first_date(c: Column) -> Column:
    """The full date inside a text: day first, swapped when only that gives a month; year-first text is read as ISO.

    Partial dates and two-digit years are no dates.  (A parser that fills gaps from today's date would change its
    answer from day to day.)
    """
    s = F.lower(c)
    out = None
    for pattern, order, form in _DATE_FORMS:
        ordered = F.initcap(F.regexp_replace(s, f"(?s)^.*?{pattern}.*$", order))
        date = F.try_to_date(ordered, form)
        out = F.when(s.rlike(pattern), date) if out is None else out.when(s.rlike(pattern), date)
    return out


def standard_form(field: Column, value: Column) -> Column:
    return (
        F.when(field.isin(*NAME_FIELDS), F.array_join(name_tokens(value), " "))
        .when(field == "dob", day_first_date(value).cast("string"))
        .when(field == "address", F.array_join(address_tokens(value), " "))
        .when(field == "id_number", compact_id(value))
        .otherwise(clean(value))
    )


@cache
def standard_form_of(field: str, value: str) -> Column:
    """:func:`standard_form` over two named columns, built once per process."""
    return standard_form(F.col(field), F.col(value))


# --- standard forms of the matrix and desk views ---------------------------------------------------------------------


def view_aliases() -> dict[str, str]:
    return dict(facts.rows(facts.VIEW_ALIASES))


def view_name(c: Column) -> Column:
    """Names for the matrix and the desk: compatibility forms folded, honorifics out, aliases applied."""
    titles = r"(?i)\b(" + "|".join(facts.VIEW_HONORIFICS) + r")\b\.?"
    bare = F.regexp_replace(F.regexp_replace(compatible(c), titles, " "), r"(?U)[^\p{L}\p{N}\s]", " ")
    tokens = F.split(F.lower(squeeze(bare)), " ")
    return F.array_join(F.transform(tokens, lambda w: _lookup(view_aliases(), w)), " ")


# Tables of compatibility forms, made from the Unicode data: one sign for one, several for one, and two that become one.
@cache
def _compatibility_tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    single, several, pairs = {}, {}, {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x30000)]:
        sign = chr(code)
        folded = unicodedata.normalize("NFKC", sign)
        if folded != sign:
            (single if len(folded) == 1 else several)[sign] = folded
        parts = unicodedata.decomposition(sign).split(" ")
        if len(parts) == 2 and parts[0][0] != "<":
            two = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", two) == sign:
                pairs[two] = sign
    return single, several, pairs


def _sign_class(signs) -> str:
    """A character class; neighbouring code points become ranges."""
    ranges: list[list[int]] = []
    for code in sorted({ord(x) for x in signs}):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _packed_map(mapping: dict[str, str]) -> Column:
    """A large constant map as one text, so that the plan holds one expression and not one for each entry."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in mapping.items())), F.lit("\x01"), F.lit("\x02"))


def compatible(c: Column) -> Column:
    """NFKC: full-width and half-width forms, ligatures, circled digits and the like become their plain signs, and letters with
    a mark of their own become one sign.  ASCII text is passed on as it is.  Marks are taken in the order they are written in, and
    Hangul written letter by letter stays so."""
    single, several, pairs = _compatibility_tables()
    plain = F.translate(c, "".join(single), "".join(single.values()))
    long_forms, composed = _packed_map(several), _packed_map(pairs)

    def spread(x: Column) -> Column:
        signs = F.transform(F.split(x, ""), lambda sign: F.coalesce(F.try_element_at(long_forms, sign), sign))
        return F.when(F.rlike(x, F.lit(_sign_class(several))), F.array_join(signs, "")).otherwise(x)

    def joined(state: Column, sign: Column) -> Column:
        one = F.try_element_at(composed, F.concat(state["last"], sign))
        return F.struct(
            F.when(one.isNull(), F.concat(state["done"], state["last"])).otherwise(state["done"]).alias("done"),
            F.coalesce(one, sign).alias("last"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))
    wide = spread(plain)
    put_together = F.aggregate(F.split(wide, ""), start, joined, lambda state: F.concat(state["done"], state["last"]))
    marked = F.when(F.rlike(wide, F.lit(_sign_class(x[1] for x in pairs))), put_together).otherwise(wide)
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), marked).otherwise(c)


def view_dob_key(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(digits != "", digits).otherwise(F.lower(strip(c)))


def view_dob_year(c: Column) -> Column:
    """Year of a birth date: from eight digits by position, else the first 19xx/20xx in the text."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    head = digits.substr(1, 4)
    by_position = F.when((head > "1900") & (head < "2100"), head).otherwise(digits.substr(5, 4))
    found = F.regexp_extract(c, r"((?:19|20)[0-9]{2})", 1)
    return F.when(F.length(digits) == 8, by_position).otherwise(F.when(found != "", found))


def view_address_tokens(c: Column, stopwords: list[str]) -> Column:
    parts = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*(stopwords or [""]))))


def gender_class(c: Column) -> Column:
    """M, F or the text itself; dots are dropped."""
    g = F.lower(strip(F.replace(c, F.lit("."), F.lit(""))))
    return F.when(g.isin(*facts.MALE_WORDS), "M").when(g.isin(*facts.FEMALE_WORDS), "F").otherwise(g)


# --- scanned text ------------------------------------------------------------------------------------------------------


def without_ocr_noise(c: Column) -> Column:
    """Drop embedded images and photo captions, then collapse blank lines."""
    s = F.coalesce(c, F.lit(""))
    s = F.regexp_replace(s, r"!\[[^\]]*\]\(data:image/[^)]+\)", "\n")
    s = F.regexp_replace(s, r"data:image/[a-zA-Z0-9+.\-]+;base64,[A-Za-z0-9+/=\s]+", "\n")
    s = F.regexp_replace(s, r"(?is)The image provided is a portrait photograph.*?plain background\.", "\n")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
