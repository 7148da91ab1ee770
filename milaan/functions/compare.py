"""The verdict on two values of one field, as one Catalyst expression.

``verdict`` returns ``struct<status, detail>``.  Rules are ordered from cheap to dear inside one CASE, so the similarity
steps run only for the pairs the cheap rules leave open.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from milaan.catalogue import facts
from milaan.functions import text
from milaan.functions.similarity import bind, tokens_within, unlike_pairs

MATCH, VARIANT, CRITICAL, UNCERTAIN = "MATCH", "VARIANT", "CRITICAL", "UNCERTAIN"
UNREADABLE = "Field unreadable or absent on one document — flagged for manual review"


def _is(status: str, detail) -> Column:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(status).alias("status"), detail.alias("detail"))


def same_or_initial(tokens_a: Column, tokens_b: Column) -> Column:
    """Equal length, and each pair equal or one of them the initial of the other."""

    def fits(x: Column, y: Column) -> Column:
        return (
            (x == y)
            | ((F.length(x) == 1) & y.startswith(x))
            | ((F.length(y) == 1) & x.startswith(y))
        )

    return (F.size(tokens_a) == F.size(tokens_b)) & F.forall(F.zip_with(tokens_a, tokens_b, fits), lambda ok: ok)


def _names(a: Column, b: Column, std_a: Column, std_b: Column) -> Column:
    ta, tb = F.split(std_a, " "), F.split(std_b, " ")

    def by_position(unlike: Column) -> Column:
        told = F.concat(F.lit("Name tokens differ: "), F.array_join(unlike, ", "))
        return F.when(F.size(unlike) == 0, _is(VARIANT, "Phonetically equivalent spelling variants")).otherwise(
            _is(CRITICAL, told)
        )

    smaller_first = F.size(ta) < F.size(tb)
    within = tokens_within(F.when(smaller_first, ta).otherwise(tb), F.when(smaller_first, tb).otherwise(ta))
    unresolved = F.concat(
        F.lit("Names do not resolve to the same identity: '"), a, F.lit("' vs '"), b, F.lit("'")
    )
    return (
        F.when((std_a == "") | (std_b == ""), _is(UNCERTAIN, "One name is empty after normalization"))
        .when(
            std_a == std_b,
            F.when(text.squeeze(text.clean(a)) == text.squeeze(text.clean(b)), _is(MATCH, "Identical")).otherwise(
                _is(VARIANT, "Same identity after honorific/transliteration normalization")
            ),
        )
        .when(same_or_initial(ta, tb), _is(VARIANT, "Initials expand to the same name"))
        .when(F.array_sort(ta) == F.array_sort(tb), _is(VARIANT, "Same tokens in different order"))
        .when(F.size(ta) == F.size(tb), bind(unlike_pairs(ta, tb), by_position))
        .when(within, _is(VARIANT, "One document omits a middle/last name component"))
        .otherwise(_is(CRITICAL, unresolved))
    )


def _dob(a: Column, b: Column, std_a: Column, std_b: Column) -> Column:
    def dmy(iso: Column) -> Column:
        return F.concat_ws("/", iso.substr(9, 2), iso.substr(6, 2), iso.substr(1, 4))

    told = F.concat(F.lit("Dates of birth differ: "), dmy(std_a), F.lit(" vs "), dmy(std_b))
    return (
        F.when(std_a.isNull() | std_b.isNull(), _is(UNCERTAIN, "Could not parse one of the dates"))
        .when(
            std_a == std_b,
            F.when(text.strip(a) == text.strip(b), _is(MATCH, "Identical")).otherwise(
                _is(VARIANT, "Same date, different format")
            ),
        )
        .otherwise(_is(CRITICAL, told))
    )


def _address(a: Column, b: Column, std_a: Column, std_b: Column) -> Column:
    sa, sb = F.split(std_a, " "), F.split(std_b, " ")
    overlap = F.size(F.array_intersect(sa, sb)) / F.least(F.size(sa), F.size(sb))
    return (
        F.when((std_a == "") | (std_b == ""), _is(UNCERTAIN, "One address is empty after normalization"))
        .when(
            overlap >= 0.8,
            F.when(text.clean(a) == text.clean(b), _is(MATCH, "Identical")).otherwise(
                _is(VARIANT, "Same locality, formatting differs")
            ),
        )
        .when(
            overlap >= 0.4,
            _is(VARIANT, "Partial overlap — likely same place described differently; verify manually"),
        )
        .otherwise(_is(CRITICAL, "Addresses appear to be different places"))
    )


def verdict(field: Column, a: Column, b: Column, std_a: Column, std_b: Column) -> Column:
    """Compare two values; ``std_a``/``std_b`` are their standard forms for ``field``."""
    return (
        F.when(~(text.readable(a) & text.readable(b)), _is(UNCERTAIN, UNREADABLE))
        .when(field.isin(*text.NAME_FIELDS), _names(a, b, std_a, std_b))
        .when(field == "dob", _dob(a, b, std_a, std_b))
        .when(field == "address", _address(a, b, std_a, std_b))
        .when(
            field == "id_number",
            F.when(std_a == std_b, _is(MATCH, "Identical")).otherwise(_is(CRITICAL, "ID numbers differ")),
        )
        .otherwise(F.when(std_a == std_b, _is(MATCH, "Identical")).otherwise(_is(CRITICAL, "Values differ")))
    )


@cache
def pair_verdict() -> Column:
    """:func:`verdict` over the columns field, value_a/b and std_a/b, built once per process."""
    return verdict(*[F.col(c) for c in ("field", "value_a", "value_b", "std_a", "std_b")])


# --- views: the desk view and the matrix view have rules of their own ---------------------------------------------------


def view_names_alike(a: Column, b: Column) -> Column:
    ta = F.array_distinct(F.split(text.view_name(a), " "))
    tb = F.array_distinct(F.split(text.view_name(b), " "))
    return F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb)) >= 0.66


def view_address_overlap(a: Column, b: Column, stopwords: list[str]) -> Column:
    sa, sb = text.view_address_tokens(a, stopwords), text.view_address_tokens(b, stopwords)
    return F.size(F.array_intersect(sa, sb)) / F.greatest(F.lit(1), F.least(F.size(sa), F.size(sb)))


def desk_view_missing(c: Column) -> Column:
    return F.coalesce(F.upper(text.strip(c)).isin("UNCERTAIN", "N/A", "NA", "—", "-") | (c == ""), F.lit(True))


def desk_view_status(field: Column, a: Column, b: Column) -> Column:
    """MATCH, VARIANT, CRITICAL or UNCERTAIN by the desk view's rules."""
    same_name = text.view_name(a) == text.view_name(b)
    year_a, year_b = text.view_dob_year(a), text.view_dob_year(b)
    digits_a, digits_b = F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", "")
    same_day = (text.view_dob_key(a) == text.view_dob_key(b)) | year_a.eqNullSafe(year_b)
    bare_a, bare_b = F.regexp_replace(a, text.SPACE, ""), F.regexp_replace(b, text.SPACE, "")
    return (
        F.when(desk_view_missing(a) | desk_view_missing(b), UNCERTAIN)
        .when(
            field.isin(*text.NAME_FIELDS),
            F.when(same_name, F.when(text.strip(a) == text.strip(b), MATCH).otherwise(VARIANT))
            .when(view_names_alike(a, b), VARIANT)
            .otherwise(CRITICAL),
        )
        .when(
            field == "dob",
            F.when(year_a != year_b, CRITICAL)
            .when(same_day, F.when(digits_a == digits_b, MATCH).otherwise(VARIANT))
            .otherwise(CRITICAL),
        )
        .when(field == "address", F.when(view_address_overlap(a, b, []) >= 0.5, VARIANT).otherwise(CRITICAL))
        .when(field == "id_number", F.when(bare_a == bare_b, MATCH).otherwise(CRITICAL))
        .otherwise(F.when(F.lower(text.strip(a)) == F.lower(text.strip(b)), MATCH).otherwise(CRITICAL))
    )


def matrix_status(field: Column, a: Column, b: Column, unsure: Column) -> Column:
    """match, variant, blocker, uncertain or missing: a document value ``b`` against the reference value ``a``."""
    same_name = text.view_name(a) == text.view_name(b)
    year_a, year_b = text.view_dob_year(a), text.view_dob_year(b)
    same_key = text.view_dob_key(a) == text.view_dob_key(b)
    same_bare = F.regexp_replace(a, text.SPACE, "") == F.regexp_replace(b, text.SPACE, "")
    gender_a, gender_b = text.gender_class(a), text.gender_class(b)
    plain_a, plain_b = (F.lower(F.replace(text.strip(c), F.lit("."), F.lit(""))) for c in (a, b))
    overlap = view_address_overlap(a, b, facts.VIEW_ADDRESS_STOPWORDS)
    return (
        F.when(unsure, "uncertain")
        .when((a == "") | (b == ""), "missing")
        .when(
            field.isin(*text.NAME_FIELDS),
            F.when(same_name, F.when(text.strip(a) == text.strip(b), "match").otherwise("variant"))
            .when(view_names_alike(a, b), "variant")
            .otherwise("blocker"),
        )
        .when(
            field == "dob",
            F.when(year_a != year_b, "blocker")
            .when(same_key | same_bare, "match")
            .when(year_a == year_b, "variant")
            .otherwise("blocker"),
        )
        .when(
            field == "gender",
            F.when(plain_a == plain_b, "match").when(gender_a == gender_b, "variant").otherwise("blocker"),
        )
        .when(field == "address", F.when(overlap >= 0.5, "variant").otherwise("blocker"))
        .when(field == "id_number", "match")
        .otherwise(F.when(F.lower(text.strip(a)) == F.lower(text.strip(b)), "match").otherwise("blocker"))
    )
