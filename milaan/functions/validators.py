"""Format rules of form answers, as Catalyst expressions returning ``struct<ok, message>``."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from milaan.functions import text
from milaan.functions.similarity import bind


def _result(ok: bool, message) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(ok).alias("ok"), message.alias("message"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^\p{Nd}]", "")


def _without(v: Column, pattern: str) -> Column:
    return F.upper(F.regexp_replace(v, pattern, ""))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def aadhaar(v: Column) -> Column:
    d = _digits(v)
    return (
        F.when(F.length(d) != 12, _result(False, _text("Aadhaar must be exactly 12 digits (got ", F.length(d), ")")))
        .when(d.rlike("^[01]"), _result(False, "Aadhaar cannot start with 0 or 1"))
        .otherwise(_result(True, "Valid 12-digit Aadhaar format"))
    )


def pan(v: Column) -> Column:
    return F.when(
        _without(v, text.SPACE).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), _result(True, "Valid PAN format")
    ).otherwise(_result(False, "PAN must match format AAAAA9999A (5 letters + 4 digits + 1 letter)"))


def mobile(v: Column) -> Column:
    d = F.regexp_replace(_digits(v), r"^91(?=\p{Nd}{10}$)", "")
    return (
        F.when(F.length(d) != 10, _result(False, _text("Mobile must be 10 digits (got ", F.length(d), ")")))
        .when(~d.rlike("^[6-9]"), _result(False, "Indian mobile numbers start with 6, 7, 8, or 9"))
        .otherwise(_result(True, "Valid mobile format"))
    )


def dob(v: Column, d: Column, today: Column) -> Column:
    """``d`` is the date read from ``v``, NULL when there is none."""
    age = F.floor(F.datediff(today, d) / 365)
    return (
        F.when(text.strip(v) == "", _result(False, "Date of birth is required"))
        .when(d.isNull(), _result(False, "Could not parse date of birth"))
        .when((F.year(d) < 1900) | (d > today), _result(False, "Date of birth is out of realistic range"))
        .otherwise(_result(True, _text("Parsed as ", F.date_format(d, "dd/MM/yyyy"), " (approx age ", age, ")")))
    )


def dl_number(v: Column) -> Column:
    n = _without(v, r"(?U)[\s\-]")
    return (
        F.when(
            ~F.length(n).between(10, 20), _result(False, "DL number length looks wrong (expected ~10–16 characters)")
        )
        .when(~n.rlike("^[A-Z]{2}"), _result(False, "DL number should start with state code (e.g. MH, KA, DL)"))
        .otherwise(_result(True, "DL number format looks plausible"))
    )


def epic(v: Column) -> Column:
    n = _without(v, r"(?U)[\s\-]")
    plausible = F.length(n).between(8, 12) & n.rlike("[A-Z]") & n.rlike(r"\p{Nd}")
    return (
        F.when(n.rlike("^[A-Z]{3}[0-9]{7}$"), _result(True, "Valid EPIC format (3 letters + 7 digits)"))
        .when(plausible, _result(True, "EPIC format looks plausible (non-standard length — verify on card)"))
        .otherwise(_result(False, "EPIC should look like ABC1234567 (3 letters + 7 digits)"))
    )


def passport(v: Column) -> Column:
    n = _without(v, r"(?U)[\s\-]")
    return (
        F.when(n == "", _result(True, "Optional — blank OK for fresh passport"))
        .when(n.rlike("^[A-Z][0-9]{7}$"), _result(True, "Valid Indian passport number format"))
        .when(n.rlike("^[A-Z]{1,2}[0-9]{6,8}$"), _result(True, "Passport number format looks plausible"))
        .otherwise(_result(False, "Passport number usually looks like A1234567"))
    )


def ifsc(v: Column) -> Column:
    return F.when(
        _without(v, text.SPACE).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), _result(True, "Valid IFSC format")
    ).otherwise(_result(False, "IFSC must be 11 chars: 4 letters + 0 + 6 alphanumeric"))


def account_number(v: Column) -> Column:
    n = F.length(_digits(v))
    return F.when(n.between(9, 18), _result(True, "Account number length looks plausible")).otherwise(
        _result(False, _text("Account number length looks wrong (got ", n, " digits)"))
    )


def email(v: Column) -> Column:
    return F.when(
        text.strip(v).rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), _result(True, "Valid email format")
    ).otherwise(_result(False, "Email does not look valid"))


def nonempty(v: Column, label: Column) -> Column:
    s = text.strip(v)
    return (
        F.when(s == "", _result(False, _text(label, " is empty — form is incomplete")))
        .when(F.length(s) < 2, _result(False, _text(label, " is too short to be valid")))
        .otherwise(_result(True, "Present"))
    )


def address_pincode(v: Column) -> Column:
    return (
        F.when(text.strip(v) == "", _result(False, "Address is empty"))
        .when(v.rlike(r"(?U)\b\p{Nd}{6}\b"), _result(True, "Address includes a pincode"))
        .otherwise(_result(False, "Address should include a 6-digit pincode (portals often reject without it)"))
    )


def apply(validator: Column, v: Column, form_key: Column, date: Column, today: Column) -> Column:
    """The named rule on a value; NULL for a NULL name.  ``date`` is the date in the value (needed by ``dob`` only)."""
    v = F.coalesce(v, F.lit(""))
    checks = {
        "aadhaar": aadhaar(v),
        "pan": pan(v),
        "mobile": mobile(v),
        "dob": dob(v, date, today),
        "dl_number": dl_number(v),
        "epic": epic(v),
        "passport": passport(v),
        "ifsc": ifsc(v),
        "account_number": account_number(v),
        "email": email(v),
        "nonempty": nonempty(v, form_key),
        "address_pincode": address_pincode(v),
    }
    out = None
    for name, check in checks.items():
        out = F.when(validator == name, check) if out is None else out.when(validator == name, check)
    return out


@cache
def rule_check() -> Column:
    """:func:`apply` over the columns validator, value, form_key, date and today, built once per process."""
    return apply(*[F.col(c) for c in ("validator", "value", "form_key", "date", "today")])


def spoken_problem(field_key: Column, value: Column) -> Column:
    """The looser rules for spoken answers: an error text, or NULL when the answer is good enough."""
    return bind(text.strip(F.coalesce(value, F.lit(""))), lambda v: _spoken_problem(field_key, v))


def _spoken_problem(field_key: Column, v: Column) -> Column:
    def about(*parts: str) -> Column:
        return text.any_of([F.contains(field_key, F.lit(p)) for p in parts])

    digits = F.length(F.regexp_replace(v, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    genders = ("male", "female", "other", "man", "woman", "boy", "girl", "trans")
    told_gender = text.any_of([F.contains(F.lower(v), F.lit(g)) for g in genders])
    last_part = F.substring_index(v, "@", -1)
    no_problem = F.lit(None).cast("string")
    return (
        F.when(F.length(v) < 2, "I did not catch that. Please say it again.")
        .when(
            about("mobile", "phone"),
            F.when(digits < 10, "Mobile looks incomplete. Say all 10 digits.").when(
                digits > 12, "That number is too long. Say your 10-digit mobile."
            ),
        )
        .when(
            about("email"),
            F.when(~F.contains(v, F.lit("@")) | ~F.contains(last_part, F.lit(".")), "That does not look like an email. Try again."),
        )
        .when(
            about("dob") | F.endswith(field_key, F.lit("_date")),
            F.when(digits == 0, "Include the date with numbers, like 15 March 2002."),
        )
        .when(about("aadhaar"), F.when(digits < 8, "Aadhaar should be 12 digits. Say it again slowly."))
        .when(about("gender"), F.when(~told_gender, "Please say Male, Female, or Other."))
        .when(
            about("name"),
            F.when(letters < 3, "Name is too short. Say your full name.").when(
                (F.size(F.split(v, text.SPACE)) == 1) & (letters < 4), "Please say your full name, including surname."
            ),
        )
        .when(about("address"), F.when(F.length(v) < 6, "Please say a fuller address — area, city, or pin."))
        .otherwise(no_problem)
    )
