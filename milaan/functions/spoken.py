"""Spoken answers as form values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from milaan.catalogue import facts
from milaan.functions import text
from milaan.functions.similarity import bind


def without_lead_ins(c: Column) -> Column:
    s = text.strip(c)
    s = text.strip(
        F.regexp_replace(s, r"(?i)^(mera naam|meri naam|my name|full name|naam|name)\s*(hai|hain|is|:)?\s*", "")
    )
    s = text.strip(F.regexp_replace(s, r"(?i)^(mera|meri|my|please|ji)\s+", ""))
    return text.strip(F.regexp_replace(s, r"(?i)\s+(hai|hain|is|please|ji)\.?$", ""))


def spelled_out(c: Column) -> Column:
    """Join a word that was spelled letter by letter, with blanks or dashes."""
    return bind(text.strip(c), _joined)


def _joined(s: Column) -> Column:
    letters = F.regexp_extract_all(s, F.lit(r"(?U)\b([A-Za-z])\b"), 1)
    whole_words = F.regexp_count(s, F.lit(r"[A-Za-z]{2,}"))
    dashed = F.regexp_extract(s, r"(?iU)\b([a-z](?:-[a-z]){2,})\b", 1)
    return (
        F.when((F.size(letters) >= 3) & (whole_words <= 1), F.upper(F.array_join(letters, "")))
        .when(dashed != "", F.upper(F.replace(dashed, F.lit("-"), F.lit(""))))
        .otherwise(s)
    )


def block_letters(value: Column, field_key: Column) -> Column:
    """The value as it goes on the form, by the kind of field."""
    return bind(text.strip(value), lambda v: _in_block_letters(v, field_key))


def _in_block_letters(v: Column, field_key: Column) -> Column:
    def about(*parts: str) -> Column:
        return text.any_of([F.contains(field_key, F.lit(p)) for p in parts])

    def heard(*parts: str) -> Column:
        return text.any_of([F.contains(F.lower(v), F.lit(p)) for p in parts])

    digits = F.regexp_replace(v, r"[^\p{Nd}+]", "")
    return (
        F.when(v == "", v)
        .when(about("mobile", "phone", "otp", "pincode", "pin_code"), F.when(digits != "", digits).otherwise(v))
        .when(about("email"), F.lower(F.regexp_replace(v, text.SPACE, "")))
        .when(
            about("name", "father", "mother", "address", "reason", "village", "district"),
            F.upper(F.regexp_replace(v, text.SPACE, " ")),
        )
        .when(
            about("gender"),
            F.when(heard("female", "woman", "girl", "f"), "FEMALE")
            .when(heard("male", "man", "boy", "m"), "MALE")
            .when(heard("other", "trans"), "OTHER")
            .otherwise(F.upper(v)),
        )
        .otherwise(v)
    )


def form_value(transcript: Column, field_key: Column) -> Column:
    return block_letters(spelled_out(without_lead_ins(transcript)), field_key)


def yes_or_no(transcript: Column) -> Column:
    """'no' when any no-word is heard, 'yes' when only yes-words are, else NULL."""
    heard = F.split(F.translate(F.lower(transcript), ",.", "  "), text.SPACE)
    yes = F.array(*[F.lit(w) for w in facts.YES_WORDS])
    no = F.array(*[F.lit(w) for w in facts.NO_WORDS])
    return F.when(F.arrays_overlap(heard, no), "no").when(F.arrays_overlap(heard, yes), "yes")


def intent(transcript: Column) -> Column:
    """blank, documents, clear, redo, done or answer: what a turn asks for, by phrases found anywhere in it."""
    t = text.strip(F.coalesce(transcript, F.lit("")))
    low = F.lower(t)

    def hears(phrases: list[str]) -> Column:
        return text.any_of([F.contains(low, F.lit(p)) for p in phrases])

    return (
        F.when(t == "", "blank")
        .when(hears(facts.DOCUMENT_PHRASES), "documents")
        .when(hears(facts.CLEAR_PHRASES), "clear")
        .when(hears(facts.REDO_PHRASES), "redo")
        .when(hears(facts.DONE_PHRASES), "done")
        .otherwise("answer")
    )
