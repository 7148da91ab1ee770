"""Texts without a break, rows that repeat, chains that take many rounds."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from milaan.llm import op01_mix, op06_pii
from milaan.llm.components import components

MB = 1 << 20
RUNS = {
    "letters": "a" * MB, "capitals": "A" * MB, "digits": "7" * MB, "hyphens": "-" * MB, "cjk": "中" * MB, "a-a": "a-" * (MB // 2), "aa-aa": "aa-" * (MB // 3),
    "a@a-a": "a@" + "a-" * (MB // 2), "dots": "x@" + "a." * (MB // 2), "ats": "@" * MB, "a@a@": "a@" * (MB // 2), "hex": "0f" * (MB // 2), "groups": "1 " * (MB // 2),
    "name and letters": "Mary " + "a" * MB + "1", "name and initials": "Mary " + "a." * (MB // 2), "name and parts": "Mary " + "aa-" * (MB // 3) + "a1",
    "mentions": "Mary Miller " + "J. Miller " * (MB // 12) + "Mr Miller " * 1000, "pluses": "+1 " * (MB // 3),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_detection_ends_on_a_megabyte_without_a_break(name):
    started = time.process_time()
    op06_pii.entities(RUNS[name])
    assert time.process_time() - started < 25


EMAIL = re.compile(r"[\w.%+-]*[\w%+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)+|[0-9]{13,19}")


@settings(max_examples=400, deadline=None)
@given(st.text("aB1.@-_ é%x", max_size=30))
def test_emails_are_what_the_plain_pattern_finds(text):
    assert op06_pii._emails(text) == [(m.start(), m.end(), m[0].lower()) for m in EMAIL.finditer(text)]


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789454 -x", max_size=70))
def test_cards_are_what_the_plain_pattern_leads_to(text):
    got = op06_pii._cards(text)
    fast, op06_pii.CARD = op06_pii.CARD, CARD
    try:
        assert got == op06_pii._cards(text)
    finally:
        op06_pii.CARD = fast


def test_long_runs_and_clashing_names_pass_through(spark):
    rows = [(1, "m" * MB, 5, "x"), (2, "Mary Miller wrote to mary.miller@mail.example.org", 6, "y"), (2, None, 7, "z"), (None, "", 8, None), (2, "Mary Miller " + "a-" * 5000, 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_person int, spans string")
    got = {(r["doc_id"], r["spans"]): r for r in op06_pii.pseudonymized(docs).collect()}
    assert len(got) == 5 and got[1, "x"]["text"] == "m" * MB and got[2, "z"]["text"] is None and got[None, None]["text"] == ""
    assert got[2, "y"]["n_person"] == 1 and got[2, "y"]["n_email"] == 1 and "Mary" not in got[2, "y"]["text"] and "Miller" not in got[2, "w"]["text"]
    # The same person has the same surrogate in both documents.
    assert got[2, "y"]["text"].split(" wrote")[0] == " ".join(got[2, "w"]["text"].split(" ")[:2])


def test_a_mix_of_repeated_rows_meets_its_targets(spark):
    rows = [(1, "w " * 5, "a")] * 400 + [(2, "w " * 10, "b")] * 300 + [(i, "x " * 3, "c") for i in range(3, 600)] + [(None, "y " * 7, None)] * 333 + [(None, "z" * i, "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    made = op01_mix.mix(docs)
    assert made.count() == len(rows) and made.filter("taken > 3 * size").count() == 0
    for r in made.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect():
        assert abs(r["taken"] - r["target"]) <= r["size"], r
    counts = lambda: sorted(map(tuple, op01_mix.mix(docs).groupBy("source", "doc_id", "copies").count().collect()), key=repr)
    assert counts() == counts()


def test_components_of_a_long_path_are_one(spark):
    order = random.Random(8).sample(range(3000), 3000)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5000, 5001)], "u long, v long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {5001: 5000}
