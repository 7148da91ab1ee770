"""Tables written on the way are dropped by name, and hubs of the component search are joined by broadcast."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from milaan.llm import components as stars
from milaan.llm import op03_jaccard
from milaan.llm.common import Scratch


def test_only_named_tables_stay(spark):
    scratch = Scratch(spark)
    a, b, c = (scratch.written(spark.range(n), "t") for n in (1, 2, 3))
    paths = [path for _, path in scratch.held.values()]
    setting = spark.conf.get(Scratch.CLEANUP, "false")
    scratch.drop(a)
    scratch.only(b)
    assert [os.path.exists(p) for p in paths] == [False, True, False] and b.count() == 2
    assert spark.conf.get(Scratch.CLEANUP, "false") == setting


def test_setting_comes_back_when_a_write_fails(spark):
    before = spark.conf.get(Scratch.CLEANUP, "false")
    with pytest.raises(Exception, match="no such thing"):
        Scratch(spark).written(spark.range(1).select(F.raise_error(F.lit("no such thing")).alias("x")), "t")
    assert spark.conf.get(Scratch.CLEANUP, "false") == before


@pytest.mark.parametrize("hubs", [1, 3, 4096])
def test_components_with_and_without_hubs(spark, monkeypatch, hubs):
    """Every bound gives the same components: none is a hub at 1, nearly every vertex at 4096."""
    monkeypatch.setattr(stars, "HUBS", hubs)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, 4000), (4000, 5000), (7, 7), (8000, 8000)]
    scratch = Scratch(spark)
    found = stars.components(spark.createDataFrame(edges, "u long, v long"), scratch)
    got = {r["id"]: r["root"] for r in found.collect()}
    assert got == {i: 0 for i in range(1, 300)} | {i: 1000 for i in range(1001, 1031)} | {5000: 4000}
    assert len(scratch.held) == 1


def test_the_join_leaves_two_tables(spark):
    scratch = Scratch(spark)
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, "other words than these here"), (4, None)], "doc_id long, text string")
    rows = op03_jaccard.described(docs, scratch)
    out = op03_jaccard.join(docs, rows, scratch)
    assert out.count() == 3 and len(scratch.held) == 2


@pytest.mark.parametrize("n", [1, 2, 7, 64, 700])
def test_shared_tokens_are_counted_lane_by_lane(n):
    rng = np.random.default_rng(n)
    lanes = rng.integers(0, 3, (n, op03_jaccard.LANES)).astype(np.uint32)
    got = op03_jaccard._same(lanes)
    assert got.shape == (n, n)
    for i, j in rng.integers(0, n, (200, 2)):
        assert got[i, j] == sum(int(a == b) for a, b in zip(lanes[i], lanes[j], strict=True))
